"""Op 12: lines that stand in many documents, by two Bloom filters.

A first scan fills one filter with the lines seen once and one with those seen twice; only lines in the latter can be
repeats. A second scan counts these suspects exactly, by a digest of the whole line, and notes where each stands first. A third
scan looks for the lines found to be frequent and lets documents without any go at once; the others are joined with the exact
counts before they lose a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, written
from textloom.llm.filters import PIECES, KeyFilter, SeenTwice, filter_bits, filter_of, seen_twice

LEAST_DOCUMENTS = 10
LEAST_CHARS = 1

_HIT = pa.struct([("line", pa.int32()), ("digest", pa.binary())])


class _Lines:
    """The lines of a block: their row, number in it, trimmed bounds and the hash of their key; ``long_enough`` tells which can be dropped."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least_chars: int):
        self.data = A.LOWER[data]
        breaks = np.flatnonzero(data == 0x0A)
        heads = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
        # A row starts at its bound; a break that ends a row opens one more line in that row, not in the next.
        owner_of_break = np.searchsorted(bounds, breaks, "right") - 1
        per_row = np.bincount(owner_of_break, minlength=len(bounds) - 1) + 1
        self.row = np.repeat(np.arange(len(bounds) - 1), per_row)
        firsts = np.concatenate([[0], np.cumsum(per_row)])
        self.number = np.arange(len(self.row)) - firsts[self.row]
        self.firsts = firsts
        ends = np.empty(len(heads), np.int64)
        ends[:-1] = heads[1:] - 1
        ends[firsts[1:] - 1] = bounds[1:]
        visible = np.flatnonzero(A.NOT_SPACE[data])
        low, high = np.searchsorted(visible, heads), np.searchsorted(visible, ends)
        some = low < high
        self.start, self.end = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        self.start[some], self.end[some] = visible[low[some]], visible[high[some] - 1] + 1
        self.hash = A.span_hashes(A.prefix_hashes(self.data), self.start, self.end)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long_enough = chars[self.end] - chars[self.start] >= max(least_chars, 1)

    def digest(self, line: int) -> bytes:
        return hashlib.blake2b(self.data[self.start[line] : self.end[line]].tobytes(), digest_size=16).digest()

    def keys(self, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines ``places``: one for each key and row, by key, then the row's ``rank``, then its number; and where a new key starts."""
        by = places[np.lexsort((self.number[places], self.row[places], self.hash[places]))]
        fresh = (self.hash[by][1:] != self.hash[by][:-1]) | (self.row[by][1:] != self.row[by][:-1])
        by = by[np.concatenate([[True], fresh])[: len(by)]]
        by = by[np.lexsort((self.number[by], rank[self.row[by]], self.hash[by]))]
        return by, np.concatenate([[True], self.hash[by][1:] != self.hash[by][:-1]])[: len(by)]


def _order(keys: pa.Array) -> np.ndarray:
    """The rank of each key, nulls first, equal for equal keys."""
    return pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def frequent_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``digest, hash, n_documents, first_key, first_line`` of each line key found in at least ``least_documents`` rows of ``documents``.

    The key of a line is the line without ASCII white space at its ends and with A-Z lower-cased; it counts once a row.
    """
    rows = keyed_texts(documents, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = filter_bits(lines)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(bits)
        for part, data, bounds in A.blocks(batches):
            block = _Lines(data, bounds, least_chars)
            once_a_row, _ = block.keys(np.flatnonzero(block.long_enough), np.arange(part.num_rows))
            seen.see(block.hash[once_a_row])
        yield from seen.pieces()

    if least_documents > 1:
        suspects = documents.sparkSession.sparkContext.broadcast(seen_twice(rows.mapInArrow(look, PIECES), bits).packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeyFilter(suspects.value) if least_documents > 1 else None
        for part, data, bounds in A.blocks(batches):
            block = _Lines(data, bounds, least_chars)
            suspect = block.long_enough if known is None else block.long_enough & known.has(block.hash)
            places, heads = block.keys(np.flatnonzero(suspect), _order(part.column("key")))
            first = places[heads]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.digest(i) for i in first.tolist()], pa.binary()),
                    pa.array(block.hash[first].view(np.int64)),
                    pa.array(np.diff(np.flatnonzero(np.append(heads, True))), pa.int64()),
                    part.column("key").take(pa.array(block.row[first])),
                    pa.array(block.number[first], pa.int32()),
                ],
                names=["digest", "hash", "n", "key", "line"],
            )

    counted = rows.mapInArrow(count, f"digest binary, hash bigint, n bigint, key {kind}, line int")
    return (
        counted.groupBy("digest")
        .agg(F.first("hash").alias("hash"), F.sum("n").alias("n_documents"), F.min(F.struct("key", "line")).alias("first"))
        .filter(F.col("n_documents") >= least_documents)
        .select("digest", "hash", "n_documents", F.col("first.key").alias("first_key"), F.col("first.line").alias("first_line"))
    )


def drop_frequent_lines(
    documents: DataFrame, key: str = "doc_id", text: str = "text", least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, keep_first: bool = False
) -> DataFrame:
    """Per row: ``key``, n_lines (before), n_dropped, kept (the other lines joined by line feeds).

    Texts are split at line feeds; a null or empty text is one empty line. Keys (see ``frequent_lines``) of ``least_chars`` code
    points or more that stand in ``least_documents`` rows or more lose all their lines, or all but one with ``keep_first``: the one with the least
    document key (null first), then the least line number; rows that share this document key keep it each. Every row counts as a
    document, also repeated ones. Other columns are ignored; an empty table gives no rows. Texts have any length; a text is worked on
    whole, in memory in proportion to its bytes.

    Shuffled are filters, suspect lines as digests counted beforehand, and the texts of documents that hold a frequent line.
    """
    spark = documents.sparkSession
    frequent = written(frequent_lines(documents, key, text, least_documents, least_chars), "frequent-lines", "zstd")
    wanted = spark.sparkContext.broadcast(filter_of(frequent, "hash").packed)
    rows = keyed_texts(documents, key, text).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["key"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeyFilter(wanted.value)
        for part, data, bounds in A.blocks(batches):
            block = _Lines(data, bounds, least_chars)
            places = np.flatnonzero(block.long_enough & known.has(block.hash))
            hits = pa.array([{"line": n, "digest": block.digest(i)} for i, n in zip(places.tolist(), block.number[places].tolist())], _HIT)
            offsets = pa.array(np.searchsorted(block.row[places], np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("row"), pa.array(np.diff(block.firsts), pa.int64()), pa.ListArray.from_arrays(offsets, hits), part.column("text")],
                names=["key", "row", "n_lines", "hits", "text"],
            )

    scanned = written(rows.mapInArrow(look, f"key {kind}, row bigint, n_lines bigint, hits array<struct<line:int,digest:binary>>, text string"), "lines-looked-up", "zstd")
    clean = scanned.filter(F.size("hits") == 0).select("key", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    hit = scanned.filter(F.size("hits") > 0)
    gone = hit.select("key", "row", F.explode("hits").alias("hit")).select("key", "row", "hit.*").join(frequent, "digest")
    if keep_first:
        gone = gone.filter(~(F.col("key").eqNullSafe(F.col("first_key")) & (F.col("line") == F.col("first_line"))))
    lists = gone.groupBy("row").agg(F.collect_list("line").alias("lines"))
    cut = hit.select("key", "row", "n_lines", "text").join(lists, "row", "left").select("key", "n_lines", "lines", "text")
    done = cut.mapInArrow(_cut, f"key {kind}, n_lines bigint, n_dropped bigint, kept string")
    return clean.unionAll(done).withColumnRenamed("key", key)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, dropped = [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist()):
            gone = set(lines or ())
            kept.append("\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone]))
            dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_lines", "n_dropped", "kept"])
