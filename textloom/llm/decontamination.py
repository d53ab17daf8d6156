"""Op 10: benchmark contamination by winnowing.

A span of ``WINDOW`` words always holds a selected fingerprint, and an equal span holds an equal one. So joining selected
fingerprints of documents and items meets every shared span; the words around each meeting then decide exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, quoted, written

WINDOW = 13
GRAM = 5
_SELECT = WINDOW - GRAM + 1  # grams in a window
_SIDE = WINDOW - GRAM  # words that a shared window can reach beyond a gram, on either side

# A power of two: the filter that tells documents' tasks which fingerprints items have: fixed size, whatever the number of items.
FILTER_BITS = 1 << 23

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[0x80:] = True
for _low, _high in ("09", "az", "AZ"):
    _WORD_BYTES[ord(_low) : ord(_high) + 1] = True

_MARK = "fp bigint, pos bigint, size int, before array<string>, grams array<string>, after array<string>"
_MARKS = f"array<struct<{_MARK.replace(' ', ':').replace(',:', ',')}>>"
_ARROW_MARKS = pa.list_(
    pa.struct([("fp", pa.int64()), ("pos", pa.int64()), ("size", pa.int32())] + [(n, pa.list_(pa.string())) for n in ("before", "grams", "after")])
)


def selected(grams: np.ndarray, words_row: np.ndarray, gram: int = GRAM, window: int = _SELECT) -> np.ndarray:
    """Positions of the rightmost least hash of every run of ``window`` grams within one row, each once."""
    count = len(words_row) - (gram + window - 1) + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(words_row[:count] == words_row[gram + window - 2 : gram + window - 2 + count])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    picks = np.zeros(len(grams), bool)
    for part in range(0, len(whole), 1 << 16):
        start = whole[part : part + (1 << 16)]
        picks[start + window - 1 - np.argmin(views[start][:, ::-1], axis=1)] = True
    return np.flatnonzero(picks)


def _marks(batches: Iterator[pa.RecordBatch], item_side: bool, sizes: list[int], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Per row its key, number of words, and marks: selected grams, and whole runs of each short item length in ``sizes``.

    Items mark themselves; documents keep the marks that the filter ``bits`` may know.
    """
    for rows, data, bounds in A.blocks(batches):
        data = A.LOWER[data]
        start, end, row = A.spans(_WORD_BYTES[data], bounds)
        words = A.span_hashes(A.prefix_hashes(data), start, end)
        per_row = np.bincount(row, minlength=rows.num_rows)
        first_word = np.concatenate([[0], np.cumsum(per_row)])
        found: list[tuple[int, int, int, int]] = []
        for size in [0, *sizes]:
            length = size or GRAM
            hashes = A.gram_hashes(words, length)
            if not len(hashes):
                continue
            if size:
                at = np.flatnonzero(row[: len(hashes)] == row[length - 1 : length - 1 + len(hashes)])
                if item_side:
                    at = at[per_row[row[at]] == size]
            else:
                at = selected(hashes, row)
            values = A.mix(hashes[at] + np.uint64(length))
            if bits is not None:
                slot = values & np.uint64(FILTER_BITS - 1)
                known = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                at, values = at[known == 1], values[known == 1]
            found += zip(row[at].tolist(), at.tolist(), values.view(np.int64).tolist(), [length if size else 0] * len(at))
        marks: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for owner, at, value, size in found:
            low, high = int(first_word[owner]), int(first_word[owner + 1])
            length, side = size or GRAM, 0 if size else _SIDE

            def text(a: int, b: int) -> list[str]:
                return [data[start[i] : end[i]].tobytes().decode() for i in range(max(a, low), min(b, high))]

            marks[owner].append(
                {"fp": value, "pos": at - low, "size": size, "before": text(at - side, at)[::-1], "grams": text(at, at + length), "after": text(at + length, at + length + side)}
            )
        yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(per_row, pa.int64()), pa.array(marks, _ARROW_MARKS)], names=["key", "n_words", "marks"])


def _filter_bits(items: DataFrame) -> np.ndarray:
    """A fixed-size bit array that knows every item fingerprint; its words are combined on the executors."""
    slot = F.col("fp").bitwiseAND(FILTER_BITS - 1)
    bytes_ = items.select(slot.alias("slot")).groupBy(F.expr("slot div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot % 8)")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, value in bytes_.toLocalIterator():  # at most FILTER_BITS / 8 rows
        bits[at] = value
    return bits


def contamination(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A window is
    ``WINDOW`` consecutive words of an item, or the whole item if it has fewer but any. A document word inside any occurrence of a
    window is hit. Null and empty texts have no words; repeated or null keys keep their rows (each row is judged by its own text); an
    empty item table hits nothing; null item keys are left out of the list of items but their words hit.
    """
    spark = documents.sparkSession
    shape = "key {0}, n_words bigint, marks " + _MARKS
    item_rows = keyed_texts(items, item_key, item_text)
    item_type = item_rows.schema["key"].dataType.simpleString()
    lengths = item_rows.mapInArrow(_word_counts, "n_words bigint").filter(f"n_words between 1 and {WINDOW - 1}").distinct()
    sizes = sorted(r.n_words for r in lengths.collect())  # at most WINDOW - 1 values
    item_marks = written(
        item_rows.mapInArrow(lambda batches: _marks(batches, True, sizes, None), shape.format(item_type))
        .select(F.col("key").alias("item"), F.explode("marks").alias("m"))
        .select("item", "m.*"),
        "benchmark-marks",
    )
    bits = spark.sparkContext.broadcast(_filter_bits(item_marks))

    rows = keyed_texts(documents, key, text).withColumn("key", F.struct(F.col("key"), F.monotonically_increasing_id().alias("row")))
    kind = rows.schema["key"].dataType.simpleString()
    scanned = written(rows.mapInArrow(lambda batches: _marks(batches, False, sizes, bits.value), shape.format(kind)), "document-marks")

    doc_marks = scanned.select("key.row", F.explode("marks").alias("m")).select("row", "m.*")
    met = doc_marks.alias("d").join(item_marks.alias("i"), (F.col("d.fp") == F.col("i.fp")) & (F.col("d.size") == F.col("i.size")) & (F.col("d.grams") == F.col("i.grams")))
    before, after = _common("d.before", "i.before"), _common("d.after", "i.after")
    hits = (
        met.select("d.row", "i.item", F.col("d.pos").alias("pos"), "d.size", before.alias("b"), after.alias("a"))
        .filter(F.expr(f"size > 0 or b + a + {GRAM} >= {WINDOW}"))
        .select("row", "item", F.expr("pos - b").alias("low"), F.expr(f"pos + a + if(size > 0, size, {GRAM})").alias("high"))
    )
    spans = hits.groupBy("row", "low", "high").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    reach = F.max("high").over(Window.partitionBy("row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("high") - F.greatest(F.col("low"), F.coalesce(F.col("reach"), F.col("low"))), F.lit(0))
    per_row = (
        spans.withColumn("reach", reach)
        .groupBy("row")
        .agg(F.sum(fresh).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    return (
        scanned.select("key.key", "key.row", "n_words")
        .join(per_row, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.expr("coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n_words").alias("contaminated"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _common(left: str, right: str):
    """How many leading words two lists share."""
    differs = F.transform(F.arrays_zip(F.col(left).alias("x"), F.col(right).alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))
    place = F.array_position(differs, True)
    return F.when(place > 0, place - 1).otherwise(F.size(differs)).cast("int")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in A.blocks(batches):
        row = A.spans(_WORD_BYTES[data], bounds)[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.bincount(row, minlength=rows.num_rows), pa.int64())], names=["n_words"])


def without_contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not contaminated, columns unchanged. Keys must identify rows; null keys stay."""
    bad = contamination(documents, items, key, text).filter("contaminated").select(quoted(key).alias("bad_key"))
    # Stored first, so that Spark knows how few they are and need not move the documents.
    return documents.join(written(bad, "contaminated"), quoted(key) == F.col("bad_key"), "left_anti")
