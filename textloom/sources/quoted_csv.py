"""CSV files with line breaks inside quotes, read by many tasks per file.

Whether a physical line starts a record or continues a quoted cell depends on all lines before it. But a line can only do one of
four things to that state: end outside quotes, end inside them, leave the state as it is, or turn it round. Such maps compose. So each
byte range of a file is first read for its composed map alone; the maps of a file's ranges, one row each, give every range its true
start; and in a second read each range cuts its lines into records. A record that crosses a border comes in fragments, which are
joined on their own. Spark's CSV parser then parses each record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.binding import quoted
from textloom.session import ship_package

# What tells a range of a file.
RANGE = ("_tl_file", "_tl_block")

# The number of a header record.
HEADER = -1


def _open_after(sep: str, inside: bool) -> str:
    """A pattern for lines that end within quotes, begun at a record's start or ``inside`` quotes.

    A quote opens a cell only as its first character, two quotes within are one, and what follows a closing quote up to the next
    separator belongs to the cell. Every loop is possessive, so a line is passed once.
    """
    s = re.escape(sep)
    body = '(?:[^"]++|"")*+'
    rest = f"[^{s}]*+"
    cell = f'(?:"{body}"{rest}|(?!"){rest})'
    if inside:
        return f'^{body}(?:$|"{rest}(?:{s}{cell})*+{s}"{body}$)'
    return f'^(?:{cell}{s})*+"{body}$'


def _lines(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """The physical lines of each range in order, with what each does to the state."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias(RANGE[0]),
        F.col("_metadata.file_block_start").alias(RANGE[1]),
        F.col("value").alias("line"),
        F.col("value").rlike(_open_after(sep, False)).alias("from_outside"),
        F.col("value").rlike(_open_after(sep, True)).alias("from_inside"),
    )


def _starts(from_outside: np.ndarray, from_inside: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """Whether each line starts inside quotes, if the first one does as ``start`` says; and whether the last one ends inside."""
    fixed = from_outside == from_inside
    turns = np.cumsum(~fixed & from_outside)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = last >= 0
    base = np.where(known, from_outside[last], start)
    after = base ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)
    return np.concatenate([[start], after[:-1]]), bool(after[-1])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch cut where a new range starts."""
    blocks = batch.column(RANGE[1]).to_numpy(zero_copy_only=False)
    files = batch.column(RANGE[0]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if low < high:
            yield (batch.column(RANGE[0])[low].as_py(), int(blocks[low])), batch.slice(low, high - low)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("from_outside", "from_inside"))


def range_maps(lines: DataFrame) -> DataFrame:
    """One row for each range: for a start outside and inside quotes whether it ends inside and how many records start in it; and whether its
    first line ends with CR."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, counts, cr = None, None, None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), *[pa.array([bool(e)]) for e in ends], *[pa.array([c], pa.int64()) for c in counts], pa.array([cr])]
            return pa.RecordBatch.from_arrays(columns, names=[*RANGE, "from_outside", "from_inside", "rows_outside", "rows_inside", "cr"])

        for batch in batches:
            for own, part in _pieces(batch):
                if own != key:
                    if key is not None:
                        yield row()
                    key, ends, counts, cr = own, [False, True], [0, 0], part.column("cr")[0].as_py()
                flags, filled = _flags(part), ~part.column("empty").to_numpy(zero_copy_only=False).astype(bool)
                for i, start in enumerate(list(ends)):
                    goes_on, ends[i] = _starts(*flags, start)
                    counts[i] += int((filled & ~goes_on).sum())
        if key is not None:
            yield row()

    line = F.col("line")
    narrow = lines.select(*RANGE, "from_outside", "from_inside", line.endswith("\r").alias("cr"), line.isin("", "\r").alias("empty"))
    shape = f"{RANGE[0]} string, {RANGE[1]} long, from_outside boolean, from_inside boolean, rows_outside long, rows_inside long, cr boolean"
    return narrow.mapInArrow(compose, shape)


def range_starts(maps: DataFrame) -> DataFrame:
    """For each range whether it starts inside quotes, by composing the maps of the ranges before it in its file; the number of its first
    record, counted over all files in order of their paths, headers left out; and whether its file has CR LF.

    One row per range is sorted in one task.
    """
    before = Window.partitionBy(RANGE[0]).orderBy(RANGE[1]).rowsBetween(Window.unboundedPreceding, -1)
    fixed, turn = F.col("from_outside") == F.col("from_inside"), (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    placed = maps.withColumn("turns", F.coalesce(F.sum(turn).over(before), F.lit(0)) + turn)
    last = F.max_by(F.struct("from_outside", "turns"), F.when(fixed, F.col(RANGE[1]))).over(before)
    so_far = F.coalesce(F.max("turns").over(before), F.lit(0))
    inside = F.coalesce(last["from_outside"], F.lit(False)) != ((so_far - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)
    crlf = F.first("cr").over(Window.partitionBy(RANGE[0]).orderBy(RANGE[1]))
    known = placed.select(*RANGE, inside.alias("inside"), crlf.alias("crlf"), "rows_outside", "rows_inside")
    rows = F.when(F.col("inside"), F.col("rows_inside")).otherwise(F.col("rows_outside"))
    rows = F.when(F.col(RANGE[1]) == 0, F.greatest(rows - 1, F.lit(0))).otherwise(rows)
    counted = Window.orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("rows", rows).select(*RANGE, "inside", "crlf", "rows", F.coalesce(F.sum("rows").over(counted), F.lit(0)).alias("first"))


def _records(lines: DataFrame, starts: dict) -> DataFrame:
    """Records with their numbers, and fragments: ``head`` marks one that ends a record begun before its range, ``tail`` one whose record
    goes on behind it."""
    shared = lines.sparkSession.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, crlf, held, number = None, False, False, None, 0

        def rows(numbers, texts, heads, tail=False) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(heads, pa.bool_()), pa.array([tail] * n, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[*RANGE, "row_id", "record", "head", "tail"])

        def last_of_range() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield rows([held[0]], ["\n".join(held[1])], [held[2]], inside)

        for batch in batches:
            for own, part in _pieces(batch):
                if own != key:
                    yield from last_of_range()
                    (inside, crlf, number), key, held = shared.value[own], own, None
                    header = own[1] == 0
                starts_inside, ends_inside = _starts(*_flags(part), inside)
                texts = part.column("line").to_pylist()
                if crlf:
                    texts = [t[:-1] if t.endswith("\r") else t for t in texts]
                numbers, records, heads = [], [], []
                for text, goes_on in zip(texts, starts_inside.tolist()):
                    if goes_on and held is not None:
                        held[1].append(text)
                        continue
                    if held is not None:
                        numbers.append(held[0])
                        records.append("\n".join(held[1]))
                        heads.append(held[2])
                        held = None
                    if goes_on:
                        held = (None, [text], True)
                    elif header and text not in ("", "\r"):
                        held, header = (HEADER, [text], False), False
                    elif text not in ("", "\r"):
                        held, number = (number, [text], False), number + 1
                inside = ends_inside
                yield rows(numbers, records, heads)
        yield from last_of_range()

    return lines.mapInArrow(cut, f"{RANGE[0]} string, {RANGE[1]} long, row_id long, record string, head boolean, tail boolean")


def read_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """The records of CSV files as text: ``row_id, record``. Numbers are dense, by file path and place; header records have ``HEADER``.

    Every task reads one byte range of a file; empty lines are skipped. The driver holds one small row per range. A header stands in its
    file's first range. Numbers follow from the files alone, whatever the ranges, so nothing has to be stored to keep them.
    """
    ship_package(spark)
    lines = _lines(spark, path, sep)
    starts = {(r[0], r[1]): (r["inside"], r["crlf"], r["first"]) for r in range_starts(range_maps(lines)).collect()}
    cut = _records(lines, starts)
    if not any(inside for inside, _, _ in starts.values()):  # no record crosses a border; the last one of a file may be open
        return cut.select("row_id", "record")
    # A fragment that does not end an earlier record begins a new one; those behind it go on with it.
    fragments = cut.filter(F.col("head") | F.col("tail"))
    so_far = Window.partitionBy(RANGE[0]).orderBy(RANGE[1], ~F.col("head"))
    begun = fragments.withColumn("number", F.sum((~F.col("head")).cast("int")).over(so_far))
    part = F.struct(RANGE[1], (~F.col("head")).alias("later"), "row_id", "record")
    joined = begun.groupBy(RANGE[0], "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # the parts of one record
    stitched = joined.select(F.element_at("parts", 1)["row_id"].alias("row_id"), F.array_join(F.col("parts.record"), "\n").alias("record"))
    return cut.filter(~F.col("head") & ~F.col("tail")).select("row_id", "record").unionByName(stitched)


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Rows as strings, named ``columns``, with a dense ``row_id``; the rows that Spark's multi-line reader gives for the same files.

    Each file's header has to be ``columns``, where Spark's own names for empty and repeated header cells count as these.
    """
    names = [f"c{i}" for i in range(len(columns))]
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"sep": sep, "quote": '"', "escape": '"'})
    parsed = read_records(spark, path, sep).select("row_id", cells.alias("cells"))
    same = F.lit(True)
    for i, (name, column) in enumerate(zip(names, columns)):
        cell = F.regexp_replace(F.coalesce(F.col("cells")[name], F.lit("")), "^\ufeff", "")
        same = same & (cell.isin(column, column.removesuffix(str(i))) | ((cell == "") & F.lit(column == f"_c{i}")))
    differs = F.raise_error(F.lit(f"a file's header is not {list(columns)}")).isNull()
    rows = parsed.filter(F.when(F.col("row_id") != HEADER, F.lit(True)).when(same, F.lit(False)).otherwise(differs))
    return rows.select("row_id", *[F.col("cells")[n].alias(c) for n, c in zip(names, columns)])
