"""Dense row numbers and positional slices of a large table, without a single-partition sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import broadcast_if_small, durable

# monotonically_increasing_id keeps the partition number above this many bits of row number.
_ROW_BITS = 33

# A numeric range holding at most this many rows is sorted directly.
_DIRECT_ROWS = 100_000
_BINS = 1024


def number_in_order(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Add a dense 0-based ``name`` following ``order``, which must identify rows.

    One range-partitioned sort, materialised so that partitions keep their rows; then per-partition counts
    give each partition its first number. Only that small table (one row per partition) is summed and
    broadcast.
    """
    ordered = durable(df.orderBy(*order)).withColumn("_tl_seen", F.monotonically_increasing_id())
    partition = F.shiftright("_tl_seen", _ROW_BITS)
    before = Window.orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy(partition.alias("_tl_part"))
        .agg(F.count("*").alias("_tl_n"))
        .select("_tl_part", F.coalesce(F.sum("_tl_n").over(before), F.lit(0)).alias("_tl_start"))
    )
    row = F.col("_tl_seen").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        ordered.withColumn("_tl_part", partition)
        .join(broadcast_if_small(starts), "_tl_part")
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_tl_start") + row).alias(name))
    )


def number_in_file_order(df: DataFrame, file: str, block: str, seen: str, name: str = "row_id") -> DataFrame:
    """Add a dense 0-based ``name`` following (file path, block start, row), without moving the rows.

    Rows of one file block are contiguous in the task that read them, so a block's first ``seen`` value and
    row count are enough. The rows are materialised first: a second scan may cut files into other blocks.
    """
    placed = durable(df)
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(file, block)
        .agg(F.count("*").alias("_tl_n"), F.min(seen).alias("_tl_first"))
        .select(file, block, "_tl_first", F.coalesce(F.sum("_tl_n").over(before), F.lit(0)).alias("_tl_start"))
    )
    kept = [c for c in df.columns if c not in (file, block, seen)]
    return placed.join(broadcast_if_small(starts), [file, block]).select(
        (F.col("_tl_start") + F.col(seen) - F.col("_tl_first")).alias(name), *[F.col("`" + c.replace("`", "``") + "`") for c in kept]
    )


def slice_by_position(df: DataFrame, key: str, start: int | Callable[[int], int], length: int) -> DataFrame:
    """Rows ``[start, start + length)`` in order of the unique integer column ``key``; ``start`` may be a
    function of the row count.

    Dense keys become a plain range filter. Otherwise counts over equal sub-ranges narrow the key range until
    few rows are left to sort, each round a scan of ``key`` alone with the range pushed down.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    start = start(rows) if callable(start) else start
    if start >= rows:
        return df.limit(0)
    stop = min(start + length, rows)
    if high - low + 1 == rows:
        return df.filter(F.col(key).between(low + start, low + stop - 1))
    first, last = _key_at(df, key, low, high, rows, start), _key_at(df, key, low, high, rows, stop - 1)
    return df.filter(F.col(key).between(first, last))


def _key_at(df: DataFrame, key: str, low: int, high: int, rows: int, position: int) -> int:
    while rows > _DIRECT_ROWS and high > low:
        width = (high - low) // _BINS + 1
        bins = (
            df.filter(F.col(key).between(low, high))
            .groupBy(F.expr(f"(cast(`{key}` as decimal(20,0)) - ({low})) div {width}").alias("bin"))
            .count()
            .orderBy("bin")
            .collect()
        )  # at most _BINS + 1 rows
        for bin_row in bins:
            if position < bin_row["count"]:
                low, rows = low + bin_row["bin"] * width, bin_row["count"]
                high = min(high, low + width - 1)
                break
            position -= bin_row["count"]
    inside = df.filter(F.col(key).between(low, high)).select(key)
    return inside.orderBy(key).limit(position + 1).agg(F.max(key)).first()[0]
