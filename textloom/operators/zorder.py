"""Rows close in several numbers stored close to each other, by interleaving the bits of the numbers' ranks.

A range of any of the numbers, or of several, then falls into few row groups, whose bounds let a scan skip the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.binding import bind, quoted

# Bits of a number's rank: it is told apart from about 2 ** RANK_BITS - 1 quantiles.
RANK_BITS = 8


def quantile_cuts(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS) -> dict[str, list[float]]:
    """The quantiles that part each column's numbers into about equal shares; nulls are left out."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(quoted(c).cast("double"), shares, 10_000) for c in columns]).first()
    return {c: sorted(set(cuts or ())) for c, cuts in zip(columns, found)}


def rank(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ``cuts`` are not above ``value``; a null ranks below all."""
    if not cuts:
        return F.lit(0)
    numbers = F.array(*[F.lit(float(c)) for c in cuts])
    return F.coalesce(F.size(F.filter(numbers, lambda c: c <= value)), F.lit(0))


def z_value(columns: Sequence[str], cuts: Mapping[str, Sequence[float]], bits: int = RANK_BITS) -> Column:
    """The interleaved bits of the columns' ranks, highest bits first."""

    def interleaved(place: int) -> Callable[[Column], Column]:
        first = len(columns) - 1 - place
        return lambda own: reduce(add, [F.shiftleft(F.shiftright(own, bit).bitwiseAND(1), bit * len(columns) + first) for bit in range(bits)])

    ranks = [rank(quoted(c).cast("double"), cuts[c]).cast("long") for c in columns]
    return reduce(add, [bind(own, interleaved(place)) for place, own in enumerate(ranks)])


def cluster_by_numbers(df: DataFrame, columns: Sequence[str], files: int | None = None, bits: int = RANK_BITS) -> DataFrame:
    """``df`` range-partitioned and sorted by the Z value of numeric columns: one scan for the quantiles, one shuffle of the rows.

    With ``files``, into as many partitions; else as many as Spark finds fit. Rows of one Z value can fill several partitions, as the rows'
    hash takes part in the order.
    """
    if not 1 <= len(columns) <= 63 // bits:
        raise ValueError(f"cluster by 1 to {63 // bits} columns")
    placed = df.withColumn("_tl_z", z_value(columns, quantile_cuts(df, columns, bits), bits))
    order = ["_tl_z", F.xxhash64(*[quoted(c) for c in df.columns if c in columns or c in ("doc_id", "chunk_ix")])]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    return ranged.sortWithinPartitions("_tl_z").drop("_tl_z")
