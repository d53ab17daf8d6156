"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` reaches, nodes without an edge left out.

    Every step is a join and an aggregation over edges; each round is stored, so its lineage stays short. A node with very many
    neighbours is aggregated before the shuffle and its join can be split.
    """
    pairs = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low").distinct()
    pairs = written(pairs, "component-edges")
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = pairs.union(pairs.select("low", "high")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        floor = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(floor, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        pairs = written(small.union(floor.select("high", F.col("m").alias("low"))).distinct(), "component-edges")
    ends = pairs.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return ends.union(pairs.select("low", "low")).distinct()
