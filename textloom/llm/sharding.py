"""Op 9: weighted rendezvous sharding of records, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import quoted
from textloom.operators.numbering import number_in_order

# Hash values are cut to as many bits before they become a double, so that the fraction below is exact.
_BITS = 52


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: each shard draws ``-ln(u) / weight`` with ``u`` from a hash of key and shard, the least wins.

    A shard's draw depends on nothing but the key, its own number and its own weight. So one more shard takes keys
    only into itself, and a changed weight moves keys only to or from its shard. The share of a shard follows its
    weight. A null key is one key of its own. Ties go to the lower shard number.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 64 - _BITS)
        return F.struct((-F.log((bits + 0.5) / float(1 << _BITS)) / weight).alias("draw"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[draw(i, w) for i, w in enumerate(weights)])).getField("shard")


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40, extra_weight: float = 1.0) -> DataFrame:
    """Per row: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    Sizes are UTF-8 bytes plus 16; a null text has no bytes. Slots number the rows of each shard from 0 without gaps, in key
    order. Repeated rows keep a slot each; equal keys share a shard. An empty table gives no rows. Other columns are ignored.

    Only the narrow result rows are sorted, by shard, key and a row number, so a shard spreads over many tasks and so does a
    key that many rows share.
    """
    payload = F.encode(F.coalesce(quoted(text), F.lit("")), "UTF-8")
    narrow = df.select(
        quoted(key).alias("key"),
        (F.octet_length(payload) + 16).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seen"),
    ).select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        rendezvous(F.col("key"), [*weights, extra_weight]).alias("grown_shard"),
    )
    numbered = number_in_order(narrow, ["shard", "key", "text_crc32", "seen"], "place")
    firsts = numbered.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.col("first")).alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
