import collections
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import sharding as S


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = S.shard_records(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) < 650 and min(counts.values()) > 370
    assert 350 < sum(r.grown_shard == 40 for r in rows) < 650
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_weights_give_shares_and_move_keys_only_to_the_heavier(spark):
    keys = spark.range(30_000)
    rows = keys.select(S.rendezvous(F.col("id"), [1, 1, 2]).alias("a"), S.rendezvous(F.col("id"), [1, 1, 4]).alias("b")).collect()
    counts = collections.Counter(r.a for r in rows)
    assert abs(counts[2] - 15_000) < 500 and abs(counts[0] - 7_500) < 400
    assert all(r.b in (r.a, 2) for r in rows)
    with pytest.raises(ValueError):
        S.rendezvous(F.lit(1), [1, 0])


def test_shards_depend_on_the_key_alone(spark, odd, nothing):
    rows = S.shard_records(odd).collect()
    assert len(rows) == odd.count()
    alone = {r.doc_id: r.shard for r in S.shard_records(odd.select("doc_id", F.lit(None).cast("string").alias("text"))).collect()}
    texts = dict(odd.select("doc_id", "text").collect())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(raw) + 16, zlib.crc32(raw), "key", alone[r.doc_id])
    for shard in {r.shard for r in rows}:
        slots = [r.slot for r in rows if r.shard == shard]
        assert sorted(slots) == list(range(len(slots)))
    assert S.shard_records(nothing).count() == 0


def test_many_rows_of_one_key_have_slots_of_their_own(spark):
    rows = S.shard_records(spark.range(5_000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(5_000))


def test_no_python_in_the_plan(odd):
    plan = S.shard_records(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_whole_query_against_draws_made_one_by_one(spark):
    """Every key's 41 draws, its shard, its shard with one more, and its slot, from the hash function's own library."""
    import math
    import struct
    import zlib

    import xxhash

    from textloom.llm.queries import op9_shard

    def draw(key, shard):
        seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest() >> 12
        return -math.log((bits + 0.5) / float(1 << 52))

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    expected, members = {}, {}
    for key in sorted(texts):
        draws = [(draw(key, s), s) for s in range(41)]
        shard, grown = min(draws[:40])[1], min(draws)[1]
        members.setdefault(shard, []).append(key)
        expected[key] = (len(texts[key]) + 16, zlib.crc32(texts[key]), "key", shard, len(members[shard]) - 1, grown)
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in op9_shard(spark, folder).collect()}
    assert got == expected
