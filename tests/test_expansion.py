import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.chunking import chunk_documents
from textloom.operators.expansion import chunk_and_expand, expand_neighbors

SCHEMA = "doc_id long, chunk_ix int, text string, n_tokens int, metadata map<string,string>"


def expanded(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, {"doc": str(r[0])}) for r in rows], SCHEMA)
    out = expand_neighbors(df, **{"max_tokens": 100, **kwargs}).collect()
    return sorted(out, key=lambda r: (r["metadata"]["doc"], r["chunk_ix"], r["variant"]))


def texts(rows):
    return [r["text"] for r in rows]


def test_three_chunks(spark):
    rows = expanded(spark, [(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 1)])
    assert texts(rows) == ["a", "a b", "b", "b c", "a b c", "c"]
    assert [r["is_expanded"] for r in rows] == [False, True, False, True, True, False]
    assert rows[1]["metadata"] == {"doc": "1", "isExpanded": "true"} and rows[0]["metadata"] == {"doc": "1"}
    assert rows[4]["n_tokens"] == 3 and rows[4]["doc_id"] == 1


def test_long_chunk_stays_alone(spark):
    rows = expanded(spark, [(1, 0, "a", 1), (1, 1, "b", 101), (1, 2, "c", 1)])
    assert texts(rows) == ["a", "a b", "b", "c"]
    assert rows[2]["n_tokens"] == 101


def test_scopes(spark):
    pair = [(1, 0, "d1", 1), (2, 0, "d2", 1)]
    assert texts(expanded(spark, pair)) == ["d1", "d2"]
    rows = expanded(spark, pair, scope="corpus")
    assert texts(rows) == ["d1", "d1 d2", "d2"]
    assert [r["doc_id"] for r in rows] == [1, None, 2]
    with pytest.raises(ValueError, match="scope"):
        expanded(spark, pair, scope="page")


@pytest.mark.parametrize("scope", ["document", "corpus"])
@pytest.mark.parametrize("bucket_rows", [1, 2, 3, 1000])
def test_small_buckets_change_nothing(spark, scope, bucket_rows):
    rng = random.Random(7)
    rows = [(d, i, f"t{d}.{i}", rng.choice([1, 200])) for d in range(5) for i in range(rng.randrange(1, 9))]
    expected = []
    for at, (d, i, t, n) in enumerate(rows):
        prev = rows[at - 1] if at and (scope == "corpus" or rows[at - 1][0] == d) else None
        nxt = rows[at + 1] if at + 1 < len(rows) and (scope == "corpus" or rows[at + 1][0] == d) else None
        expected.append(t)
        if n <= 100 and nxt:
            expected.append(f"{t} {nxt[2]}")
            if prev:
                expected.append(f"{prev[2]} {t} {nxt[2]}")
    assert texts(expanded(spark, rows, scope=scope, bucket_rows=bucket_rows)) == expected


def test_no_window_spans_a_whole_document(spark):
    df = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_ix"), F.lit("x").alias("text"))
    grown = expand_neighbors(df, bucket_rows=10)
    assert grown.count() == 50 + 49 + 48
    assert "_tl_bucket" in grown._jdf.queryExecution().executedPlan().toString()


def test_one_step_equals_two(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(99)}" + rng.choice(["", "."]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, {"k": "v"}, t) for i, t in enumerate(texts)], "doc_id long, metadata map<string,string>, text string")
    two = expand_neighbors(chunk_documents(df, 12, 3), 8)
    one = chunk_and_expand(df, 12, 3, 8)

    def rows(grown):
        return sorted((r["doc_id"], r["chunk_ix"], r["variant"], r["text"], r["n_tokens"], r["is_expanded"], sorted(r["metadata"].items())) for r in grown.collect())

    assert rows(one) == rows(two) and set(one.columns) == set(two.columns)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
