import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import retrieval as R
from textloom.operators.embedding import with_norm

SCHEMA = "doc_id long, chunk_ix int, text string, metadata map<string,string>, embedding array<float>"


def cosine(a, b):
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / (la * lb), 10) if la and lb else 0.0


def make(spark, n=60, dimension=4, seed=3):
    rng = random.Random(seed)
    rows = [
        (i // 3, i % 3, f"t{i}", {"parity": "even" if i % 2 == 0 else "odd"}, [float(rng.randrange(-2, 3)) for _ in range(dimension)])
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def ranking(rows, query):
    scored = [(-cosine(r[4], query), r[0], r[1]) for r in rows]
    return [(d, c, -s) for s, d, c in sorted(scored)]


def page(df, *args, **kwargs):
    out = R.search(df, *args, **kwargs).orderBy("rank").collect()
    return [(r["doc_id"], r["chunk_ix"], r["score"]) for r in out], [r["has_more"] for r in out], [r["rank"] for r in out]


def test_pages_cover_the_ranking_without_overlap(spark):
    rows, df = make(spark)
    query, expected, seen = [1.0, -1.0, 0.5, 2.0], None, []
    expected = ranking(rows, query)
    for offset in range(0, 60, 25):
        got, more, ranks = page(df, query, 25, offset=offset)
        assert set(more) == {offset + 25 < 60}
        assert ranks == list(range(offset + 1, offset + 1 + len(got)))
        seen += got
    assert seen == expected


@pytest.mark.parametrize("deep", [False, True])
def test_bounds_of_n_and_offset(spark, monkeypatch, deep):
    if deep:
        monkeypatch.setattr(R, "DEEP_PAGE", 0)
    rows, df = make(spark)
    query = [1.0, 0.0, 0.0, 0.0]
    expected = ranking(rows, query)
    assert page(df, query, 0)[0] == expected[:1]
    assert page(df, query, 3, offset=-5)[0] == expected[:3]
    got, more, _ = page(df, query, 10, offset=50)
    assert got == expected[50:] and set(more) == {False}
    got, more, _ = page(df, query, 9, offset=50)
    assert got == expected[50:59] and set(more) == {True}
    assert page(df, query, 5, offset=60)[0] == []
    assert page(df.limit(0), query, 5)[0] == []


def test_filters_apply_before_ranking(spark):
    rows, df = make(spark)
    query = [0.0, 1.0, 1.0, 0.0]
    odd = [r for r in rows if r[3]["parity"] == "odd"]
    assert page(df, query, 7, [("parity", "==", "odd")])[0] == ranking(odd, query)[:7]


def test_stored_norms_and_zero_vectors(spark):
    rows, df = make(spark)
    for query in ([1.0, 2.0, 3.0, 4.0], [0.0] * 4):
        expected = {(r[0], r[1]): cosine(r[4], query) for r in rows}
        for scored in (R.with_score(df, query), R.with_score(with_norm(df), query)):
            assert {(r["doc_id"], r["chunk_ix"]): r["score"] for r in scored.collect()} == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("dimension", [4, 64, 127, 128])
@pytest.mark.parametrize("stored", [False, True])
def test_one_rule_at_every_width(spark, dimension, stored):
    rows, df = make(spark, n=20, dimension=dimension)
    query = [float((i * 7) % 5 - 2) for i in range(dimension)]
    holes = df.withColumn("embedding", F.when(F.col("text") != "t5", F.col("embedding")))
    broken = F.transform("embedding", lambda x: F.lit(float("nan")).cast(df.schema["embedding"].dataType.elementType))
    holes = holes.withColumn("embedding", F.when(F.col("text") == "t6", broken).otherwise(F.col("embedding")))
    holes = with_norm(holes) if stored else holes
    expected = {r[2]: cosine(r[4], query) for r in rows if r[2] not in ("t5", "t6")}
    got = {r["text"]: r["score"] for r in R.with_score(holes, query).collect()}
    assert got.pop("t5") is None and got.pop("t6") is None and got == pytest.approx(expected, abs=1e-9)
    single = [(r["doc_id"], r["chunk_ix"]) for r in R.search(holes, query, 100).orderBy("rank").collect()]
    batch = R.search_batch(holes, spark.createDataFrame([(1, query)], "query_id int, embedding array<double>"), 100)
    assert single == [(r["doc_id"], r["chunk_ix"]) for r in batch.orderBy("rank").collect()] and len(single) == 18
    with pytest.raises(Exception, match="dimension"):
        R.search(df, query[:-1], 3).collect()
    with pytest.raises(Exception, match="dimension"):
        R.search_batch(df, spark.createDataFrame([(1, query[:-1])], "query_id int, embedding array<double>"), 3).collect()


def test_hits_and_sources(spark):
    rows, df = make(spark, n=6)
    hits = R.hits(R.search(df, [1.0, 1.0, 1.0, 1.0], 2)).collect()
    assert set(hits[0].asDict()) == {"rank", "text", "score", "metadata", "source_doc_id", "has_more"}
    null_score = spark.createDataFrame([(1, "t", None, {}, 1, False)], "rank long, text string, score double, metadata map<string,string>, doc_id long, has_more boolean")
    assert R.hits(null_score).first()["score"] == 0.0
    docs = spark.createDataFrame([(0, "doc zero"), (1, "doc one")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0), (2, None), (3, 1), (4, 9)], "rank int, doc_id long")
    got = {r["rank"]: r["source_text"] for r in R.attach_source(found, docs).collect()}
    assert got == {1: "doc zero", 2: None, 3: "doc one", 4: None}


@pytest.mark.parametrize("limits", [{}, {"query_bytes": 4 * 8 * 5}, {"query_bytes": 0}])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_batch_search_equals_single_searches(spark, limits, k):
    n = 12 if limits.get("query_bytes") == 0 else 60
    rows, df = make(spark, n=n)
    rng = random.Random(5)
    queries = [(f"q{i}", [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(min(17, n // 3))] + [("zero", [0.0] * 4)]
    query_df = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    out = R.search_batch(df.repartition(5), query_df, k, **limits).collect()
    for name, vector in queries:
        mine = sorted((r for r in out if r["query_id"] == name), key=lambda r: r["rank"])
        assert [(r["doc_id"], r["chunk_ix"], r["score"]) for r in mine] == ranking(rows, vector)[:k]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_batch_search_skips_null_vectors_and_survives_no_queries(spark):
    _, df = make(spark, n=9)
    holes = df.withColumn("embedding", F.when(F.col("chunk_ix") != 1, F.col("embedding")))
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    for limits in ({}, {"query_bytes": 0}):
        out = R.search_batch(holes, queries, 100, **limits)
        assert sorted({r["chunk_ix"] for r in out.collect()}) == [0, 2] and out.count() == 6
    assert R.search_batch(df, queries.limit(0), 3).count() == 0


def test_batch_pages(spark):
    _, df = make(spark)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = R.page_of_batch(R.search_batch(df, queries, 5 + 3 + 1), 5, 3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, r) for q in (1, 2) for r in range(4, 9)]
    assert all(r["has_more"] for r in got)


def test_top_k_is_one_bounded_step(spark):
    _, df = make(spark)
    plan = R.search(df, [1.0, 0, 0, 0], 5, offset=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=8" in plan
