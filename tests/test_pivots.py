import numpy as np
import pytest

from textloom.operators import pivots as P
from textloom.operators.embedding import with_norm
from textloom.operators.retrieval import search
from textloom.plans.corpus import Corpus, IngestConfig


def gathered(spark, n=3000, dimension=8, seed=0):
    """Vectors around a few directions, some equal, zero, null or no numbers."""
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((12, dimension)) * 4
    matrix = middles[draw.integers(0, 12, n)] + draw.standard_normal((n, dimension))
    matrix[5:25] = matrix[4]
    rows = [(i, int(i % 7), [float(x) for x in v]) for i, v in enumerate(matrix)]
    rows += [(n, 1, [0.0] * dimension), (n + 1, 1, None), (n + 2, 2, [float("nan")] * dimension), (n + 3, 3, [0.0] * dimension)]
    return spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>").repartition(5), middles


def same(index, plain, query, **how):
    got = [tuple(r) for r in P.search_index(index, query, id_cols=("vec_id",), **how).select("rank", "vec_id", "score", "has_more").orderBy("rank").collect()]
    expected = search(plain, query, id_cols=("vec_id",), **how).select("rank", "vec_id", "score", "has_more").orderBy("rank").collect()
    assert got == [tuple(r) for r in expected]
    return got


def test_pages_equal_those_of_a_scan(spark, tmp_path):
    plain, middles = gathered(spark)
    index = P.build_index(with_norm(plain), str(tmp_path / "index"))
    draw = np.random.default_rng(3)
    for how in ({"n": 10}, {"n": 5, "offset": 18}, {"n": 4, "filters": [("label", "in", [1, 3])]}, {"n": 3, "filters": [("label", "==", 99)]}):
        for query in (middles[2], draw.standard_normal(8), -middles[5]):
            same(index, plain, [float(x) for x in query], **how)
    some = plain.filter("vec_id = 4").first().embedding
    assert [r[1] for r in same(index, plain, some, n=30)][:21] == list(range(4, 25))  # ties by id
    same(index, plain, [0.0] * 8, n=10)
    assert len(same(index, plain, [float(x) for x in middles[0]], n=5000)) == 3002
    with pytest.raises(ValueError, match="dimension"):
        P.search_index(index, [1.0, 2.0], id_cols=("vec_id",))


def test_scores_below_zero_and_tiny_tables(spark, tmp_path):
    rows = [(i, 0, [-1.0 - i, 0.5 * i]) for i in range(3)] + [(7, 0, [0.0, 0.0])]
    plain = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>")
    index = P.build_index(plain, str(tmp_path / "index"))
    for n in (1, 2, 3, 9):
        same(index, plain, [1.0, 0.0], n=n)
    empty = P.build_index(plain.limit(0), str(tmp_path / "none"))
    assert P.search_index(empty, [1.0, 0.0], id_cols=("vec_id",)).count() == 0


def test_what_is_skipped(spark, tmp_path):
    """Gathered vectors are mostly skipped, those without any structure are not; the figures are in the README."""
    plain, middles = gathered(spark, n=6000)
    index = P.build_index(plain, str(tmp_path / "index"))
    assert P.skipped(index, [float(x) for x in middles[1]], 10, ("vec_id",)) > 0.5
    plan = P._in_clusters(index.rows, P._clusters(index.clusters, list(middles[1]))[:3], 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "In(pivot" in plan and "GreaterThanOrEqual(angle" in plan


def test_clusters_hold_every_row_once(spark, tmp_path):
    plain, _ = gathered(spark)
    index = P.build_index(plain, str(tmp_path / "index"))
    assert index.rows.count() == plain.count() and index.rows.select("vec_id").distinct().count() == plain.count()
    assert index.rows.filter("pivot = -1").count() == 4 and index.clusters.agg({"rows": "sum"}).first()[0] == plain.count()
    for r in index.rows.groupBy("pivot").agg({"angle": "min", "*": "count"}).join(index.clusters, "pivot").collect():
        assert r["count(1)"] == r["rows"] and r["min(angle)"] == r["least"]


def test_an_indexed_set_answers_as_before_and_takes_changes(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "store"))
    schema = "doc_id long, text_column string, text string, metadata map<string,string>"

    def documents(numbers, word):
        return spark.createDataFrame([(i, "text", f"{word}{i % 5} apple text {i}", {"k": str(i % 3)}) for i in numbers], schema)

    set_id = corpus.ingest_documents(documents(range(60), "old"), "s", IngestConfig(filter_columns=("k",)))
    asked = [("old3 apple", {}), ("text 7", {"n": 4, "offset": 3}), ("old1", {"filters": [("k", "==", "2")]})]

    def answers():
        return [[tuple(r[c] for c in ("rank", "text", "score", "has_more")) for r in corpus.search(set_id, q, **how).collect()] for q, how in asked]

    before = answers()
    corpus.build_index(set_id)
    assert answers() == before and corpus.store.open_documents(set_id).count() == 60
    corpus.upsert_documents(set_id, documents(range(55, 65), "new"))
    changed = answers()
    assert corpus.store.require_set(set_id)["folders"][0].startswith("pivots-") and len(corpus.store.require_set(set_id)["folders"]) == 2
    corpus.build_index(set_id)
    assert answers() == changed and corpus.search(set_id, "new2 apple text 62", n=1).first()["source_doc_id"] == 62
