import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from textloom.errors import UnknownEmbedderError
from textloom.operators import embedding as E

TEXTS = ["the cat sat on the mat", "", "a b c a b c a", "naïve! ???", None]


def counted(text, dimension):
    vector = [0.0] * dimension
    for token in re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text):
        vector[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension] += 1
    return vector


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("dimension", [1, 4, 64])
def test_hash_embedder_counts_tokens(texts, dimension):
    rows = E.embed(texts, E.hash_embedder(dimension)).orderBy("doc_id").collect()
    for row in rows[:4]:
        expected = counted(row["text"], dimension)
        assert row["embedding"] == expected
        assert row["norm"] == pytest.approx(math.sqrt(sum(x * x for x in expected)))
    assert rows[4]["embedding"] is None


def test_query_vector_equals_column_vector(spark, texts):
    embedder = E.hash_embedder(8)
    stored = E.embed(texts, embedder).filter("doc_id = 0").first()["embedding"]
    assert embedder.embed_query(spark, TEXTS[0]) == stored


def test_mock_embedder(texts):
    assert {tuple(r["embedding"]) for r in E.embed(texts, E.mock_embedder()).collect()} == {(1, 0, 0, 0, 0, 0)}


def test_function_embedder_batches_texts(spark):
    def model(batch):
        return [[len(t), len(batch)] for t in batch]

    df = spark.range(0, 130, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    rows = E.embed(df, E.function_embedder("lengths", 2, model)).collect()
    assert all(r["embedding"][0] == r["doc_id"] % 7 for r in rows)
    assert sorted({r["embedding"][1] for r in rows}) == [30, 50]


def test_registry(spark):
    registry = E.EmbedderRegistry({"mine": E.hash_embedder(3)})
    assert registry.get("mine").dimension == 3 and registry.get("mock").dimension == 6
    with pytest.raises(UnknownEmbedderError, match="nobody"):
        registry.get("nobody")


def test_embed_input_hides_metadata(spark):
    df = spark.createDataFrame([(1, 0, "t", {"k": "v"})], "doc_id long, chunk_ix int, text string, metadata map<string,string>")
    assert E.embed_input(df).columns == ["doc_id", "chunk_ix", "text"]


def test_dimension_check(spark):
    rows = [("mistral-embed", 1024), ("mistral-embed", 5), ("other", 1536), ("other", 1024), ("mistral-embed", None)]
    df = spark.createDataFrame(rows, "model string, n int").withColumn(
        "embedding", F.when(F.col("n").isNotNull(), F.array_repeat(F.lit(1.0), F.col("n")))
    )
    wrong = E.check_dimensions(df).select("model", "n", "expected").collect()
    assert sorted((r["model"], r["n"] or 0, r["expected"]) for r in wrong) == [
        ("mistral-embed", 0, 1024), ("mistral-embed", 5, 1024), ("other", 1024, 1536),
    ]
