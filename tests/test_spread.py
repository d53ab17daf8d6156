"""CPU-heavy work runs in tasks of bounded size, and once for each row."""

import hashlib

import pytest

from textloom import session
from textloom.functions.text import token_count
from textloom.operators import chunking as C
from textloom.operators import embedding as E
from textloom.plans import corpus as plans
from textloom.plans.corpus import Corpus, IngestConfig


def documents(spark, n):
    rows = [(i, "text", {"number": str(i)}, f"Words of {hashlib.md5(str(i).encode()).hexdigest()}. " * 5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text_column string, metadata map<string,string>, text string")


def test_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one-row-group")
    documents(spark, 4000).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "one-row-group").glob("*.parquet"))
    monkeypatch.setattr(session, "SPREAD_BYTES", size // 40)
    chunks = plans.documents_to_chunks(spark.read.parquet(path), IngestConfig(chunk_size=20, chunk_overlap=0))
    assert chunks.rdd.getNumPartitions() >= 40


def test_clustered_chunks_are_made_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    chunks = plans.documents_to_chunks
    monkeypatch.setattr(plans, "documents_to_chunks", lambda *a: chunks(*a).withColumn("text", seen.asNondeterministic()("text")))
    corpus = Corpus(spark, str(tmp_path / "store"))
    config = IngestConfig(chunk_size=20, chunk_overlap=0, embedder="mock", filter_columns=("number",), cluster_columns=("number",))
    set_id = corpus.ingest_documents(documents(spark, 50), "clustered", config)
    assert made.value == corpus.store.open_chunks(set_id).count()


@pytest.mark.parametrize("counts", [1, 7, 1 << 20])
def test_hashed_vectors_in_steps(spark, monkeypatch, counts):
    monkeypatch.setattr(E, "_COUNTS", counts)
    texts = ["a b a", None, "", "漢字 😀 é b", "x" * 60] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    tokens = [None if t is None else {"a b a": ["a", "b", "a"], "": [], "x" * 60: ["x" * 24, "x" * 24, "x" * 12]}.get(t, t.split()) for t in texts]
    for row, held in zip(E.embed(rows, E.hash_embedder(5)).orderBy("i").collect(), tokens):
        expected = [0.0] * 5
        for t in held or ():
            expected[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5] += 1
        assert row["embedding"] == (None if held is None else expected)


def test_long_texts_are_cut_as_by_full_counts(spark):
    texts = ["a" * 5000, "a b " * 900, " " * 3000 + "a b c. " * 3, "é😀 " * 700, "\n\n\n".join(["x y z. " * 40] * 3), ("y" * 23 + " ") * 50, "; , " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quick, full = (sorted(map(tuple, C.chunk_documents(rows, 10, 3, count=count).collect())) for count in (token_count, lambda c: token_count(c)))
    assert quick == full
