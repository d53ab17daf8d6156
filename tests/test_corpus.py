import datetime

import pytest
from pyspark.sql import functions as F

from textloom.errors import DocumentNotFoundError, EmptyCorpusError, IdentityError, SetNotFoundError, UnknownEmbedderError
from textloom.operators import catalog, stats
from textloom.operators.embedding import EmbedderRegistry, function_embedder
from textloom.plans.corpus import Corpus, IngestConfig, preview, rank_chunks
from textloom.streaming.append import append_batch, ingest_stream, stream_csv, stream_documents

CONFIG = IngestConfig(text_columns=("text",), chunk_size=50, chunk_overlap=10, filter_columns=("note",))


@pytest.fixture()
def corpus(spark, tmp_path):
    return Corpus(spark, str(tmp_path / "store"))


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ingest_search_fetch_list_delete(corpus, tmp_path):
    path = write(tmp_path / "a.csv", "text,note\nred apples and pears,n1\nblue sky. green grass,n2\n,n3\n")
    first = corpus.ingest_csv(path, "fruit & sky", CONFIG)
    second = corpus.ingest_csv(path, "again", CONFIG)
    assert (first, second) == (1, 2)
    hits = corpus.search(first, "red pears", n=1).collect()
    assert [h["text"] for h in hits] == ["red apples and pears"] and hits[0]["has_more"] and hits[0]["source_doc_id"] == 0
    assert hits[0]["metadata"] == {"note": "n1"}
    assert [h["text"] for h in corpus.search(first, "red", filters=[("note", "==", "n2")]).collect()] == ["blue sky. green grass"]
    assert corpus.search_with_sources(first, "sky", n=1).first()["document_text"] == "blue sky. green grass"
    assert corpus.store.open_documents(first).count() == 3
    assert [r["text"] for r in corpus.get_documents(first, [0]).collect()] == ["red apples and pears"]
    with pytest.raises(DocumentNotFoundError, match="99"):
        corpus.get_documents(first, [0, 99])

    listed = corpus.list_sets(page=1, page_size=1).collect()
    assert [(r["set_id"], r["name"], r["total_documents"], r["total"]) for r in listed] == [(2, "again", 3, 2)]
    assert listed[0]["parameters"]["chunk_size"] == "50"
    assert corpus.delete_set(first) and not corpus.delete_set(first)
    assert [r["set_id"] for r in corpus.list_sets().collect()] == [2]
    assert corpus.store.open_chunks(second).count() == 2
    for use in (corpus.store.open_chunks, lambda s: corpus.search(s, "x")):
        with pytest.raises(SetNotFoundError):
            use(first)
    assert corpus.ingest_csv(path, "third", CONFIG) == 3


def test_failures_leave_no_set(corpus, tmp_path):
    empty = write(tmp_path / "e.csv", "text,note\n")
    with pytest.raises(EmptyCorpusError):
        corpus.ingest_csv(empty, "none", CONFIG)
    with pytest.raises(UnknownEmbedderError):
        corpus.ingest_csv(write(tmp_path / "a.csv", "text,note\na,b\n"), "x", IngestConfig(embedder="nobody"))
    with pytest.raises(ValueError):
        corpus.ingest_csv(str(tmp_path / "a.csv"), "x", IngestConfig(chunk_size=0))
    assert corpus.list_sets().count() == 0


def test_expansion_flag(corpus, spark):
    docs = spark.createDataFrame([(0, "text", "One two. Three four. Five six.", {})], "doc_id long, text_column string, text string, metadata map<string,string>")
    plain = IngestConfig(chunk_size=4, chunk_overlap=0)
    grown = IngestConfig(chunk_size=4, chunk_overlap=0, expand=True)
    texts = [sorted(r["text"] for r in corpus.store.open_chunks(corpus.ingest_documents(docs, "s", c)).collect()) for c in (plain, grown)]
    assert texts[0] == ["Five six.", "One two.", "Three four."]
    assert texts[1] == sorted([*texts[0], "One two. Three four.", "Three four. Five six.", "One two. Three four. Five six."])


def test_upsert(corpus, spark, tmp_path):
    set_id = corpus.ingest_csv(write(tmp_path / "a.csv", "text,note\nold zero,a\nold one,b\n"), "s", CONFIG)
    schema = "doc_id long, text_column string, text string, metadata map<string,string>"
    new = spark.createDataFrame([(1, "text", "new one", {"note": "c"}), (7, "text", "new seven", {"note": "d"})], schema)
    corpus.upsert_documents(set_id, new)
    for table in (corpus.store.open_documents(set_id), corpus.store.open_chunks(set_id)):
        assert {r["doc_id"]: r["text"] for r in table.collect()} == {0: "old zero", 1: "new one", 7: "new seven"}
    assert corpus.list_sets().first()["total_documents"] == 3


def test_preview_takes_the_middle_and_prices_everything(spark):
    docs = spark.range(20).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("text_column"), F.lit("five tokens in this text").alias("text"),
        F.create_map(F.lit("row"), F.col("id").cast("string")).alias("metadata"),
    )
    shown, cost = preview(docs, CONFIG)
    assert sorted(r["doc_id"] for r in shown.collect()) == list(range(10, 20))
    assert cost.first().asDict() == {
        "model": "text-embedding-3-small", "token_count": 100, "price_per_1m": 0.02, "estimated_price": 100 * (0.02 / 1e6),
    }
    unknown = stats.estimate_cost(docs, "who knows").first()
    assert unknown["token_count"] == 100 and unknown["estimated_price"] == 0
    assert stats.estimate_cost(docs.limit(0), "mistral-embed").first()["token_count"] == 0


def test_catalogue_operators(spark):
    day = datetime.datetime(2024, 1, 1)
    sets = spark.createDataFrame([(i, f"s{i}", day + datetime.timedelta(days=i % 3)) for i in range(7)], "set_id int, name string, upload_date timestamp")
    docs = spark.createDataFrame([(i % 5,) for i in range(23)], "set_id int")
    got = [catalog.list_sets(sets, docs, page, 3).collect() for page in (1, 2, 3, 4)]
    assert [[r["set_id"] for r in p] for p in got] == [[2, 5, 1], [4, 0, 3], [6], []]
    assert {r["set_id"]: r["total_documents"] for p in got for r in p} == {0: 5, 1: 5, 2: 5, 3: 4, 4: 4, 5: 0, 6: 0}
    assert got[0][0]["total"] == 7
    assert catalog.get_set(sets, 3).first()["name"] == "s3" and catalog.get_set(sets, 30).first() is None
    assert catalog.without_set(docs, 1).filter("set_id = 1").count() == 0 and catalog.without_set(docs, 1).count() == 18


def test_stream_with_content_keys_replays_and_appends(corpus, tmp_path):
    set_id = corpus.ingest_csv(write(tmp_path / "a.csv", "text,note\nfirst,a\n"), "s", CONFIG)
    folder = tmp_path / "in"
    folder.mkdir()
    rows = stream_csv(corpus, str(folder), "text string, note string")
    docs = stream_documents(rows, ["text"])

    def run(checkpoint):
        ingest_stream(corpus, set_id, docs, str(tmp_path / checkpoint)).awaitTermination()
        stored = corpus.store.open_documents(set_id).collect()
        assert len({r["doc_id"] for r in stored}) == len(stored)
        chunks = corpus.store.open_chunks(set_id).collect()
        assert sorted((r["doc_id"], r["text"]) for r in chunks) == sorted((r["doc_id"], r["text"]) for r in stored)
        assert corpus.list_sets().first()["total_documents"] == len(stored)
        return sorted(r["text"] for r in stored)

    write(folder / "b.csv", "text,note\nsecond,b\nsecond,b\nthird,c\n")
    assert run("one") == ["first", "second", "third"]
    assert run("two") == ["first", "second", "third"]
    write(folder / "c.csv", "text,note\nthird,c\nfourth,d\n")
    assert run("one") == ["first", "fourth", "second", "third"]
    assert run("two") == ["first", "fourth", "second", "third"]


DOCS = "doc_id long, text_column string, text string, metadata map<string,string>"


def documents(spark, *rows):
    return spark.createDataFrame([(i, "text", t, {}) for i, t in rows], DOCS)


def stored(corpus, set_id):
    docs = {r["doc_id"]: r["text"] for r in corpus.store.open_documents(set_id).collect()}
    chunks = [(r["doc_id"], r["text"]) for r in corpus.store.open_chunks(set_id).collect()]
    assert sorted(chunks) == sorted(docs.items())
    assert corpus.get_set(set_id)["total_documents"] == len(docs)
    return docs


def test_keyed_batches_replace_and_are_idempotent(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, (0, "first"), (1, "second")), "s", CONFIG)
    batch = documents(spark, (0, "first again"), (5, "five"), (6, "six"))
    for _ in range(2):
        append_batch(corpus, set_id, batch, "s", 0)
        assert stored(corpus, set_id) == {0: "first again", 1: "second", 5: "five", 6: "six"}
    append_batch(corpus, set_id, documents(spark, (5, "five again")), "s", 1)
    append_batch(corpus, set_id, batch, "s", 0)
    assert stored(corpus, set_id)[5] == "five again"


def test_the_last_row_of_a_key_in_a_batch_counts(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, (0, "first")), "s", CONFIG)
    append_batch(corpus, set_id, documents(spark, (3, "zebra"), (3, "middle"), (3, "aardvark two"), (4, "x")).coalesce(1), "b", 0)
    assert stored(corpus, set_id) == {0: "first", 3: "aardvark two", 4: "x"}


def test_a_batch_half_written_is_not_seen_and_is_made_up_for(corpus, spark, monkeypatch):
    set_id = corpus.ingest_documents(documents(spark, (0, "first")), "s", CONFIG)
    batch = documents(spark, (5, "five"), (6, "six"))
    with monkeypatch.context() as broken:
        broken.setattr(Corpus, "_embedded", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            append_batch(corpus, set_id, batch, "one", 0)
    assert stored(corpus, set_id) == {0: "first"}
    append_batch(corpus, set_id, batch, "another", 0)  # a stream with a new checkpoint
    assert stored(corpus, set_id) == {0: "first", 5: "five", 6: "six"}


def test_identities_do_not_mix(corpus, spark, tmp_path):
    numbered = corpus.ingest_csv(write(tmp_path / "a.csv", "text,note\nfirst,a\n"), "s", CONFIG)
    with pytest.raises(IdentityError):
        append_batch(corpus, numbered, documents(spark, (0, "another document")), "b", 0)
    keyed = corpus.ingest_csv(write(tmp_path / "b.csv", "text,note,no\nfirst,a,40\nsecond,b,7\n"), "s", CONFIG, id_col="no")
    assert stored(corpus, keyed) == {40: "first", 7: "second"}
    with pytest.raises(IdentityError):
        append_batch(corpus, keyed, documents(spark, (0, "x")).drop("doc_id"), "b", 0)
    rows = spark.createDataFrame([("first anew", "a", "40")], "text string, note string, no string")
    append_batch(corpus, keyed, stream_documents(rows, ["text"], id_col="no"), "b", 0)
    assert stored(corpus, keyed) == {40: "first anew", 7: "second"}


def test_streaming_the_file_that_made_a_set_adds_nothing(corpus, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path = write(folder / "a.csv", "text,note\nfirst,a\nsecond,b\n")
    set_id = corpus.ingest_csv(path, "s", CONFIG)
    rows = stream_csv(corpus, str(folder), "text string, note string")
    ingest_stream(corpus, set_id, stream_documents(rows, ["text"]), str(tmp_path / "check")).awaitTermination()
    assert stored(corpus, set_id) == {0: "first", 1: "second"}


def test_two_writers_after_each_other_lose_nothing(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, (0, "first")), "s", CONFIG)
    other = Corpus(spark, corpus.root)
    assert other.store.require_set(set_id) == corpus.store.require_set(set_id)
    corpus.upsert_documents(set_id, documents(spark, (1, "by one")))
    other.upsert_documents(set_id, documents(spark, (2, "by another"), (1, "by another too")))
    assert stored(corpus, set_id) == {0: "first", 1: "by another too", 2: "by another"}


def test_a_change_rewrites_only_folders_that_hold_its_documents(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, (0, "first"), (1, "second")), "s", CONFIG)
    corpus.upsert_documents(set_id, documents(spark, (2, "third"), (3, "fourth")), "s", 0)
    before = corpus.store.require_set(set_id)["folders"]
    corpus.upsert_documents(set_id, documents(spark, (2, "third anew"), (9, "ninth")), "s", 1)
    after = corpus.store.require_set(set_id)["folders"]
    assert after == [before[0], "s-0~s-1", "s-1"]
    assert stored(corpus, set_id) == {0: "first", 1: "second", 2: "third anew", 3: "fourth", 9: "ninth"}
    assert corpus.search(set_id, "third anew", n=1).first()["source_doc_id"] == 2


def scan_rows(df):
    """Rows that the scans of a plan put out."""
    df.collect()
    rows, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        if plan.nodeName().startswith("Scan"):
            rows += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return rows


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    """Two thousand documents in a hundred files: a lookup by id reads the pages of the files that have it."""
    corpus = Corpus(spark, str(tmp_path / "store"))
    draw = list(range(0, 400_000, 20))
    docs = spark.createDataFrame([(i, "text", f"text {i}", {}) for i in draw], DOCS).repartition(100, "doc_id")
    set_id = corpus.ingest_documents(docs, "s", IngestConfig(embedder="mock"))
    found = corpus.get_documents(set_id, [0, 200_000, 399_980])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id, [0,200000,399980])" in plan.replace(", ", ",").replace("In(doc_id,[", "In(doc_id, [")
    assert sorted(r["text"] for r in found.collect()) == ["text 0", "text 200000", "text 399980"]
    assert scan_rows(found) <= 0.04 * len(draw)
    with pytest.raises(DocumentNotFoundError, match="7"):
        corpus.get_documents(set_id, [0, 7])
    assert corpus.get_documents(set_id, [i * 20 for i in range(1500)]).count() == 1500
    with pytest.raises(ValueError):
        corpus.store.fetch_documents(set_id, range(1001))
    page = corpus.search_with_sources(set_id, "text 60", n=3)
    assert "In(doc_id, [" in page._jdf.queryExecution().executedPlan().toString()
    assert all(r["document_text"] == r["text"] for r in page.collect())


def test_expansions_across_documents_follow_a_change(corpus, spark):
    config = IngestConfig(chunk_size=50, chunk_overlap=0, expand=True, expand_scope="corpus")
    set_id = corpus.ingest_documents(documents(spark, (0, "alpha one"), (1, "secret two"), (2, "gamma three")), "s", config)
    corpus.upsert_documents(set_id, documents(spark, (1, "beta two")))
    texts = {r["text"] for r in corpus.store.open_chunks(set_id).collect()}
    assert texts == {"alpha one", "beta two", "gamma three", "alpha one beta two", "beta two gamma three", "alpha one beta two gamma three"}


def test_vectors_of_another_dimension_are_refused(spark, tmp_path):
    short = function_embedder("short", 4, lambda texts: [[1.0, 2.0, 3.0] for _ in texts])
    corpus = Corpus(spark, str(tmp_path / "s"), EmbedderRegistry({"short": short}))
    with pytest.raises(Exception, match="declares 4 dimensions"):
        corpus.ingest_documents(documents(spark, (0, "x")), "s", IngestConfig(embedder="short"))
    assert corpus.list_sets().count() == 0


def test_ranking_reads_no_text(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, *[(i, f"word{i % 7} text {i}") for i in range(50)]), "s", CONFIG)
    chunks = corpus.store.open_chunks(set_id)
    plan = rank_chunks(chunks, [1.0] * 64, 5, [("note", "!=", "x")])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("text:" not in line and "metadata" not in line for line in scans)
    pages = [corpus.search(set_id, "word3", n=4, offset=o).collect() for o in (0, 4)]
    assert [r["rank"] for p in pages for r in p] == list(range(1, 9))
    scores = [r["score"] for p in pages for r in p]
    assert scores == sorted(scores, reverse=True) and all(r["text"].startswith("word") for p in pages for r in p)


def test_many_queries_equal_single_searches(corpus, spark):
    set_id = corpus.ingest_documents(documents(spark, *[(i, f"word{i % 7} text {i}") for i in range(40)]), "s", CONFIG)
    queries = spark.createDataFrame([(1, "word3"), (2, "text 11 word4")], "query_id int, text string")
    many = corpus.search_batch(set_id, queries, n=3, offset=2).collect()
    for query_id, text in ((1, "word3"), (2, "text 11 word4")):
        single = corpus.search(set_id, text, n=3, offset=2).collect()
        mine = sorted((r for r in many if r["query_id"] == query_id), key=lambda r: r["rank"])
        assert [(r["rank"], r["doc_id"], r["score"], r["has_more"]) for r in mine] == [(r["rank"], r["source_doc_id"], r["score"], r["has_more"]) for r in single]
    assert corpus.get_set(99) is None and corpus.get_set(set_id)["parameters"]["chunk_size"] == 50
