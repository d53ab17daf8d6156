import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import token_count
from textloom.operators import chunking as C

PROSE = (
    "Seven lanterns stood along the quay at Port Ellis.  Their oil arrived by boat from Brack Ltd. in tins of nine litres each, "
    "and whoever kept watch wrote the delivery down.  When fog closed in, a bell rang twice a minute; the rule came from the "
    "U.K. coast office and nobody liked it.  Visitors ask Mrs. Ode about the winter of 1911, when the old pier fell, but Dr. Voss "
    "has the drawings."
)


def chunks_of(spark, texts, size=50, overlap=10, **kwargs):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = C.chunk_documents(df, size, overlap, **kwargs).orderBy("doc_id", "chunk_ix").collect()
    out = [[] for _ in texts]
    for row in rows:
        assert row["chunk_ix"] == len(out[row["doc_id"]])
        out[row["doc_id"]].append(row["text"])
    return out


def defined_bounds(lengths, size, overlap):
    """Packing by its definition: a chunk takes one new piece and then all that fit; the next one begins as early as the overlap allows."""
    bounds, first, stop = [], 0, 0
    while stop < len(lengths):
        stop = max(n for n in range(stop + 1, len(lengths) + 1) if n == stop + 1 or sum(lengths[first:n]) <= size)
        bounds.append((first, stop))
        first = min(i for i in range(first, stop + 1) if sum(lengths[i:stop]) <= overlap)
    return bounds


@pytest.mark.parametrize(("size", "overlap"), [(20, 0), (50, 10), (40, 20), (20, 20)])
@pytest.mark.parametrize("block", [1, 7, 1024])
def test_packing_matches_its_definition(spark, monkeypatch, size, overlap, block):
    monkeypatch.setattr(C, "_BLOCK_PIECES", block)
    rng = random.Random(size * 100 + overlap)
    cases = [[rng.choice([0, 1, 2, 5, 10, size]) for _ in range(rng.randrange(0, 40))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lengths array<int>")
    rows = df.select("i", C.chunk_bounds(F.col("lengths"), size, overlap).alias("b")).collect()
    for row in rows:
        assert [(b["first"], b["stop"]) for b in row["b"]] == defined_bounds(cases[row["i"]], size, overlap), cases[row["i"]]


def test_no_space_is_lost_and_listed_abbreviations_hold(spark):
    for size in (32, 50):
        (chunks,) = chunks_of(spark, [PROSE], size=size, overlap=5)
        assert len(chunks) > 1
        assert not any(joined in c for c in chunks for joined in ("Ellis.Their", "Ltd.in", "down.When", "Mrs.Ode"))
        assert not any(c.endswith(title) for c in chunks for title in ("Mrs.", "Dr.", "Ltd."))


def test_without_abbreviations_it_splits_at_titles(spark):
    (chunks,) = chunks_of(spark, [PROSE], size=24, overlap=0, abbreviations=[])
    assert any(c.endswith(title) for c in chunks for title in ("Mrs.", "Dr.", "Ltd."))


def test_short_sentences_stay_whole(spark):
    texts = [
        "Tea is served at four in the hall of Brack Ltd. on weekdays.",
        "Ask Dr. Voss.",
        "A ferry of the U.K. line left at 6.45 with two goats on board!",
        "Mrs. Ode keeps the keys, the maps and one very old cat",
    ]
    assert chunks_of(spark, texts) == [[t] for t in texts]


def test_sentences(spark):
    text = "It cost 3.14, i.e. little. Reply A.S.A.P. please! See 1.2.3 of Inc. rules.\nNew line? Yes"
    row = spark.createDataFrame([(text,)], "t string").select(C.sentences(F.col("t"))).first()[0]
    assert row == ["It cost 3.14, i.e. little. ", "Reply A.S.A.P. please! ", "See 1.2.3 of Inc. rules.\n", "New line? ", "Yes"]
    assert "".join(row) == text
    plain = spark.createDataFrame([("Disco. Mr. X",)], "t string").select(C.sentences(F.col("t"))).first()[0]
    assert plain == ["Disco. ", "Mr. X"]


def test_custom_abbreviations_with_inner_dots(spark):
    df = spark.createDataFrame([("See e.g. this. Or No. 5 now.",)], "t string")
    assert df.select(C.sentences(F.col("t"), ["e.g.", "No."])).first()[0] == ["See e.g. this. ", "Or No. 5 now."]


@pytest.mark.parametrize(("size", "overlap"), [(7, 0), (10, 3), (20, 20)])
def test_pieces_rejoin_and_chunks_keep_their_bound(spark, size, overlap):
    rng = random.Random(size)
    parts = ["word ", "a,b;c ", "Dr. X ", "end. ", "!?\n", "\n\n\n", "x-y-z-" * 9, "...", " ", "。！", "3.5 ", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(150)] + [" \n ", "q" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in df.select("text", C.pieces(F.col("text"), size).alias("p")).collect():
        assert "".join(p["text"] for p in row["p"]) == row["text"]
        assert all(p["n_tokens"] <= size for p in row["p"])
    packed = C.pack_chunks(C.split_pieces(df, size), size, overlap)
    assert packed.agg(F.max("n_packed")).first()[0] <= size + overlap
    chunks = C.chunk_documents(df, size, overlap)
    assert chunks.filter((F.col("text") == "") | (F.col("n_tokens") > size + overlap)).isEmpty()
    assert chunks.filter(F.col("n_tokens") != token_count(F.col("text"))).isEmpty()
    cleaned = C.clean_chunks(packed).select("doc_id", "text")
    assert cleaned.exceptAll(chunks.select("doc_id", "text")).isEmpty() and cleaned.count() == chunks.count()


def test_empty_null_and_blank_documents_give_no_chunk(spark):
    assert chunks_of(spark, ["good", None, "", " \n "]) == [["good"], [], [], []]
    df = spark.createDataFrame([(0, "a"), (1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(r[0] for r in C.drop_empty(df).collect()) == [0, 3]


def test_a_run_without_punctuation_is_cut(spark):
    (chunks,) = chunks_of(spark, [" ".join(["word"] * 120)], size=50, overlap=0)
    assert [c.count("word") for c in chunks] == [50, 50, 20]


def test_runs_without_spaces_are_bounded(spark):
    texts = ["漢" * 3000, "=" * 2500, "QmFzZTY0" * 400, "漢字。" * 500]
    for text, chunks in zip(texts, chunks_of(spark, texts, size=20, overlap=0)):
        assert "".join(chunks) == text and max(map(len, chunks)) <= 20 * 24
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert C.chunk_documents(df, 20, 0).filter("n_tokens > 20").isEmpty()


def test_no_character_of_a_text_is_taken_for_a_mark(spark):
    text = "One \ufdd0 two.\ufdd0 Dr. \ufdd0\ufdd1 Voss \ufdd2. End\ufdd0"
    row = spark.createDataFrame([(text,)], "t string").select(C.sentences(F.col("t"))).first()[0]
    assert "".join(row) == text


def test_paragraphs_come_before_sentences(spark):
    text = "One two three. Four five.\n\n\nSix seven. Eight nine ten."
    assert chunks_of(spark, [text], size=7, overlap=0) == [["One two three. Four five.", "Six seven. Eight nine ten."]]


def test_metadata_is_kept_and_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, "hi there", {"long": "x " * 500})], "doc_id long, text string, metadata map<string,string>")
    row = C.chunk_documents(df, 5, 1).first()
    assert row["text"] == "hi there" and row["metadata"]["long"].startswith("x") and not row["is_expanded"]
    for size, overlap in ((0, 0), (-1, 0), (10, 11), (10, -1)):
        with pytest.raises(ValueError):
            C.chunk_documents(df, size, overlap)


def test_chunking_needs_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = C.chunk_documents(df, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("posexplode") == 1


def test_a_long_document_is_folded_in_blocks(spark):
    n = 30_000  # many blocks of pieces
    df = spark.range(1).select(F.lit(0).alias("doc_id"), F.repeat(F.lit("Some words make a sentence. "), n).alias("text"))
    assert C.chunk_documents(df, 12, 0).count() == n // 2


def test_run_transforms_applies_in_order(spark):
    df = spark.createDataFrame([("a",)], "t string")
    steps = [lambda d, s=s: d.withColumn("t", F.concat("t", F.lit(s))) for s in "bcd"]
    assert C.run_transforms(df, steps).first()[0] == "abcd"
    assert C.run_transforms(df, []).first()[0] == "a"
