import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from textloom.llm import token_counts as T


def library(vocabulary, byte_pieces):
    pieces = [("<unk>", 0.0)] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_pieces else []) + list(vocabulary)
    tokenizer = Tokenizer(models.Unigram(pieces, 0, byte_fallback=byte_pieces))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_with_ties_equal_the_librarys():
    draw = random.Random(2)
    alphabet = "ab▁"
    for trial in range(30):
        pieces = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 4))) for _ in range(14)}
        vocabulary = [(p, -float(draw.randint(1, 4))) for p in sorted(pieces)] + [("<other>", 0.0)]
        # The library's lowest score takes its special pieces in, all at 0 here.
        counter, expected = T.UnigramCounter(vocabulary, byte_pieces=True), library(vocabulary, True)
        for _ in range(40):
            text = "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 14)))
            assert counter.text(text) == expected(text), (trial, text, vocabulary)


def test_public_pieces():
    vocabulary = T.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter, expected = T.UnigramCounter(vocabulary), library(vocabulary, True)
    for text in ["", " ", "  two  blanks ", "Hello world", "▁odd", "ünï 漢字 😀 end", "a\nb\tc", "x" * 500]:
        assert counter.text(text) == expected(text), text


def test_unknown_runs_count_once_without_byte_pieces():
    counter = T.UnigramCounter([("a", -1.0), (T.BLANK, -1.0)], byte_pieces=False)
    assert counter.text("axya") == 4 and counter.text("xyz") == 2


def test_odd_rows(odd, nothing):
    vocabulary = T.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    expected = library(vocabulary, True)
    got = {r.doc_id: r for r in T.count_tokens(odd, vocabulary).collect()}
    for r in odd.collect():
        assert got[r.doc_id].n_tokens == expected(r.text or "") and got[r.doc_id].n_bytes == len((r.text or "").encode())
    assert T.count_tokens(nothing, vocabulary).count() == 0
    assert T.count_tokens(odd, []).count() == odd.count()


def test_the_whole_query(spark):
    from textloom.llm.queries import op7_token_counts

    folder = "/root/testdata/sf0.001"
    expected = library(T.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), True)
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id: r.n_tokens for r in op7_token_counts(spark, folder).collect()} == {k: expected(t or "") for k, t in texts.items()}
