import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_units_give_the_ids_of_the_whole_text():
    whole, encoder = Tokenizer.from_file(JSON), packing.Encoder(JSON, RANKS)
    texts = ["", " ", "a", "two  blanks", " lead", "trail ", "it's don't\nnew\tline", "x \n y", "Ünï Wörter für", "漢字 and <|endoftext|>", "1234 a1b2 ... !?", "a b  c", "don 't", "a\r\n b"]
    for text in texts + [t * 3 for t in texts]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_hilbert_keys_step_to_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_every_id_is_in_one_piece(spark, odd, nothing):
    rows = packing.pack(odd, JSON, RANKS, sequence=64).toPandas()
    whole = Tokenizer.from_file(JSON)
    expected = {}
    for key, text in odd.select("doc_id", "text").collect():
        expected.setdefault(key, []).append(whole.encode(text or "", add_special_tokens=False).ids + [0])
    for key, lists in expected.items():
        mine = rows[rows.doc_id.isna()] if key is None else rows[rows.doc_id == key]
        assert mine.length.sum() == sum(map(len, lists))
        assert set(mine.doc_tokens) == {len(lists[0])}
        for piece in mine.itertuples():
            part = lists[0][piece.start : piece.start + piece.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == piece.ids_crc32
    for _, sequence in rows.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert (sequence.offset == sequence.length.cumsum() - sequence.length).all() and sequence.length.sum() <= 64
    fill = rows.groupby("sequence_id").length.sum()
    assert (fill < 64).sum() <= 1  # one range of the curve, one sequence that is not full
    assert packing.pack(nothing, JSON, RANKS).count() == 0


def test_like_documents_are_packed_next_to_each_other(spark):
    texts = [("the of and to in that is was he for " * 20, "tle äöü schung keit heit der die das " * 20)[i % 2] + str(i) for i in range(40)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON, RANKS).toPandas()
    order = rows[rows.start == 0].sort_values(["sequence_id", "offset"]).doc_id % 2
    assert (order.diff().fillna(0) != 0).sum() <= 4


def test_units_encoded_together_equal_the_whole_texts():
    whole, encoder = Tokenizer.from_file(JSON), packing.Encoder(JSON, RANKS)
    texts = ["", "a", "two\nlines and\n more", "x\n y", "don't we're", "Über schön £5 €6", "tab\there end\n", "a b c " + "zq" * 40 + " 12345 ...!", "漢 字", " lead", "same same Same"]
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.block(texts) == expected and encoder.block(texts[::-1]) == expected[::-1]


def test_ranges_hold_about_as_many_tokens(spark, monkeypatch):
    """Long documents and a third of equal ones spread over ranges of about the same size."""
    monkeypatch.setattr(packing, "RANGE_TOKENS", 3000)
    texts = ["the same text again and again " * 4] * 300 + [f"other {i} words {i * 7} " * (1 + i % 90) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), JSON, RANKS, sequence=128).toPandas()
    sizes = rows.groupby(rows.sequence_id // (1 << 32)).length.sum()
    assert len(sizes) >= 10 and sizes.max() < 3 * sizes.median()
    assert rows.groupby("doc_id").length.sum().sum() == rows.length.sum() == rows.drop_duplicates("doc_id").doc_tokens.sum()
