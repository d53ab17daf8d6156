import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import arrays as A
from textloom.llm import collocations as C

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, top, least):
    """Rows of ``lang, text``: every phrase counted, every cut scored."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(words[i : i + m] for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            inside = any(len(y) > len(g) and b >= a and any(y[i : i + len(g)] == g for i in range(len(y) - len(g) + 1)) for y, b in candidates.items())
            if not inside:
                score, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, totals[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def check(df, **how):
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in C.collocations(df, **how).collect())
    assert got == brute(rows, how.get("top", C.TOP), how.get("least_count", C.LEAST_COUNT))
    return got


def texts(seed, n, languages=("en", "de", None)):
    draw, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(25)] + ["ß", "É", "Aa", "#"]
    fixed = [[draw.choice(vocabulary) for _ in range(draw.randint(2, 7))] for _ in range(12)]
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 12)):
            words += draw.choice(fixed) if draw.random() < 0.5 else [draw.choice(vocabulary)]
            words.append(draw.choice(["", "", "", ",", "\n", "; ", "\t"]))
        text = " ".join(words).replace("w1 w2", "w1 W2")
        rows.append((i, text, draw.choice(languages)))
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, "one", "xx"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("how", [{"least_count": 3, "top": 2000}, {"least_count": 5, "top": 6, "first_branches": 2}, {"least_count": 2, "top": 40, "first_branches": 4}])
def test_phrases_against_brute_force(spark, how):
    df = spark.createDataFrame(texts(1, 300), "doc_id long, text string, lang string").repartition(4)
    assert check(df, **how)


def test_overlaps_ties_and_equal_words(spark):
    rows = [(i, "a a a a a a a. b c b c b c, d e f g h i", "en") for i in range(7)] + [(9, "d e f g h", None)] * 5
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_count=5, top=3, first_branches=1)


def test_words_that_are_names_of_languages(spark):
    words = ["en", "de", "und", "x", "y"]
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(words) for _ in range(9)), draw.choice(["en", "de", "und", None])) for i in range(60)]
    rows += [(60 + i, "de p q, a de r s", "de") for i in range(6)]  # "r s" always follows the language's own name
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_count=3, top=50)


def test_filters_steer_work_only(spark, monkeypatch):
    """Filters that let everything through give the same rows, in every batch."""
    monkeypatch.setattr(C, "_filter", lambda phrases: np.full(1 << 13, 255, np.uint8))
    rows = spark.createDataFrame(texts(5, 150), "doc_id long, text string, lang string")
    check(rows, least_count=3, top=40, first_branches=2)


def test_settling_leaves_branches_ungrown(spark, monkeypatch):
    """Rare words that always stand together settle the list; frequent words are then never grown."""
    draw = random.Random(8)
    rows = [(i, " ".join(f"x{draw.randrange(4)}" for _ in range(60)) + f". r{i % 9} s{i % 9}", "en") for i in range(90)]
    taken = []
    grow = C._grow
    monkeypatch.setattr(C, "_grow", lambda rows, frequent, branches, least: taken.append(branches.count()) or grow(rows, frequent, branches, least))
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_count=10, top=5, first_branches=9)
    assert taken == [18]


def test_products_beyond_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big + 7, 3 * big, big + 9, big + 11)], "a long, n long, l long, r long").selectExpr(C._SCORE + " as s").first()
    assert row.s == 1000 * (big + 7) * 3 * big // ((big + 9) * (big + 11))


def test_hashes_of_phrases_equal_those_of_texts():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 63, (40, 5), np.uint64)
    sizes = draw.integers(1, 6, 40)
    from textloom.llm import arrays as A

    assert C.gram_hash(words, sizes).tolist() == [int(A.gram_hashes(w[:n], n)[0]) for w, n in zip(words, sizes)]


def test_odd_rows(odd, nothing):
    check(odd, least_count=2, top=50)
    empty = C.collocations(nothing)
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_words_know_how_many_more_follow_in_their_piece():
    part = pa.RecordBatch.from_pydict({"text": pa.array(["a b. c d e", "", "f", ".!g\th\n\ni."]), "more_0": pa.array(["en", "en", "de", "de"])})
    ((rows, data, bounds),) = A.blocks([part])
    words = C._Words(rows, data, bounds)
    assert words.after.tolist() == [1, 0, 2, 1, 0, 0, 1, 0, 0]
    assert words.piece.tolist() == [0, 0, 1, 1, 1, 2, 3, 3, 4]
    assert words.row.tolist() == [0] * 5 + [2] + [3] * 3
