import random

import numpy as np
import pytest
from odd_inputs import prose

from textloom.llm import periodic_runs as P


def brute(words, least=6, exponent=4):
    """All runs by looking at every period, then the smallest period of each stretch."""
    n, spans = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                spans.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in spans.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(df, **sizes):
    rows = df.select("doc_id", "text").collect()
    got = P.find_runs(df, **sizes).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        words = [t.decode() for t in (texts[r.doc_id][0] or "").encode().split()]
        runs = brute(words, sizes.get("least_words", 6), sizes.get("least_exponent", 4))
        assert [tuple(x) for x in r.runs] == runs, (r.doc_id, words)
        assert r.n_words == len(words) and r.collapsed == collapsed(words, runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (tuple(r.best) if r.best else None) == best


def periodic(draw):
    """Words over few letters with planted, nested and adjacent repeats."""
    words = []
    for _ in range(draw.randint(1, 6)):
        unit = [draw.choice("abc") for _ in range(draw.randint(1, 5))]
        if draw.random() < 0.3:
            unit = unit * draw.randint(2, 5) + [draw.choice("abc")]
        words += unit * draw.randint(1, 9) + unit[: draw.randrange(len(unit))]
        words += [draw.choice("abcdefgh") for _ in range(draw.randint(0, 6))]
    return words


@pytest.mark.parametrize("sizes", [(6, 4), (6, 3), (2, 5), (12, 3)])
def test_blocks_of_rows(sizes):
    draw = random.Random(5)
    for _ in range(60):
        texts = [periodic(draw) for _ in range(draw.randint(1, 5))] + [[]]
        if draw.random() < 0.3:
            texts.append(texts[0])
        words = np.array([hash(w) & 0xFFFFFFFF for t in texts for w in t], np.uint64)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = P.block_runs(words, rows, len(texts), *sizes)
        for i, t in enumerate(texts):
            assert [(s - int(firsts[i]), n, q) for s, n, q in got.get(i, [])] == brute(t, *sizes), t


def test_suffix_order():
    draw = random.Random(6)
    words = np.array([draw.randrange(3) for _ in range(300)], np.uint64)
    rows = np.sort(np.array([draw.randrange(4) for _ in range(300)]))
    order = P.suffix_order(words, rows)
    ends = np.searchsorted(rows, rows, "right")
    key = {i: (rows[i], [int(w) for w in words[i : ends[i]]] + [9]) for i in range(300)}
    assert order.tolist() == sorted(range(300), key=key.__getitem__)


def test_long_texts_of_one_period_take_no_quadratic_time(spark):
    texts = ["a " * 200_000, "line one here\n" * 100_000, ("x " * 9 + "y ") * 30_000 + "z"]
    rows = P.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r.best) for r in rows} == {0: (0, 200_000, 1), 1: (0, 300_000, 3), 2: (0, 300_000, 10)}
    assert {r.doc_id: len(r.runs) for r in rows} == {0: 1, 1: 1, 2: 1 + 30_000}


def test_many_repeats_without_a_run(spark):
    """One line a thousand times between different words: many equal spans, none of them close."""
    text = " ".join(f"u{i} a common line of seven words here" for i in range(5000))
    (row,) = P.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.runs == [] and row.collapsed == text


def test_odd_rows(odd, nothing, spark):
    check(odd)
    assert P.find_runs(nothing).count() == 0
    draw = random.Random(7)
    check(spark.createDataFrame([(i, " \n".join(periodic(draw))) for i in range(300)], "doc_id long, text string").repartition(7))


def test_a_text_beyond_one_block(spark):
    """Many small blocks and a text that is larger than a block, against a text with known runs."""
    body = prose(3, 400_000)  # about 2 MB
    text = body + " " + "again and " * 5 + "again " + body[:100]
    (row,) = [r for r in P.find_runs(spark.createDataFrame([(1, text), (2, "b c")], "doc_id long, text string")).collect() if r.doc_id == 1]
    n = len(body.split())
    assert (n, 11, 2) in [tuple(x) for x in row.runs]


def test_bad_sizes(nothing):
    with pytest.raises(ValueError):
        P.find_runs(nothing, least_exponent=2)
