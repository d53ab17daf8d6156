import random
from collections import Counter

import numpy as np
import pytest
from odd_inputs import prose

from textloom.llm import filters
from textloom.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def key_of(line):
    return line.strip(BLANKS).translate(LOWER)


def brute(rows, documents=10, chars=1, keep_first=False):
    split = [(key, (text or "").split("\n")) for key, text in rows]
    counts = Counter(k for _, lines in split for k in {key_of(line) for line in lines})
    often = {k for k, n in counts.items() if n >= documents and len(k) >= max(chars, 1)}
    first = {}
    for key, i, line in sorted(((key, i, line) for key, lines in split for i, line in enumerate(lines)), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        first.setdefault(key_of(line), (key, i))
    out = []
    for key, lines in split:
        kept = [line for i, line in enumerate(lines) if key_of(line) not in often or (keep_first and first[key_of(line)] == (key, i))]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = L.drop_frequent_lines(df, **{{"documents": "least_documents", "chars": "least_chars"}.get(k, k): v for k, v in how.items()})
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, **how)


def lined(spark, documents=120):
    draw = random.Random(4)
    common = [prose(i, draw.randint(1, 9)) for i in range(12)] + ["", " ", "ß", "Über uns", "über uns", "Home", "  HOME\t", "\x0bhome\x0c", "a\rb"]
    rows = []
    for i in range(documents):
        lines = [draw.choice(common) if draw.random() < 0.3 else prose(1000 + 40 * i + j, 4) for j in range(draw.randint(0, 30))]
        rows.append((i if i % 17 else None, "\n".join(lines)))
    rows += [(500, "\n" * 30), (501, None), (502, rows[3][1]), (503, rows[3][1]), (503, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("how", [{}, {"documents": 2}, {"documents": 1}, {"documents": 3, "chars": 5}, {"documents": 2, "keep_first": True}])
def test_lines_against_brute_force(spark, how):
    check(lined(spark), **how)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "filter_bits", lambda keys: 1 << 16)
    monkeypatch.setattr(filters, "BITS_A_KEY", 0.001)
    df = lined(spark, 400)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    monkeypatch.setattr(L, "KeyFilter", lambda packed: filters.KeyFilter(np.full_like(packed, 255)))
    assert Counter(tuple(r) for r in L.drop_frequent_lines(df).collect()) == brute(rows)


def test_odd_rows(odd, nothing):
    check(odd, documents=2)
    check(odd, documents=2, keep_first=True)
    assert L.drop_frequent_lines(nothing).count() == 0


def test_text_keys_and_a_text_beyond_one_block(spark):
    long = "\n".join(prose(i, 6) for i in range(60_000))  # about 2 MB
    df = spark.createDataFrame([("a", long), ("b", "x\n" + long[:5000]), ("c", long[-3000:])], "doc_id string, text string").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    split = {k: t.split("\n") for k, t in rows}
    counts = Counter(k for lines in split.values() for k in set(lines))
    for r in L.drop_frequent_lines(df, least_documents=2).collect():
        assert r.kept == "\n".join(line for line in split[r.doc_id] if counts[line] < 2)


def test_two_filters_know_what_was_seen_twice(spark):
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 1 << 63, 5000, np.uint64)
    tasks = [hashes[draw.integers(0, 5000, 900)] for _ in range(6)]
    bits = filters.filter_bits(5400)

    def look(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                seen = filters.SeenTwice(bits)
                for part in np.array_split(tasks[number], 3):
                    seen.see(part)
                yield from seen.pieces()

    found = filters.seen_twice(spark.range(6).repartition(6).mapInArrow(look, filters.PIECES), bits)
    values, counts = np.unique(np.concatenate(tasks), return_counts=True)
    assert found.has(values[counts > 1]).all()
    assert found.has(values[counts == 1]).mean() < 0.05 and not found.has(draw.integers(0, 1 << 63, 5000, np.uint64)).mean() > 0.05


def test_filter_of_a_column_equals_the_arrays(spark):
    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 1 << 64, 3000, np.uint64)
    built = filters.filter_of(spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)] + [(None,)], "h long"), "h")
    own = filters.KeyFilter(np.zeros_like(built.packed))
    own.add(hashes)
    assert (own.packed == built.packed).all() and built.has(hashes).all()
    assert len(filters.filter_of(spark.createDataFrame([], "h long"), "h").packed)
