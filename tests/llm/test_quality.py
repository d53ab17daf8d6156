import collections
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd_inputs import prose

from textloom.llm import arrays as A
from textloom.llm import quality as Q
from textloom.llm.common import keyed_texts


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def brute_bits(texts, text):
    """Interpolated modified Kneser-Ney over byte classes, straight from its definition."""
    classes = [[int(Q._CLASS[b]) for b in t.encode()] for t in texts]
    counts = {Q.ORDER: collections.Counter(tuple(c[i : i + Q.ORDER]) for c in classes for i in range(len(c) - Q.ORDER + 1))}
    for n in range(Q.ORDER - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def discount(n, c):
        of = collections.Counter(counts[n].values())
        i = min(c, 3)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0
        value = i - (i + 1) * y * of[i + 1] / of[i] if y and of[i] else 0
        return min(value if value > 0 else 0.5 * i, c)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (1 << Q.BITS)
        inside = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(inside.values())
        if not total:
            return p(gram[1:])
        own = counts[n].get(gram, 0)
        left = sum(discount(n, c) for c in inside.values()) / total
        return (own - discount(n, own) if own else 0) / total + left * p(gram[1:])

    mine = [int(Q._CLASS[b]) for b in text.encode()]
    grams = [tuple(mine[i : i + Q.ORDER]) for i in range(len(mine) - Q.ORDER + 1)]
    return -sum(math.log2(p(g)) for g in grams) / len(grams)


def test_base_statistics(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((tuple([r.doc_id, *[r[s] for s in Q._STATS]]) for r in Q.score_documents(odd).collect()), key=str)
    assert got == sorted(((k, *brute_stats(t)) for k, t in rows), key=str)


def test_perplexity_by_the_definition(spark):
    texts = [prose(i, 60) for i in range(12)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.bits for r in Q.score_documents(df).collect()}
    for i in (0, 5):
        assert got[i] == pytest.approx(brute_bits(texts, texts[i]), rel=1e-4)
    table = Q.fit_models(df, "text", "lang")["en"].table()
    by_context = np.exp2(-table.astype(np.float64)).reshape(-1, 1 << Q.BITS).sum(axis=1)
    assert np.allclose(by_context, 1, atol=1e-3)


def test_models_reach_the_driver_as_columns(spark, monkeypatch):
    texts = spark.createDataFrame([(prose(i, 40), "en" if i % 2 else "") for i in range(8)], "text string, lang string")

    def refused(*_):
        raise AssertionError("an object for each n-gram")

    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(texts), name, refused)
    models = Q.fit_models(texts, "text", "lang")
    assert sorted(models) == ["", "en"]
    for model in models.values():
        assert all(len(k) == len(s) and (np.diff(k.astype(np.int64)) > 0).all() for k, s in zip(model.keys + model.contexts, model.shares + model.left))


def test_bands_reject_noise_and_keep_prose(spark):
    rows = [(i, prose(i, 120), "en") for i in range(150)] + [(200 + i, prose(i, 120, "qzxjkvwp#%&"), "en") for i in range(3)] + [(300, prose(1, 20), "en"), (301, "same three words " * 60, "en")]
    got = {r.doc_id: r for r in Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[200 + i].kept or got[200 + i].base_failed for i in range(3))
    assert got[300].base_failed and got[301].base_failed and not got[300].kept and not got[301].kept


def brute_unit_bits(texts, i):
    """Order two, counted by texts, from its definition: ``texts`` without ``i``, the discounts and the vocabulary of all."""
    pairs = [set(zip(t.split(), t.split()[1:])) for t in texts]

    def counted(some):
        c = collections.Counter(p for ps in some for p in ps)
        return c, collections.Counter(w for _, w in c)

    def discounts(counts):
        of = collections.Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0
        found = [n - (n + 1) * y * of[n + 1] / of[n] if y and of[n] else 0 for n in (1, 2, 3)]
        return [min(d if d > 0 else 0.5 * n, n) for n, d in enumerate(found, 1)]

    everything = counted(pairs)
    d, e = (discounts(c) for c in everything)
    c, ends = counted(pairs[:i] + pairs[i + 1 :])
    kinds = len(everything[1])

    def lose(n, by):
        return by[min(n, 3) - 1] if n else 0

    def p(v, w):
        base = sum(ends.values())
        low = (ends[w] - lose(ends[w], e) + sum(lose(n, e) for n in ends.values()) / kinds) / base
        mine = [n for (a, _), n in c.items() if a == v]
        return (c[v, w] - lose(c[v, w], d) + sum(lose(n, d) for n in mine) * low) / sum(mine) if mine else low

    words = texts[i].split()
    return -sum(math.log2(p(v, w)) for v, w in zip(words, words[1:])) / (len(words) - 1)


def chain(seed, words, vocabulary):
    """Text in which few words can follow a word."""
    draw, at, out = random.Random(seed), seed % len(vocabulary), []
    for _ in range(words):
        out.append(vocabulary[at])
        at = (5 * at + draw.choice((1, 2, 3, 7))) % len(vocabulary)
    return out


def test_unit_bits_by_the_definition(spark):
    texts = [" ".join(chain(i, 40, [f"w{j}" for j in range(30)])) for i in range(9)] + ["w1 w2 never w3 seen", "never seen w1"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.unit_bits for r in Q.score_documents(df).collect()}
    assert got[11] == got[3]
    for i in (0, 3, 9, 10):
        assert got[i] == pytest.approx(brute_unit_bits(texts, i), rel=1e-9)


def test_unit_bits_in_many_chunks_and_no_pair_as_a_row(spark, monkeypatch):
    """Chunks and ranges change nothing, copies in other chunks neither; pairs never become rows of a stored table, and tables no longer read go."""
    kept = []
    store = Q.written
    monkeypatch.setattr(Q, "written", lambda df, name, **how: kept.append((name, stored := store(df, name, **how))) or stored)
    monkeypatch.setattr(Q, "CHUNK_BYTES", 300)
    monkeypatch.setattr(A, "BLOCK_BYTES", 200)
    monkeypatch.setattr(Q, "SCORED_PAIRS", 50)
    counts = {}
    release = Q.released
    monkeypatch.setattr(Q, "released", lambda *tables: [counts.update({t.scratch: t.count()}) for t in tables] and release(*tables))
    texts = [" ".join(chain(i, 40, [f"w{j}" for j in range(30)])) for i in range(9)] + ["w1 w2 never w3 seen", "never seen w1"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, texts[3], texts[10]])], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.unit_bits for r in Q.score_documents(df).collect()}
    assert got[11] == got[3] and got[12] == got[10]
    for i in (0, 3, 9, 10):
        assert got[i] == pytest.approx(brute_unit_bits(texts, i), rel=1e-9)
    assert sum(n for folder, n in counts.items() if "unit-chunks" in folder) > 3
    pairs = sum(len(set(zip(t.split(), t.split()[1:]))) for t in texts)
    assert 0 < sum(n for folder, n in counts.items() if "pair-counts" in folder) < pairs
    gone = {"unit-chunks", "pair-counts", "units-asked", "unit-counts", "quality-copied-texts"}
    assert not any(os.path.exists(t.scratch.removeprefix("file:")) for name, t in kept if name in gone)


def test_lists_of_units_are_never_all_stored_at_once(spark, monkeypatch):
    asked, most = {}, [0]
    store = Q.written

    def kept(df, name, **how):
        stored = store(df, name, **how)
        if name == "units-asked":
            asked[stored.scratch.removeprefix("file:")] = stored.count()
            most.append(sum(n for folder, n in asked.items() if os.path.exists(folder)))
        return stored

    monkeypatch.setattr(Q, "written", kept)
    texts = [(" ".join(chain(i, 40, [f"w{j}" for j in range(30)])), "en", i, -i, 5) for i in range(9)]
    scored = Q.unit_bits(spark.createDataFrame(texts, "text string, lang string, hash long, other_hash long, salt long").drop("salt"))
    assert scored.count() == 9 and 0 < max(most) < 0.75 * sum(asked.values())


def test_frequent_units_come_first_and_chunks_read_back():
    rows = pa.RecordBatch.from_pydict({"more_0": ["en", "", "en"], "more_1": [1, 2, 3], "more_2": [4, 5, 6]})
    units, owner = np.array([9, 7, 7, 7, 5, 9, 7, 1 << 63, 3], np.uint64), np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])
    r = Q._chunk([(rows, units, owner)]).to_pylist()[0]
    assert Q._unpacked(r["places"], r["n_places"], np.uint32)[units == 7].tolist() == [0] * 4
    pairs = Q._Pairs(r)
    assert pairs.units.tolist() == sorted(set(units.tolist()))
    got = sorted((int(row), int(pairs.units[pairs.v[p]]), int(pairs.units[pairs.w[p]]), int(t)) for row, p, t in zip(pairs.row, pairs.pair, pairs.times))
    assert got == [(0, 7, 7, 1), (0, 9, 7, 1), (1, 5, 9, 1), (1, 7, 5, 1), (2, 7, 1 << 63, 1), (2, 1 << 63, 3, 1)]


def test_letter_salad_and_shuffled_words_go_in_any_script(spark):
    rows, bad = [], set()
    for lang, letters in (("ru", "абвгдежзиклмнопрстуя"), ("en", "abcdefghiklmnoprstuy")):
        vocabulary = list(dict.fromkeys(prose(7, 300, letters).split()))
        for i in range(60):
            rows.append((len(rows), " ".join(chain(i, 200, vocabulary)), lang))
        shuffled = chain(99, 200, vocabulary)
        random.Random(1).shuffle(shuffled)
        for text in (" ".join(shuffled), prose(8, 200, letters)):
            bad.add(len(rows))
            rows.append((len(rows), text, lang))
    signs = [chr(0x4E00 + i) for i in range(300)]
    for i in range(60):
        text = "".join(chain(i, 200, signs))
        rows.append((len(rows), " ".join(text[j : j + 3] for j in range(0, 200, 3)), "zh"))
    drawn = "".join(random.Random(2).choices(signs, k=200))
    bad.add(len(rows))
    rows.append((len(rows), " ".join(drawn[j : j + 3] for j in range(0, 200, 3)), "zh"))
    got = Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if not r.kept} == bad


def test_every_language_has_models_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(Q, "LANGUAGES", 2)
    names = ["a", "b", "c", "d", "", None]
    rows = [(10 * n + i, prose(10 * n + i, 60, "aeinorst" if n % 2 else "bcdfghkl"), name) for n, name in enumerate(names) for i in range(4)]
    got = {r.doc_id: r for r in Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for n, name in enumerate(names):
        assert {got[10 * n + i].lang_class for i in range(4)} == {name}
        texts = [text for _, text, of in rows if of == name]
        assert got[10 * n].bits == pytest.approx(brute_bits(texts, texts[0]), rel=1e-4)


def test_odd_rows(odd, nothing):
    got = Q.score_documents(odd)
    assert got.count() == odd.count() and {r.base_failed for r in got.filter("doc_id in (3, 4, 5)").collect()} == {True}
    assert Q.score_documents(nothing).count() == 0
    assert Q.good_documents(odd).columns == odd.columns


def test_blocks_do_not_change_statistics(monkeypatch, odd):
    monkeypatch.setattr(A, "BLOCK_BYTES", 64)
    texts = [r.text or "" for r in odd.select("text").collect()]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    stats = Q.base_stats(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [tuple(int(s[i]) for s in stats) for i in range(len(texts))] == [brute_stats(t) for t in texts]


def test_a_worker_gets_a_few_megabytes_at_once(spark):
    rows = keyed_texts(spark.range(400).selectExpr("id", "repeat('some words ', 9000) as text").coalesce(1), "id", "text")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").toPandas()["size"]
    assert sizes.sum() > 30_000_000 and sizes.max() < 5_000_000
