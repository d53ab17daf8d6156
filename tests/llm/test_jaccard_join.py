import random

import numpy as np

from odd_inputs import prose

from textloom.llm import jaccard_join as J
from textloom.llm.components import connected_components


def brute(rows, shingle=4):
    def members(text):
        words = (text or "").encode().lower().replace(b"\x0b", b" ").split()
        return {tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))} if words else set()

    sets = [members(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    smallest = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((k, len(s), smallest[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def linked(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.link_documents(df).collect()), key=str)


def test_clusters_of_edited_copies(spark):
    draw, rows = random.Random(5), []
    license_text = prose(77, 60)
    for family in range(6):
        words = prose(family, 80 + 40 * family).split()
        for _ in range(14):
            own = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                own[draw.randrange(len(own))] = draw.choice("xyz") * 3
            rows.append((len(rows), " ".join(own) + (" " + license_text if family % 2 else "")))
    for i in range(20):
        rows.append((len(rows), license_text + " " + prose(100 + i, draw.choice([3, 8, 200]))))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert linked(df) == brute(rows)


def test_links_inside_a_group_whose_first_unit_links_with_none(spark):
    rows, expected = [], []
    for family in range(100):
        a, words = 3 * family, prose(1000 + family, 16, "abcdefghijklmnop").split()
        for i, tail in enumerate((["x", "y", "z"], words[13:], [*words[13:15], "w"])):
            rows.append((a + i, " ".join(words[:13] + tail)))
        expected += [(a, 13, a), (a + 1, 13, a + 1), (a + 2, 13, a + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert linked(df) == sorted(expected, key=str)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert linked(odd) == brute(rows)
    assert J.link_documents(nothing).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 7, 8, 9, 10}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 105: 100, 103: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_parity_bound_loses_no_link(spark):
    """Sets of every distance around the limit, alone and as parts of several sets."""
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        n, d = int(draw.integers(1, 400)), int(draw.integers(0, 60))
        base = draw.integers(0, 1 << 63, n, np.uint64)
        other = np.unique(np.concatenate([base[d:], draw.integers(0, 1 << 63, int(draw.integers(0, d + 1)), np.uint64)]))
        base = np.unique(base)
        if len(other):
            third = J._parity(other) ^ J._parity(draw.integers(0, 1 << 63, 3, np.uint64))
            common = len(np.intersect1d(base, other))
            links = 100 * common >= J.PERCENT * (len(base) + len(other) - common)
            one, two = J._parity(base), J._parity(other)
            rows.append((len(base), len(other), one.tolist(), two.tolist(), (two & third).tolist(), (two | third).tolist(), links))
    df = spark.createDataFrame(rows, "n1 long, n2 long, x array<long>, y array<long>, every array<long>, some array<long>, links boolean")
    alone, among = (df.filter("links").filter(J._parity_allows("n1", "x", "x", "n2", *both)).count() for both in (("y", "y"), ("every", "some")))
    assert alone == among == df.filter("links").count() > 50
    assert df.filter("not links").filter(J._parity_allows("n1", "x", "x", "n2", "y", "y")).count() < 0.3 * df.filter("not links").count()
