import hashlib
import random
import re

import numpy as np
from odd_inputs import prose

from textloom.llm import arrays as A
from textloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(len(own), 13)
        for i in range(max(len(own) - 12, 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for key, text in documents:
        own, hit, met = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                found = windows.get(tuple(own[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    met |= found
        listed = ",".join(sorted(str(m) for m in met if m is not None))
        out.append((key, len(own), len(hit), len({m for m in met if m is not None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def check(documents, items):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = [tuple(r) for r in items.select("item_id", "text").collect()]
    got = sorted((tuple(r)[:6] for r in D.contamination(documents, items).collect()), key=str)
    assert got == brute(docs, rows)


def test_every_window_of_shared_words_is_marked():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 1 << 63, 13).astype(np.uint64)
    for size in (13, 40, 200):
        marks = []
        for _ in range(2):
            at = int(draw.integers(0, size - 12))
            own = draw.integers(0, 1 << 63, size).astype(np.uint64)
            own[at : at + 13] = shared
            grams = A.gram_hashes(own, D.GRAM)
            picks = D.selected(grams, np.zeros(size, int))
            marks.append({int(grams[p]) for p in picks if at <= p <= at + 8})
        assert marks[0] & marks[1]


def cases(spark):
    draw = random.Random(9)
    items = [(i, prose(i, n)) for i, n in enumerate([40, 13, 14, 12, 5, 1, 60, 13])] + [(8, None), (9, ""), (10, prose(0, 40)), (11, "the " * 30), (12, prose(5, 1).upper() + "!")]
    documents = []
    for i in range(40):
        own = words(prose(1000 + i, draw.choice([20, 100, 400])))
        for _ in range(draw.randint(0, 3)):
            source = words(items[draw.randrange(len(items))][1])
            low = draw.randint(0, max(len(source) - 5, 0))
            at = draw.randrange(len(own))
            own[at:at] = source[low : low + draw.randint(5, 40)]
        documents.append((i, ", ".join(own).title()))
    documents += [(100, "the " * 200), (101, items[0][1]), (102, items[0][1]), (103, "é" + items[6][1] + "é")]
    return spark.createDataFrame(documents, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_hits_equal_brute_force(spark):
    check(*cases(spark))


def test_odd_rows(spark, odd, nothing):
    items = odd.select(odd["doc_id"].alias("item_id"), "text", "key")
    check(odd, items.drop("key"))
    got = D.contamination(odd, items.limit(0)).collect()
    assert len(got) == odd.count() and not any(r.contaminated for r in got)
    assert D.contamination(nothing, items).count() == 0
    kept = D.without_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {3, 4, 5, None}
