import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from odd_inputs import prose

from textloom.llm import repeats as R


def brute(rows):
    """Rows in order of key (null first); equal rows are one document."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected, got = brute(rows), R.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == expected[r.doc_id], r.doc_id


def test_merging_shards_of_any_size_finds_the_equal_strings():
    draw = random.Random(1)
    base = [bytes(draw.choice(b"abc") for _ in range(400)) for _ in range(5)]
    segments = []
    for _ in range(40):
        own = bytearray(draw.choice(base)[draw.randrange(100) :][: draw.randrange(150, 280)])
        own[draw.randrange(len(own))] = draw.choice(b"abz\0")
        segments.append(bytes(own))
    for shard_bytes in (1, 700, 1 << 20):
        interval, offsets = R.merged_intervals(segments, shard_bytes=shard_bytes)
        forth, back = {}, {}
        for i, segment in enumerate(segments):
            for j in range(len(segment) - 99):
                window, number = segment[j : j + 100], int(interval[offsets[i] + j])
                assert forth.setdefault(window, number) == number and back.setdefault(number, window) == window


def shared_passages(spark):
    draw, passages = random.Random(3), [prose(i, 40) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(100 + i, draw.randint(0, 60))] + [draw.choice(passages)[draw.randrange(30) :] for _ in range(draw.randint(0, 3))] + [prose(300 + i, 5)]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[3][1]), (61, "z" * 500), (62, "ab " * 90), (63, "xy" + "ab " * 90), (64, "ä" * 130), (65, "x" + "ä" * 130)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_removal_equals_brute_force(spark):
    check(shared_passages(spark))


def test_hot_anchors_take_the_other_way_to_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_SEGMENTS", 2)
    check(shared_passages(spark))


def test_merging_takes_little_memory_however_many_segments_a_task_has():
    draw = np.random.default_rng(4)
    n = 25_000
    raw = [draw.integers(97, 123, 140, np.uint8).tobytes() for _ in range(n // 2)]
    columns = {"anchor": np.arange(n) // 2, "key": np.arange(n), "at": np.zeros(n, int), "windows": np.full(n, 41), "bytes": [raw[i // 2] for i in range(n)]}
    tracemalloc.start()
    removed = sum(b.num_rows for b in R._merge_batches(iter(pa.RecordBatch.from_pydict(columns).slice(i, 1000) for i in range(0, n, 1000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert removed == n // 2 and peak < 120e6


def test_copies_of_a_text_bring_one_segment_each(spark, monkeypatch):
    words = prose(5, 80).split()
    one, other = " ".join(words), " ".join([*words[:60], "other", *words[61:]])
    rows = [(i, one) for i in range(200)] + [(200 + i, other) for i in range(200)] + [(0, one), (None, one), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    merged = R._merge_batches

    def counted(batches):
        batches = list(batches)
        held = [(b, a) for batch in batches for b, a in zip(batch.column("bytes").to_pylist(), batch.column("anchor").to_pylist())]
        assert len(set(held)) == len(held), "a segment is fetched from several copies"
        yield from merged(iter(batches))

    monkeypatch.setattr(R, "_merge_batches", counted)
    check(df)


def test_odd_rows(spark, odd, nothing):
    check(odd)
    assert R.remove_repeats(nothing).count() == 0


def test_the_whole_query(spark):
    from textloom.llm.queries import op5_repeats

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_repeats(spark, folder).collect()} == {k: v[:4] for k, v in expected.items()}
