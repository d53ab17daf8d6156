import gzip
import hashlib
import random

from pyspark.sql import functions as F

from textloom.llm import warc as W


def record(content: bytes, kind: str = "response", **headers: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Block-Digest: sha1:{hashlib.sha1(content).hexdigest()}", f"Content-Length: {len(content)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parts(data):
    return [(offset, length, None if headers is None else block, reason) for offset, length, headers, block, reason in W.salvage(data)]


def test_whole_archives_have_no_gap():
    a, b = record(b"one"), record(b"WARC/1.1\r\nnot a record")
    assert parts(a + b) == [(0, len(a), b"one", None), (len(a), len(b), b"WARC/1.1\r\nnot a record", None)]
    assert parts(b"") == []


def test_damage_costs_the_damaged_record_alone():
    a, b, c = record(b"first" * 50), record(b"second" * 50), record(b"third" * 50)
    for damaged in (b.replace(b"second", b"sekond", 1), b[:-40], b.replace(b"Content-Length: 300", b"Content-Length: 9999"), b[20:], b.replace(b"WARC/1.1", b"XARC/1.1"), b.replace(b"Content-Length", b"Kontent-Length")):
        found = parts(a + damaged + c)
        assert [p[2] for p in found] == [b"first" * 50, None, b"third" * 50]
        assert found[1][:2] == (len(a), len(damaged)) and found[1][3]
    assert [p[:3] for p in parts(a + b[:-100])] == [(0, len(a), b"first" * 50), (len(a), len(b) - 100, None)]
    assert parts(b[:100]) == [(0, 100, None, "headers do not end")]
    assert [p[2] for p in parts(b"junk" + a)] == [None, b"first" * 50]


def test_version_lines_inside_damaged_blocks_do_not_start_false_records():
    inner = record(b"inner")
    broken = record(b"x" + inner[:-4] + b"!!" + b"y").replace(b"x", b"z", 1)
    after = record(b"after")
    found = parts(broken + after)
    assert found[-1][2] == b"after" and sum(p[1] for p in found) == len(broken + after)


def test_gzip_members():
    members = [W.gzip_member(record(t * 40)) for t in (b"first", b"second", b"third")]
    assert [p[2] for p in parts(b"".join(members))] == [b"first" * 40, b"second" * 40, b"third" * 40]
    hurt = bytearray(members[1])
    hurt[len(hurt) // 2] ^= 255
    found = parts(members[0] + bytes(hurt) + members[2])
    assert [p[2] for p in found] == [b"first" * 40, None, b"third" * 40]
    assert found[1][:2] == (len(members[0]), len(hurt))
    assert [p[2] for p in parts(members[0] + members[1][:-5])][-1] is None
    assert [p[2] for p in parts(b"noise" + members[2])] == [None, b"third" * 40]


def test_a_bad_record_in_a_member_of_many_costs_itself_alone():
    records = [record(bytes([97 + i]) * 200) for i in range(6)]
    hurt = records[2].replace(b"ccc", b"cXc", 1)
    content = b"".join([*records[:2], hurt, *records[3:]])
    for data in (W.gzip_member(content), gzip.compress(content), W.gzip_member(records[0]) + W.gzip_member(content) + W.gzip_member(records[5])):
        found = parts(data)
        kept = [p[2][:1] for p in found if p[2] is not None]
        assert b"".join(kept) in (b"abdef", b"aabdeff")
        (gap,) = [p for p in found if p[2] is None]
        assert gap[3] == f"bytes {2 * len(hurt)} to {3 * len(hurt)} of the member: block digest differs"


def test_a_damaged_member_gives_what_stands_before_the_damage():
    draw = random.Random(3)
    records = [record(bytes(draw.randrange(256) for _ in range(3000))) for _ in range(20)]
    plain = [W.salvage(r).__next__()[3] for r in records]
    data = bytearray(gzip.compress(b"".join(records)))
    data[len(data) // 2] ^= 255
    behind = W.gzip_member(record(b"behind"))
    for cut in (bytes(data), bytes(data[: len(data) // 2])):
        found = parts(cut + behind)
        kept = [p[2] for p in found if p[2] is not None]
        # Random bytes are stored as they are, so a changed one may cost its record alone; a cut costs all behind it.
        assert 7 <= len(kept) - 1 <= 19 and kept == [*[p for p in plain if p in kept], b"behind"]
        (gap,) = [p for p in found if p[2] is None]
        assert gap[:2] == (0, len(cut)) and gap[3]
    two = parts(bytes(data) + bytes(data) + behind)
    assert [p[2] for p in two].count(None) == 2 and two[-1][2] == b"behind"


def test_a_member_above_the_bound_is_read_up_to_it(monkeypatch):
    monkeypatch.setattr(W, "LARGEST_MEMBER", 1000)
    found = parts(W.gzip_member(record(b"a" * 300) + record(b"b" * 5000)) + W.gzip_member(record(b"c")))
    assert [p[2] and p[2][:1] for p in found] == [b"a", None, b"c"] and found[1][3] == "member is too large"


def test_pages_come_back(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(1, "http://a/", big), (5, "http://b/ x\r\n", big), (3, None, big), (2, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, whole long")
    W.write_warc(pages, str(tmp_path / "a"))
    found = {r.page: r for r in W.read_warc(spark, str(tmp_path / "a")).withColumn("page", W.page_of(F.col("record_id"))).collect()}
    assert set(found) == set(range(1, 9)) and all(r.reason is None for r in found.values())
    for page, _, html in rows:
        raw = (html or "").encode()
        assert found[page].payload_bytes == len(raw) and found[page].payload_digest == "sha1:" + hashlib.sha1(raw).hexdigest()
    assert {p: found[p].record_type for p in (1, 3, 5, 6, 7)} == {1: "revisit", 3: "revisit", 5: "response", 6: "response", 7: "response"}
    assert found[1].refers_to == "urn:textloom:page:5" and bytes(found[8].payload) == rows[-1][2].encode()
    assert found[5].target_uri == "http://b/%20x%20%20"


def test_damaged_files_are_read_around(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record(b"a") + b"garbage" + record(b"b"))
    (tmp_path / "y.warc.gz").write_bytes(W.gzip_member(record(b"c"))[:-3] + W.gzip_member(record(b"d")))
    rows = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload).decode() for r in rows if r.record_type != "gap") == ["a", "b", "c", "d"]  # c is whole, its member's checksum is cut off
    assert sorted((r.length, bool(r.reason)) for r in rows if r.record_type == "gap")[0] == (7, True)


def test_empty_table_and_null_keys(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_warc(pages, str(tmp_path / "none"))
    assert W.read_warc(spark, str(tmp_path / "none")).count() == 0
    W.write_warc(spark.createDataFrame([(None, None, "x" * 2000), (1, None, "x" * 2000), (None, None, None)], pages.schema), str(tmp_path / "null"))
    rows = W.read_warc(spark, str(tmp_path / "null")).collect()
    assert sorted((r.record_id, r.record_type) for r in rows) == [("urn:textloom:page:1", "response"), ("urn:textloom:page:none", "response"), ("urn:textloom:page:none", "revisit")]
