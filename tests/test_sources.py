import pytest
from pyspark.sql import functions as F

from textloom.errors import EmptyCorpusError
from textloom.operators.numbering import number_in_order, slice_by_position
from textloom.sources import csv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [(r["text"], r["metadata"]) for r in df.orderBy("doc_id").collect()]


def test_plain_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "text,m1,m2\none,a,b\ntwo,c,d\n")
    assert rows(csv.read_documents_csv(spark, path, ["text"])) == [("one", {"m1": "a", "m2": "b"}), ("two", {"m1": "c", "m2": "d"})]


def test_missing_cells_quotes_blank_lines_and_short_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿text,m1,m2\noak,,late\nelm,early,\n\n"say ""hi"",\nthere",x,y\nshort\n007,1.0,true\n')
    assert rows(csv.read_documents_csv(spark, path, ["text"])) == [
        ("oak", {"m1": "", "m2": "late"}),
        ("elm", {"m1": "early", "m2": ""}),
        ('say "hi",\nthere', {"m1": "x", "m2": "y"}),
        ("short", {"m1": "", "m2": ""}),
        ("007", {"m1": "1.0", "m2": "true"}),
    ]


def test_missing_text_column_gives_null_text(spark, tmp_path):
    path = write(tmp_path / "a.csv", "m1,m2\na,b\n")
    assert rows(csv.read_documents_csv(spark, path, ["text"])) == [(None, {"m1": "a", "m2": "b"})]


def test_no_rows(spark, tmp_path):
    df = csv.read_documents_csv(spark, write(tmp_path / "a.csv", "text,m1\n"), ["text"])
    assert df.count() == 0
    with pytest.raises(EmptyCorpusError):
        csv.require_documents(df)


def test_odd_column_names_and_separator(spark, tmp_path):
    path = write(tmp_path / "a.csv", "my.text;a `b`\nhello;x\n")
    assert rows(csv.read_documents_csv(spark, path, ["my.text"], sep=";")) == [("hello", {"a `b`": "x"})]


def test_several_text_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "q,a,k\nq0,a0,k0\nq1,a1,k1\n")
    docs = csv.read_documents_csv(spark, path, ["q", "a"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text_column"], r["text"]) for r in docs] == [(0, "q", "q0"), (1, "a", "a0"), (2, "q", "q1"), (3, "a", "a1")]
    assert docs[0]["metadata"] == {"a": "a0", "k": "k0"} and docs[3]["metadata"] == {"q": "q1", "k": "k1"}
    with pytest.raises(ValueError):
        csv.unpivot_text(spark.range(1), [])


@pytest.mark.parametrize("multi_line", [True, False])
def test_ids_follow_file_order(spark, tmp_path, multi_line):
    for name, start, n in (("b", 40, 7), ("a", 0, 40), ("c", 47, 500)):
        write(tmp_path / f"{name}.csv", "text\n" + "".join(f"t{i}\n" for i in range(start, start + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        docs = csv.read_documents_csv(spark, str(tmp_path), ["text"], multi_line=multi_line).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["doc_id"], r["text"]) for r in docs) == [(i, f"t{i}") for i in range(547)]


def test_differing_headers_are_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", "text,x\n1,2\n")
    write(tmp_path / "b.csv", "x,text\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.read_documents_csv(spark, str(tmp_path), ["text"]).collect()


def test_number_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = number_in_order(df.repartition(6), ["g", F.desc("k")]).collect()
    expected = sorted(((r["g"], -r["k"]) for r in got))
    assert sorted((r["idx"], r["g"], -r["k"]) for r in got) == [(i, g, k) for i, (g, k) in enumerate(expected)]


@pytest.mark.parametrize("direct", [100_000, 3])
def test_slice_by_position(spark, monkeypatch, direct):
    from textloom.operators import numbering

    monkeypatch.setattr(numbering, "_DIRECT_ROWS", direct)
    dense = spark.range(5, 105)
    assert sorted(r[0] for r in slice_by_position(dense, "id", lambda n: n // 2, 10).collect()) == list(range(55, 65))
    keys = sorted({(i * i * i * 10**12) % (2**62) - 2**61 for i in range(60)} | {-(2**63), 2**63 - 1} | set(range(40)))
    sparse = spark.createDataFrame([(k,) for k in keys], "id long")
    for start, n in ((0, 5), (37, 10), (len(keys) - 3, 10), (len(keys), 4)):
        assert sorted(r[0] for r in slice_by_position(sparse, "id", start, n).collect()) == keys[start : start + n]
    assert slice_by_position(dense.limit(0), "id", 0, 5).count() == 0
