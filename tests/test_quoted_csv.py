import random
from collections import Counter

import numpy as np
import pytest

from textloom.sources import csv
from textloom.sources import quoted_csv as Q


def spark_rows(spark, path, sep=","):
    return csv.read_rows_csv(spark, path, sep, multi_line=True)


def same(spark, path, tasks=None, sep=",", in_order=True):
    """Rows equal Spark's multi-line reader, in file order."""
    expected = spark_rows(spark, path, sep)
    got = Q.read_quoted_csv(spark, path, expected.columns, sep).orderBy('row_id')
    ours = [tuple(r[c] for c in expected.columns) for r in got.collect()]
    theirs = [tuple(r) for r in expected.collect()]
    assert [r.row_id for r in got.select("row_id").collect()] == list(range(len(ours)))
    if in_order:
        assert ours == theirs, [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
    assert Counter(ours) == Counter(theirs)
    if tasks:
        assert Q._lines(spark, path, sep).rdd.getNumPartitions() >= tasks
    return ours


CELLS = ["", "a", "plain text", '"q"', '""', '"two\nlines"', '"a ""b"" c"', '"comma, in"', '"\n\n"', '"x\n""\ny,"', 'mid"quote', "5\" pipe", '"ends ""with"""', '"' + "long " * 30 + '\nmore"', "ä漢😀", '" lead"', "007"]


def text_of(draw, records, eol="\n"):
    lines = ["k,text,note"]
    for _ in range(records):
        if draw.random() < 0.1:
            lines.append("")
        lines.append(",".join(draw.choice(CELLS) for _ in range(draw.choice([3, 3, 3, 2, 1, 4]))) or "z")
    return eol.join(line.replace("\n", eol) for line in lines) + (eol if draw.random() < 0.5 else "")


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of about 2 KB, so that a small file has many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,eol", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_rows_equal_sparks_reader(spark, tmp_path, small_ranges, seed, eol):
    path = tmp_path / "a.csv"
    path.write_bytes(text_of(random.Random(seed), 800, eol).encode())
    rows = same(spark, str(path), tasks=8)
    assert any(r[1] and "\n" in r[1] for r in rows)


def test_a_cell_across_many_ranges(spark, tmp_path, small_ranges):
    cell = "\n".join(f'line {i} with ""quotes"", commas' for i in range(900))
    path = tmp_path / "a.csv"
    path.write_text(f'k,text,note\n1,first,a\n2,"{cell}",b\n3,"x\ny",c\n4,"{cell}","{cell}"\n5,last,d\n')
    rows = same(spark, str(path), tasks=20)
    assert len(rows) == 5 and rows[1][1] == cell.replace('""', '"')


def test_several_files_separator_bom_and_empty_lines(spark, tmp_path, small_ranges):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(("﻿" if i == 0 else "") + f'k;text\n{i};"a\n;{i}"\n\n\n9;"z"\n' + "7;8\n" * 700, encoding="utf-8")
    assert len(same(spark, str(tmp_path), sep=";", in_order=False)) == 3 * 702
    path = tmp_path / "sub"
    path.mkdir()
    (path / "a.csv").write_text("k,text\n")
    assert same(spark, str(path)) == []


def test_an_open_quote_at_the_end(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('k,text\n1,a\n2,"open\nto the end\n')
    got = Q.read_quoted_csv(spark, str(path), ["k", "text"]).orderBy('row_id').collect()
    assert [(r.k, r.text.rstrip("\n").lstrip('"')) for r in got] == [("1", "a"), ("2", "open\nto the end")]


def test_a_differing_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,text\n1,a\n")
    with pytest.raises(Exception, match="header"):
        Q.read_quoted_csv(spark, str(tmp_path / "a.csv"), ["k", "other"]).collect()


def test_maps_compose_as_lines_follow_each_other():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n = int(draw.integers(1, 30))
        outside, inside = draw.random(n) < 0.4, draw.random(n) < 0.6
        for start in (False, True):
            state, expected = start, []
            for i in range(n):
                expected.append(state)
                state = bool(inside[i] if state else outside[i])
            got, end = Q._starts(outside, inside, start)
            assert got.tolist() == expected and end == state


def test_a_line_of_many_cells_is_passed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,text\n" + '"' + '""' * 200_000 + '",' + "x" * 300_000 + "\n" + '1,"' + '""' * 5 + '\n"\n')
    assert len(same(spark, str(tmp_path / "a.csv"))) == 2


def test_a_preview_and_an_ingest_store_no_copy_of_the_rows(spark, tmp_path, monkeypatch):
    from textloom.operators import numbering, retrieval
    from textloom.operators.stats import middle_documents
    from textloom.plans.corpus import Corpus, IngestConfig

    def refuse(df):
        raise AssertionError("rows were stored")

    monkeypatch.setattr(numbering, "durable", refuse)
    monkeypatch.setattr(retrieval, "durable", refuse)
    path = tmp_path / "a.csv"
    path.write_text("k,text\n" + "".join(f'{i},"text {i}\nin two lines"\n' for i in range(25)))
    corpus, config = Corpus(spark, str(tmp_path / "store")), IngestConfig(text_columns=("text",))
    shown, cost = corpus.preview_csv(str(path), config)
    middle = middle_documents(csv.read_documents_csv(spark, str(path), ["text"]))
    assert sorted(r.doc_id for r in shown.collect()) == sorted(r.doc_id for r in middle.collect()) == list(range(12, 22))
    assert cost.first()["token_count"] == 125
    set_id = corpus.ingest_csv(str(path), "s", config)
    assert corpus.store.open_documents(set_id).count() == 25
