import datetime

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_token_count(spark):
    texts = ["", "   ", "one two", "it's 3.14!", "naïve Straße", "a--b ... c"]
    assert values(spark, texts, X.token_count) == [0, 0, 2, 7, 2, 5]


def test_strip_blank_takes_unicode_blanks(spark):
    assert values(spark, ["﻿  a b  \n", "\t\x0b\n", "a\u0085"], X.strip_blank) == ["a b", "", "a\u0085"]


def test_sanitize_and_capitalize(spark):
    assert values(spark, ["My set (2).csv", "é1"], X.sanitize_name) == ["My_set__2__csv", "_1"]
    assert values(spark, ["hello World", "x", "", None], X.capitalize_first) == ["Hello World", "X", "", None]


@pytest.mark.parametrize(
    ("secret", "masked"),
    [
        ("a" * 8 + "zz" + "b" * 8, "a" * 8 + "*******" + "b" * 8),
        ("x" * 17, "x" * 8 + "*******" + "x" * 8),
        ("x" * 16, "x" * 16),
        ("short", "short"),
        ("", None),
        (None, None),
    ],
)
def test_mask_middle(spark, secret, masked):
    assert values(spark, [secret], X.mask_middle) == [masked]


def test_timestamps_and_json(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 5, 6, 7, 8, 9, 123000), '{"a": "1"}')], "ts timestamp, j string")
    iso, back, params, bad, text = df.select(
        X.iso_timestamp(F.col("ts")).alias("iso"),
        (X.parse_iso_timestamp(X.iso_timestamp(F.col("ts"))) == F.col("ts")).alias("back"),
        X.params_from_json(F.col("j")).alias("p"),
        X.parse_iso_timestamp(F.lit("no date")).alias("bad"),
        X.params_to_json(X.params_from_json(F.col("j"))).alias("t"),
    ).first()
    assert iso.endswith(":08:09.123Z") and back and params == {"a": "1"} and bad is None and text == '{"a":"1"}'
