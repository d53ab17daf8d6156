import pytest
from pyspark.sql import functions as F

from textloom.functions.predicates import predicate
from textloom.operators.filtering import MetadataFilter, apply_filters, promote_keys

ROWS = [
    (0, {"n": "9", "s": "Red Wine"}, ["a", "b"]),
    (1, {"n": "10", "s": "white"}, ["b"]),
    (2, {"n": "many", "s": ""}, []),
    (3, {}, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, metadata map<string,string>, tags array<string>").cache()


def kept(df, *filters):
    return sorted(r["id"] for r in apply_filters(df, filters).collect())


@pytest.mark.parametrize(
    ("test", "expected"),
    [
        (("n", "==", 9), [0]),
        (("n", "==", "9"), [0]),
        (("n", "!=", 9), [1, 2, 3]),
        (("n", ">", 9), [1]),
        (("n", ">", "9"), [2]),
        (("n", "<", 10), [0]),
        (("n", "<", "9"), [1]),
        (("n", ">=", 9), [0, 1]),
        (("n", "<=", 9.5), [0]),
        (("n", "in", [9, 10]), [0, 1]),
        (("n", "in", []), []),
        (("n", "nin", [9, 10]), [2, 3]),
        (("n", "nin", []), [0, 1, 2, 3]),
        (("n", "any", ["9", "many"]), [0, 2]),
        (("tags", "any", ["a", "z"]), [0]),
        (("tags", "all", ["a", "b"]), [0]),
        (("tags", "all", ["b"]), [0, 1]),
        (("n", "all", ["9"]), [0]),
        (("s", "text_match", "WINE"), [0]),
        (("tags", "text_match", "B"), [0, 1]),
        (("s", "contains", "Wine"), [0]),
        (("s", "contains", "wine"), []),
        (("tags", "contains", "b"), [0, 1]),
        (("s", "is_empty"), [2, 3]),
        (("tags", "is_empty"), [2, 3]),
    ],
)
def test_each_operator(rows, test, expected):
    assert kept(rows, test) == expected


def test_conjunction_and_empty_list(rows):
    assert kept(rows, MetadataFilter("n", ">", 0), ("tags", "contains", "a")) == [0]
    assert kept(rows) == [0, 1, 2, 3]


def test_unknown_operator(rows):
    with pytest.raises(ValueError, match="like"):
        apply_filters(rows, [("n", "like", "x")])


def test_native_columns_compare_as_numbers_and_reach_the_scan(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") % 5).cast("int").alias("size")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert kept(df, ("size", ">=", 4)) == [4, 9, 14, 19]
    assert kept(df, ("size", "in", [0]), ("size", "!=", 1)) == [0, 5, 10, 15]
    plan = apply_filters(df, [("size", ">=", 4)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size,4)" in plan


def test_promoted_keys_reach_the_scan(spark, rows, tmp_path):
    promote_keys(rows, ["s"]).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    found = apply_filters(df, [("s", "==", "white")])
    assert [r["id"] for r in found.collect()] == [1]
    assert "EqualTo(`meta:s`,white)" in found._jdf.queryExecution().executedPlan().toString()


def test_predicate_on_plain_column(rows):
    assert rows.filter(predicate(F.col("metadata")["n"], "==", "10")).count() == 1
