"""CSV files to documents with open metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.errors import EmptyCorpusError
from textloom.functions.binding import quoted
from textloom.operators.numbering import number_in_file_order
from textloom.sources.quoted_csv import read_quoted_csv

# The numeric key of a row that its documents' ids follow from.
KEY = "_tl_id"

_POSITION = ("_tl_file", "_tl_block", "_tl_seen")


def read_rows_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """CSV rows as strings: the header names the columns, empty lines are skipped, nothing is inferred.

    Files read together must share one header; a differing one is an error. ``multi_line=True`` allows line
    breaks inside quotes but makes one task read each file; :func:`read_numbered_csv` reads such files in parallel.
    """
    rows = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return rows.withColumnsRenamed({name: name.lstrip("\ufeff") for name in rows.columns if name.startswith("\ufeff")})


def read_numbered_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """:func:`read_rows_csv` with a dense ``row_id`` in file order.

    With ``multi_line``, byte ranges of a file are read in parallel and the numbers follow from the files; nothing is stored.
    """
    rows = read_rows_csv(spark, path, sep, multi_line)
    if multi_line:
        return read_quoted_csv(spark, path, rows.columns, sep)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias(_POSITION[0]),
        F.col("_metadata.file_block_start").alias(_POSITION[1]),
        F.monotonically_increasing_id().alias(_POSITION[2]),
    )
    return number_in_file_order(placed, *_POSITION, name="row_id")


def keyed_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``id_col`` as the whole number ``KEY``; an error in the data, such as a key that is no number, fails the read."""
    return rows.withColumnRenamed(id_col, KEY).withColumn(KEY, F.col(KEY).cast("long"))


def with_metadata_map(df: DataFrame, text_col: str, drop: Sequence[str] = ()) -> DataFrame:
    """``text`` from ``text_col`` and ``metadata`` from every other column, null turned into ``""``.

    A missing text column gives null text. Columns in ``drop`` (ids, set keys) stay as they are and stay
    out of the metadata.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit("")) if text_col in df.columns else F.lit(None).cast("string")
    return df.select(*[quoted(c) for c in drop], text.alias("text"), _metadata(df, {text_col, *drop}).alias("metadata"))


def unpivot_text(df: DataFrame, text_cols: Sequence[str], id_col: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """One document per (row, text column), in one scan; the other text columns stay in the metadata.

    With ``id_col`` (a dense row number) each document gets ``doc_id = id * len(text_cols) + column position``.
    """
    if not text_cols:
        raise ValueError("name at least one text column")
    kept = [*([id_col] if id_col else []), *drop]
    entries = [
        F.struct(
            F.lit(i).alias("ix"),
            F.lit(name).alias("text_column"),
            (
                F.coalesce(quoted(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")
            ).alias("text"),
            _metadata(df, {name, *kept}).alias("metadata"),
        )
        for i, name in enumerate(text_cols)
    ]
    documents = df.select(*[quoted(c) for c in kept], F.inline(F.array(*entries)))
    if id_col:
        documents = documents.withColumn("doc_id", quoted(id_col) * len(text_cols) + F.col("ix"))
    ids = ["doc_id"] if id_col else []
    return documents.select(*[quoted(c) for c in drop], *ids, "text_column", "text", "metadata")


def read_documents_csv(
    spark: SparkSession, path: str | Sequence[str], text_cols: Sequence[str], sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """Documents ``(doc_id, text_column, text, metadata)`` from CSV files, one per row and text column."""
    return unpivot_text(read_numbered_csv(spark, path, sep, multi_line), text_cols, id_col="row_id")


def require_documents(df: DataFrame) -> DataFrame:
    """``df`` itself, or :class:`EmptyCorpusError` when it has no rows."""
    if df.isEmpty():
        raise EmptyCorpusError("nothing to ingest: no row was read from the input")
    return df


def _metadata(df: DataFrame, leave_out: set[str]):
    pairs = []
    for name in df.columns:
        if name not in leave_out:
            pairs += [F.lit(name), F.coalesce(quoted(name).cast("string"), F.lit(""))]
    return F.create_map(*pairs).cast("map<string,string>")
