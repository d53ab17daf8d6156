"""Metadata filters on tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.binding import quoted
from textloom.functions.predicates import is_number, predicate


# Columns of stored chunks that never answer for a metadata key of the same name.
STORED_COLUMNS = frozenset(
    "set_id version batch doc_id text_column chunk_ix variant text n_tokens is_expanded metadata embedding norm pivot angle text_key owner".split()
)


# Marks a metadata key stored as a column of its own, and the column of its numbers.
PROMOTED, NUMBERS = "meta:", "number:"

_ORDERINGS = frozenset((">", "<", ">=", "<="))


class MetadataFilter(NamedTuple):
    key: str
    operator: str
    value: Any = None


def filter_column(df: DataFrame, key: str) -> tuple[Column, str]:
    """Where a filter key lives: a promoted top-level column if there is one, else an entry of ``metadata``.

    Promoted columns reach the Parquet scan as pushed filters; map entries cannot.
    """
    if PROMOTED + key in df.columns:
        return quoted(PROMOTED + key), "text"
    if key in df.columns and not (key in STORED_COLUMNS and "metadata" in df.columns):
        kind = df.schema[key].dataType
        if isinstance(kind, T.ArrayType):
            return quoted(key), "array"
        return quoted(key), "text" if isinstance(kind, T.StringType) else "native"
    return F.try_element_at("metadata", F.lit(key)), "text"


def promote_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy metadata entries to columns of their own, as text and as numbers (null where they are none), so that filters on them reach the
    Parquet scan."""
    held = [F.try_element_at("metadata", F.lit(key)) for key in keys]
    texts = [value.alias(PROMOTED + key) for key, value in zip(keys, held)]
    return df.select("*", *texts, *[value.try_cast("double").alias(NUMBERS + key) for key, value in zip(keys, held)])


def apply_filters(df: DataFrame, filters: Sequence[MetadataFilter | tuple] = ()) -> DataFrame:
    """Keep rows matching every filter; none means all rows."""
    tests = []
    for key, op, *value in filters:
        wanted = value[0] if value else None
        field, kind = filter_column(df, key)
        if op in _ORDERINGS and is_number(wanted) and NUMBERS + key in df.columns and PROMOTED + key in df.columns:
            # The column of numbers is compared with a double as it is, and so reaches the scan.
            field, kind, wanted = quoted(NUMBERS + key), "native", float(wanted)
        tests.append(predicate(field, op, wanted, kind))
    return df.filter(reduce(and_, tests)) if tests else df
