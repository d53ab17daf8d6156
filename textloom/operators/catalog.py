"""Catalogue queries and document look-ups as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.errors import DocumentNotFoundError
from textloom.operators.stats import count_documents
from textloom.session import broadcast_if_small


def list_sets(sets: DataFrame, docs: DataFrame | None = None, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of set descriptors, newest first, with ``total_documents`` and the ``total`` number of sets.

    ``sets`` holds ``set_id, upload_date`` and any other descriptor columns. With ``docs`` (one row per document,
    with ``set_id``) the documents are counted; without, ``sets`` must carry ``total_documents``.
    """
    page, page_size = max(1, page), max(1, page_size)
    total = sets.agg(F.count("*")).scalar()
    descriptors = [c for c in sets.columns if c != "total_documents"]
    rows = sets.orderBy(F.desc("upload_date"), "set_id").offset((page - 1) * page_size).limit(page_size)
    if docs is not None:
        # The page is cut first: only its sets are counted.
        rows = rows.select(*descriptors)
        counts = count_documents(docs.join(broadcast_if_small(rows.select("set_id")), "set_id", "left_semi"))
        rows = rows.join(counts, "set_id", "left")
    counted = F.coalesce("total_documents", F.lit(0)).alias("total_documents")
    return rows.select(*descriptors, counted, total.alias("total"))


def get_set(sets: DataFrame, set_id) -> DataFrame:
    """The descriptor of one set: one row, or none when it is missing."""
    return sets.filter(F.col("set_id") == set_id)


def without_set(df: DataFrame, set_id) -> DataFrame:
    """All rows but those of one set."""
    return df.filter(~F.col("set_id").eqNullSafe(F.lit(set_id)))


def get_documents(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose ``key`` is in ``ids``; ids that are missing are :func:`missing_documents`."""
    return docs.join(broadcast_if_small(ids.select(key).distinct()), key, "left_semi")


def missing_documents(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that no document has."""
    wanted = ids.select(key).distinct()
    # The wanted ids are the small side: find those present by scanning the corpus against them, then subtract.
    present = docs.select(key).join(broadcast_if_small(wanted), key, "left_semi").distinct()
    return wanted.join(present, key, "left_anti")


def require_all_documents(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`get_documents`, or :class:`DocumentNotFoundError` naming a few of the missing ids."""
    missing = [row[0] for row in missing_documents(docs, ids, key).limit(5).collect()]
    if missing:
        raise DocumentNotFoundError(f"documents not found: {', '.join(map(str, missing))}")
    return get_documents(docs, ids, key)


def upsert_documents(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``old`` with every document of ``new`` (one row per key) added or, where the key exists, replaced."""
    replaced = broadcast_if_small(new.select(*keys).distinct())
    return old.join(replaced, list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_descriptors(docs: DataFrame, set_id: Column, upload_date: Column) -> DataFrame:
    """Descriptor rows derived from a documents table: one per set, dated by its latest document."""
    return docs.select(set_id.alias("set_id"), upload_date.alias("at")).groupBy("set_id").agg(F.max("at").alias("upload_date"))
