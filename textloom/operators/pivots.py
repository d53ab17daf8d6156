"""A pivot index over vectors: exact top-k that reads only the clusters which can hold a hit.

Each vector belongs to its nearest pivot and is stored with the angle to it, clustered by both. Angles obey the triangle inequality:
a vector at angle ``a`` from a pivot that is at angle ``t`` from the query is at least ``|t - a|`` away from the query. So the
clusters nearest to the query are ranked first; after that only vectors whose angle leaves room for a score of the
last place are read.

How much is skipped depends on the data: vectors that gather in directions are skipped by clusters, evenly spread ones in many
dimensions hardly at all. :func:`skipped` tells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.vectors import SCORE_DECIMALS
from textloom.operators.filtering import MetadataFilter, apply_filters
from textloom.operators.retrieval import page_of, search
from textloom.session import ship_package

# Pivots of an index at most; each is one vector that every task of a build gets.
MOST_PIVOTS = 4096

# Hits that a page may end at; later pages are ranked by a plain scan.
MOST_WANTED = 10_000

# Angles are computed in double precision; near zero that leaves about half the digits.
_SLACK = 1e-6

# Vectors without a direction: they score 0, or are not ranked.
NO_PIVOT = -1


@dataclass(frozen=True)
class PivotIndex:
    """The clustered rows, with ``pivot`` and ``angle``, and one row per cluster: ``pivot, vector, rows, least, most``."""

    rows: DataFrame
    clusters: DataFrame


def choose_pivots(vectors: DataFrame, embedding: str = "embedding", most: int = MOST_PIVOTS) -> np.ndarray:
    """About sqrt(n) vectors, drawn by a hash of the vector, scaled to length 1; those without a direction are left out."""
    held = vectors.select(embedding).filter(F.col(embedding).isNotNull())
    count = min(most, math.isqrt(held.count()))
    drawn = held.orderBy(F.xxhash64(embedding)).limit(count).collect()
    if not drawn:
        return np.zeros((0, 0))
    matrix = np.array([r[0] for r in drawn], np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(lengths) & (lengths > 0)
    return np.unique(matrix[usable] / lengths[usable, None], axis=0) if usable.any() else np.zeros((0, matrix.shape[1]))


def assign_pivots(vectors: DataFrame, pivots: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``pivot``, the number of the nearest one, and ``angle`` to it; vectors without a direction get ``NO_PIVOT`` and null."""
    ship_package(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, angle = np.full(batch.num_rows, NO_PIVOT, np.int32), np.full(batch.num_rows, np.nan)
            column = batch.column(embedding)
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(valid) and len(shared.value):
                matrix = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(valid), -1)
                lengths = np.sqrt((matrix * matrix).sum(axis=1))
                directed = np.isfinite(lengths) & (lengths > 0)
                cosines = (matrix[directed] / lengths[directed, None]) @ shared.value.T
                nearest[valid[directed]] = cosines.argmax(axis=1)
                angle[valid[directed]] = np.arccos(np.clip(cosines.max(axis=1, initial=-1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(angle, from_pandas=True)], names=[*batch.schema.names, "pivot", "angle"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return vectors.mapInArrow(assign, schema)


def cluster(assigned: DataFrame) -> DataFrame:
    """Rows in order of pivot and angle; a large cluster spreads over several ranges of angles."""
    return assigned.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle")


def cluster_table(assigned: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row for each pivot that has vectors, with the number of rows and the bounds of their angles."""
    spark = assigned.sparkSession
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "pivot int, vector array<double>")
    bounds = assigned.groupBy("pivot").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    return bounds.join(vectors, "pivot", "left").select("pivot", "vector", "rows", "least", "most")


def build_index(vectors: DataFrame, folder: str, most: int = MOST_PIVOTS) -> PivotIndex:
    """Write an index of ``vectors`` (any columns, with ``embedding``) below ``folder``."""
    spark = vectors.sparkSession
    pivots = choose_pivots(vectors, most=most)
    cluster(assign_pivots(vectors, pivots)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    cluster_table(rows, pivots).coalesce(1).write.parquet(f"{folder}/clusters")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> PivotIndex:
    return PivotIndex(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/clusters"))


@dataclass(frozen=True)
class _Cluster:
    pivot: int
    rows: int
    distance: float | None  # angle between query and pivot
    best: float  # no vector of the cluster scores above this


def _clusters(table: DataFrame, query: Sequence[float]) -> list[_Cluster]:
    """Clusters with their best possible score, best first. The table has at most ``MOST_PIVOTS + 1`` rows."""
    unit = np.asarray(query, np.float64)
    length = np.sqrt(unit @ unit)
    out = []
    for r in table.collect():
        if r.vector is None or not length:
            out.append(_Cluster(r.pivot, r.rows, None, 0.0 if r.vector is None or not length else 1.0))
            continue
        if len(r.vector) != len(unit):
            raise ValueError(f"stored vectors do not all have the query's dimension {len(unit)}")
        distance = math.acos(max(-1.0, min(1.0, float(np.asarray(r.vector) @ unit / length))))
        out.append(_Cluster(r.pivot, r.rows, distance, math.cos(max(0.0, distance - r.most - _SLACK, r.least - distance - _SLACK))))
    return sorted(out, key=lambda c: (-c.best, c.distance if c.distance is not None else math.inf))


def _in_clusters(rows: DataFrame, clusters: Sequence[_Cluster], least: float | None = None) -> DataFrame:
    """Rows of the clusters; with ``least``, only those whose angle leaves room for that score.

    The numbers and the widest range of angles reach the scan; each cluster's own range is joined from a small table.
    """
    found = rows.filter(F.col("pivot").isin([c.pivot for c in clusters]))
    if least is None:
        return found
    room = math.acos(max(-1.0, min(1.0, least - 10.0**-SCORE_DECIMALS))) + _SLACK
    ranges = [(c.pivot, 0.0 if c.distance is None else c.distance - room, 9.0 if c.distance is None else c.distance + room) for c in clusters]
    table = rows.sparkSession.createDataFrame(ranges or [(NO_PIVOT - 1, 0.0, 0.0)], "near int, low double, high double")
    low, high = min((r[1] for r in ranges), default=0.0), max((r[2] for r in ranges), default=0.0)
    found = found.filter(F.col("angle").isNull() | F.col("angle").between(low, high))
    joined = found.join(F.broadcast(table), F.col("pivot") == F.col("near"))
    return joined.filter(F.col("angle").isNull() | F.col("angle").between(F.col("low"), F.col("high"))).select(*rows.columns)


def search_index(
    index: PivotIndex, query: Sequence[float], n: int = 10, filters: Sequence[MetadataFilter | tuple] = (), offset: int = 0, id_cols: Sequence[str] = ("doc_id", "chunk_ix"),
) -> DataFrame:
    """The page that :func:`textloom.operators.retrieval.search` gives on the same rows, equal in every row and tie.

    Two scans: the clusters that can score best, as many as hold the wanted rows; then, of the others, what can still beat the last
    of these. Pages beyond ``MOST_WANTED`` hits, and zero queries, take one scan of all rows.
    """
    n, offset = max(1, n), max(0, offset)
    wanted, rows = offset + n + 1, index.rows.drop("norm")
    kept = [c for c in rows.columns if c not in ("pivot", "angle")]
    if wanted > MOST_WANTED or not any(query):
        return search(rows.select(*kept), query, n, filters, offset, id_cols)
    steps = _two_steps(index, query, wanted, filters, id_cols)
    near = rows.sparkSession.createDataFrame(steps.found, _ranked_schema(rows, kept))
    if steps.rest:
        others = _in_clusters(apply_filters(rows, filters), steps.rest, steps.last).select(*kept)
        near = near.unionByName(search(others, query, wanted, (), 0, id_cols).drop("rank", "has_more"))
    return page_of(near, id_cols, n, offset)


def _ranked_schema(rows: DataFrame, kept: Sequence[str]):
    return rows.select(*[c for c in kept if c != "embedding"], F.lit(0.0).cast("double").alias("score")).schema


@dataclass(frozen=True)
class _Steps:
    found: list[Row]  # hits of the clusters ranked first
    rest: list[_Cluster]  # clusters left that can hold better ones
    last: float | None  # the score to beat; none if any score counts
    read: int  # rows of the clusters ranked first


def _two_steps(index: PivotIndex, query: Sequence[float], wanted: int, filters, id_cols: Sequence[str]) -> _Steps:
    clusters = _clusters(index.clusters, query)
    read, taken = 0, 0
    while taken < len(clusters) and read < wanted:
        read += clusters[taken].rows
        taken += 1
    rows = index.rows.drop("norm")
    kept = [c for c in rows.columns if c not in ("pivot", "angle")]
    first = search(_in_clusters(apply_filters(rows, filters), clusters[:taken]).select(*kept), query, wanted, (), 0, id_cols)
    found = first.select(*_ranked_schema(rows, kept).names).collect()  # ``wanted`` rows at most
    last = min(r["score"] for r in found) if len(found) == wanted else None
    return _Steps(found, [c for c in clusters[taken:] if last is None or c.best >= last - 10.0**-SCORE_DECIMALS], last, read)


def skipped(index: PivotIndex, query: Sequence[float], n: int = 10, id_cols: Sequence[str] = ("doc_id", "chunk_ix")) -> float:
    """The share of an index's rows that a search for the first ``n`` does not score."""
    steps = _two_steps(index, query, n + 1, (), id_cols)
    read = steps.read + (_in_clusters(index.rows, steps.rest, steps.last).count() if steps.rest else 0)
    return 1 - read / max(index.clusters.agg(F.sum("rows")).first()[0] or 0, 1)
