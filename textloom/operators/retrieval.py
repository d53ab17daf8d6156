"""Similarity search: scoring, ranked pages, many queries at once, and the way back to the documents."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.vectors import SCORE_DECIMALS
from textloom.operators.filtering import MetadataFilter, apply_filters
from textloom.operators.numbering import number_in_order
from textloom.session import broadcast_if_small, durable, ship_package

# Pages ending beyond this position are cut from a distributed sort instead of a top-k.
DEEP_PAGE = 100_000

# Query vectors shipped to every task at once, and scores that a task computes at once.
QUERY_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024


# ---- one query -------------------------------------------------------------------------------------------


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size != len(vectors) * dimension:
        raise ValueError(f"stored vectors do not all have the query's dimension {dimension}")
    return flat.reshape(len(vectors), dimension)


def _cosines(matrix: np.ndarray, unit_columns: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    scores = matrix @ unit_columns
    return np.divide(scores, norms[:, None], out=np.zeros_like(scores), where=norms[:, None] != 0)


def with_score(df: DataFrame, query: Sequence[float], embedding_col: str = "embedding") -> DataFrame:
    """Add ``score``: cosine similarity to a constant query vector, 0 for a zero vector.

    Null where the vector is null or holds what is no number; a vector of another length than the query is an error. All columns pass
    through Arrow, so select what is needed first.
    """
    ship_package(df.sparkSession)
    df = df.drop("score")
    unit = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(unit @ unit))
    unit = unit / length if length else unit

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(embedding_col)
            held = vectors.drop_null()
            out = np.full(len(vectors), np.nan)
            out[vectors.is_valid().to_numpy(zero_copy_only=False)] = _cosines(_matrix(held, len(unit)), unit[:, None])[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=[*batch.schema.names, "score"])

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInArrow(score, schema).withColumn("score", F.round("score", SCORE_DECIMALS))


def search(
    chunks: DataFrame,
    query: Sequence[float],
    n: int = 10,
    filters: Sequence[MetadataFilter | tuple] = (),
    offset: int = 0,
    id_cols: Sequence[str] = ("doc_id", "chunk_ix"),
) -> DataFrame:
    """One ranked page: rows ``[offset, offset + n)`` by falling score, then ``id_cols``.

    Adds ``score``, ``rank`` (from 1 over the whole ranking) and ``has_more``. ``n`` below 1 counts as 1 and a
    negative ``offset`` as 0. Filters apply before ranking. Only ``offset + n + 1`` rows leave the scan tasks. Chunks
    without a score are not ranked. All columns but the vectors are carried along, so select what is needed first.
    """
    n, offset = max(1, n), max(0, offset)
    kept = [c for c in chunks.columns if c not in ("embedding", "norm")]
    scored = with_score(apply_filters(chunks, filters).select(*kept, "embedding"), query).select(*kept, "score")
    # Nulls come last. They are dropped behind the cut.
    order = [F.desc("score"), *id_cols]
    wanted = offset + n + 1
    if wanted > DEEP_PAGE:
        ranked = number_in_order(scored, order, name="rank").withColumn("rank", F.col("rank") + 1).filter("score is not null")
        more = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)) > offset + n).scalar()
    else:
        return page_of(scored, id_cols, n, offset)
    return ranked.withColumn("has_more", more).filter(F.col("rank").between(offset + 1, offset + n))


def page_of(scored: DataFrame, id_cols: Sequence[str], n: int, offset: int = 0) -> DataFrame:
    """The page ``[offset, offset + n)`` of scored rows, with ``rank`` and ``has_more``. Both windows see at most ``offset + n + 1`` rows."""
    order = [F.desc("score"), *id_cols]
    best = scored.orderBy(*order).limit(offset + n + 1).filter("score is not null")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    more = F.max("rank").over(Window.partitionBy(F.lit(0))) > offset + n
    return ranked.withColumn("has_more", more).filter(F.col("rank").between(offset + 1, offset + n))


def hits(page: DataFrame) -> DataFrame:
    """The answer columns of a page: ``rank, text, score, metadata, source_doc_id, has_more``; null score is 0."""
    return page.select(
        "rank",
        "text",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "metadata",
        F.col("doc_id").alias("source_doc_id"),
        "has_more",
    )


def attach_source(
    found: DataFrame, docs: DataFrame, hit_id: str = "doc_id", doc_id: str = "doc_id", prefix: str = "source_", page: bool = False
) -> DataFrame:
    """Hits with their source document's other columns, prefixed; hits without a source keep nulls.

    One left join, in general. With ``page``, the hits are known to be few: they are found once and stored, and only the
    documents that they name take part in the join.
    """
    if page:
        found = durable(found)
        wanted = found.select(F.col(hit_id).alias(doc_id)).filter(F.col(doc_id).isNotNull()).distinct()
        docs = docs.join(broadcast_if_small(wanted), doc_id, "left_semi")
    renamed = docs.select(
        F.col(doc_id).alias("_tl_doc"), *[F.col(c).alias(prefix + c) for c in docs.columns if c != doc_id]
    )
    return found.join(renamed, found[hit_id] == F.col("_tl_doc"), "left").drop("_tl_doc")


# ---- many queries ----------------------------------------------------------------------------------------


def search_batch(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    id_cols: Sequence[str] = ("doc_id", "chunk_ix"),
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` best chunks of every query: ``query_id, rank, id_cols, score``. Exact.

    Chunks are never moved. Query vectors go to every task in slices of at most ``query_bytes`` (by a hash of their ids); each task keeps
    only its ``k`` best per query. Every slice is a scan of its own; the few survivors are ranked last. Vectors that are null or hold
    what is no number are not ranked.
    """
    ship_package(chunks.sparkSession)
    id_types = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in id_cols]
    query_type = queries.schema[query_id].dataType.simpleString()
    out_schema = f"{query_id} {query_type}, {', '.join(id_types)}, score double"
    vectors = queries.select(F.col(query_id), F.col(query_vector).alias("_tl_query")).filter(F.col("_tl_query").isNotNull())
    stored = chunks.select(*id_cols, "embedding")  # null vectors are dropped in the tasks: see _valid

    sizes = vectors.agg(F.count("*"), F.max(F.size("_tl_query"))).first()
    n_queries, dimension = sizes[0], sizes[1] or 0
    slices = max(1, math.ceil(n_queries * dimension * 8 / max(query_bytes, dimension * 8, 1)))
    part = F.pmod(F.xxhash64(query_id), F.lit(slices))
    found = [_best_of_slice(stored, vectors.filter(part == i), k, query_id, list(id_cols), out_schema) for i in range(slices)]
    best = reduce(DataFrame.union, found)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), *id_cols)
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", *id_cols, "score")


def _valid(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with a vector. A filter in the plan would be pushed below the embedding and compute it twice."""
    vectors = batch.column("embedding")
    return batch.filter(vectors.is_valid()) if vectors.null_count else batch


class _TopK:
    """The ``k`` best rows per query seen so far, ties broken by the ids."""

    def __init__(self, k: int, query_ids: Sequence, query_matrix: np.ndarray, id_cols: list[str], query_id: str):
        self.k, self.ids, self.query_ids, self.query_id = k, id_cols, pd.Series(query_ids), query_id
        lengths = np.sqrt(np.einsum("ij,ij->i", query_matrix, query_matrix))[:, None]
        unit = np.divide(query_matrix, lengths, out=np.zeros_like(query_matrix), where=lengths > 0)
        self.columns = np.ascontiguousarray(unit.T)
        self.floor = np.full(len(self.query_ids), -np.inf)
        self.held: list[pd.DataFrame] = []
        self.n_held = 0

    def add(self, matrix: np.ndarray, ids: pd.DataFrame) -> None:
        scores = np.round(_cosines(matrix, self.columns), SCORE_DECIMALS) + 0.0
        scores[np.isnan(scores)] = -np.inf  # no number: not ranked
        if len(scores) > self.k:
            # Rows below a query's k-th best here cannot make its list; rows equal to it may, by their ids.
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            self.floor = np.maximum(self.floor, kth)
        row, query = np.nonzero((scores >= self.floor) & (scores > -np.inf))
        picked = ids.iloc[row].reset_index(drop=True)
        picked["_q"], picked["score"] = query, scores[row, query]
        self.held.append(picked)
        self.n_held += len(picked)
        if self.n_held > 4 * self.k * len(self.query_ids) + 10_000:
            self._shrink()

    def _shrink(self) -> None:
        if not self.held:
            return
        ordered = pd.concat(self.held).sort_values(
            ["_q", "score", *self.ids], ascending=[True, False] + [True] * len(self.ids), kind="stable"
        )
        best = ordered[ordered.groupby("_q").cumcount() < self.k]
        full = best.groupby("_q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index] = np.maximum(self.floor[full.index], full["min"])
        self.held, self.n_held = [best], len(best)

    def result(self) -> pd.DataFrame:
        self._shrink()
        if not self.held:
            return pd.DataFrame(columns=[self.query_id, *self.ids, "score"])
        best = self.held[0]
        found = best[[*self.ids, "score"]].reset_index(drop=True)
        found.insert(0, self.query_id, self.query_ids.take(best["_q"].to_numpy()).to_numpy())
        return found


def _best_of_slice(
    stored: DataFrame, vectors: DataFrame, k: int, query_id: str, id_cols: list[str], out_schema: str
) -> DataFrame:
    table = vectors.toArrow().combine_chunks()  # size checked by the caller
    shared = stored.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if not table.num_rows:
            return
        rows = table.column("_tl_query").combine_chunks()
        matrix = _matrix(rows, len(rows[0]))
        step = max(1, BLOCK_BYTES // 8 // len(matrix))  # bounds the score matrix of one step
        top, id_types = None, []
        for batch in map(_valid, batches):
            if top is None:
                top = _TopK(k, table.column(query_id).to_pandas(), matrix, id_cols, query_id)
                id_types = [batch.schema.field(c) for c in id_cols]
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                top.add(_matrix(part.column("embedding"), matrix.shape[1]), part.select(id_cols).to_pandas())
        if top is not None:
            out = pa.schema([table.schema.field(query_id), *id_types, pa.field("score", pa.float64())])
            yield pa.RecordBatch.from_pandas(top.result(), schema=out, preserve_index=False)

    return stored.mapInArrow(scan, out_schema)


def page_of_batch(ranked: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Cut ``search_batch(k = offset + n + 1)`` down to one page per query and add ``has_more``."""
    query = ranked.columns[0]
    last = F.max("rank").over(Window.partitionBy(query))
    return ranked.withColumn("has_more", last > offset + n).filter(F.col("rank").between(offset + 1, offset + n))
