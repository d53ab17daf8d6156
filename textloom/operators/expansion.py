"""Neighbour expansion: short chunks also appear joined with the chunks around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.binding import bind
from textloom.functions.text import join_spaced, token_count
from textloom.operators.chunking import ABBREVIATIONS, check_sizes, chunk_texts, drop_empty
from textloom.operators.numbering import number_in_order

# Rows per window partition. A document, or the whole corpus, is cut into buckets of this many neighbours, so
# no window ever grows with the longest document.
BUCKET_ROWS = 4096

EXPANDED_KEY = "isExpanded"


def expand_neighbors(
    df: DataFrame,
    max_tokens: int = 100,
    scope: str = "document",
    doc_cols: Sequence[str] = ("doc_id",),
    ix_col: str = "chunk_ix",
    count: Callable[[Column], Column] = token_count,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Each chunk as it is; if it has at most ``max_tokens`` tokens also ``chunk next`` (when there is a next
    one) and ``previous chunk next`` (when there are both).

    ``scope="document"``: neighbours within one document; ``ix_col`` must be its dense 0-based position, as
    chunking leaves it. ``scope="corpus"``: neighbours in the order of (``doc_cols``, ``ix_col``) over the whole
    table; expanded rows then get null ``doc_cols``, as they stand for no single document.

    Adds ``variant`` (0 itself, 1 with next, 2 with both) and ``is_expanded``; expanded rows carry the centre's
    metadata (a ``metadata`` map, if present, gains ``isExpanded``) and their own ``n_tokens``.
    """
    if scope == "document":
        keys, position, indexed = list(doc_cols), F.col(ix_col), df
    elif scope == "corpus":
        indexed = number_in_order(df, [*doc_cols, ix_col], name="_tl_ix")
        keys, position = [], F.col("_tl_ix")
    else:
        raise ValueError(f"scope must be 'document' or 'corpus', got {scope!r}")

    windowed = _with_neighbors(indexed, keys, position, bucket_rows)
    return _emit(windowed, df.columns, max_tokens, count, [] if scope == "document" else list(doc_cols))


def _with_neighbors(df: DataFrame, keys: list[str], position: Column, bucket_rows: int) -> DataFrame:
    """``_tl_prev`` / ``_tl_next`` texts, from windows over fixed-size buckets.

    The first and last row of a bucket are also sent to the bucket next to it, where they only serve as
    neighbours; so every row sees both its neighbours inside one bounded window.
    """
    offset = position % bucket_rows
    bucket = ((position - offset) / bucket_rows).cast("long")
    homes = F.array_compact(
        F.array(
            F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
            F.when((offset == 0) & (position > 0), F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("own"))),
            F.when(offset == bucket_rows - 1, F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))),
        )
    )
    placed = df.select("*", position.alias("_tl_pos"), F.inline(homes).alias("_tl_bucket", "_tl_own"))
    around = Window.partitionBy(*keys, "_tl_bucket").orderBy("_tl_pos")
    return placed.select(
        "*", F.lag("text").over(around).alias("_tl_prev"), F.lead("text").over(around).alias("_tl_next")
    ).filter("_tl_own")


def neighbour_ids(ids: DataFrame, changed: Sequence[int], id_col: str = "doc_id") -> tuple[list[int], list[int]]:
    """Where a change of some documents reaches in corpus scope: the documents next to them, and those next to these as well.

    ``ids`` are documents with chunks, ``changed`` the few that are replaced, added or emptied. Between two changed documents, the
    first and the last unchanged one border on a change, however many changed ones in a row lost their chunks; the second and the last but
    one are what these border on. Two scans of the ids alone, with at most two rows for every changed document.
    """
    bounds = F.array(*[F.lit(int(c)) for c in sorted(changed)])
    gap = F.size(F.filter(bounds, lambda c: c < F.col(id_col)))
    apart = ids.select(F.col(id_col).alias("id"), gap.alias("gap")).filter(~F.array_contains(bounds, F.col("id")))

    def ends(rows: DataFrame) -> list[int]:
        found = rows.groupBy("gap").agg(F.min("id").alias("first"), F.max("id").alias("last")).collect()
        # Nothing before the first change borders on one from behind, nor after the last from before.
        return sorted({r["first"] for r in found if r["gap"] > 0} | {r["last"] for r in found if r["gap"] < len(changed)})

    nearest = ends(apart)
    return nearest, ends(apart.filter(~F.col("id").isin(nearest))) if nearest else []


def chunk_and_expand(
    docs: DataFrame,
    chunk_size: int,
    chunk_overlap: int,
    max_tokens: int = 100,
    abbreviations: Sequence[str] = ABBREVIATIONS,
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """:func:`chunk_documents` followed by document-scope :func:`expand_neighbors`, as one step without a shuffle.

    A document's chunks are still in one array when they are made, so their neighbours are at hand.
    """
    check_sizes(chunk_size, chunk_overlap)
    kept = [c for c in docs.columns if c != "text"]

    def variants(texts: Column) -> Column:
        def of(text: Column, i: Column) -> Column:
            return _variants(text, F.get(texts, i - 1), F.get(texts, i + 1), count(text), max_tokens, chunk_ix=i)

        return F.flatten(F.transform(texts, of))

    texts = chunk_texts(F.col("text"), chunk_size, chunk_overlap, abbreviations, count)
    rows = drop_empty(docs).select(*kept, F.inline(bind(texts, variants)))
    return _finish(rows, kept, [], count(F.col("text")))


def _variants(
    text: Column, before: Column, after: Column, own_tokens: Column, max_tokens: int, **fixed: Column
) -> Column:
    """The one to three rows a chunk gives, as an array of structs."""

    def row(variant: int, *parts: Column) -> Column:
        joined = join_spaced(*parts) if len(parts) > 1 else parts[0]
        others = [value.alias(name) for name, value in fixed.items()]
        return F.struct(*others, F.lit(variant).alias("variant"), joined.alias("text"))

    grown = bind(
        own_tokens <= max_tokens,
        lambda short: F.array(
            F.when(short & after.isNotNull(), row(1, text, after)),
            F.when(short & after.isNotNull() & before.isNotNull(), row(2, before, text, after)),
        ),
    )
    return F.array_compact(F.concat(F.array(row(0, text)), grown))


def _emit(df: DataFrame, columns: list[str], max_tokens: int, count: Callable, blank_cols: list[str]) -> DataFrame:
    df = df.withColumn("_tl_own_tokens", F.col("n_tokens") if "n_tokens" in columns else count(F.col("text")))
    own_tokens = F.col("_tl_own_tokens")
    rows = _variants(F.col("text"), F.col("_tl_prev"), F.col("_tl_next"), own_tokens, max_tokens)
    kept = [c for c in columns if c not in ("text", "n_tokens", "is_expanded", "variant")]
    n_tokens = F.when(F.col("variant") > 0, count(F.col("text"))).otherwise(own_tokens)
    return _finish(df.select(*kept, own_tokens, F.inline(rows)), kept, blank_cols, n_tokens)


def _finish(rows: DataFrame, kept: list[str], blank_cols: list[str], n_tokens: Column) -> DataFrame:
    expanded = F.col("variant") > 0
    out = []
    for name in kept:
        if name in blank_cols:
            out.append(F.when(~expanded, F.col(name)).alias(name))
        elif name == "metadata":
            out.append(F.when(expanded, _marked(F.col(name))).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    position = ["chunk_ix"] if "chunk_ix" in rows.columns and "chunk_ix" not in kept else []
    return rows.select(*out, *position, "variant", "text", n_tokens.alias("n_tokens"), expanded.alias("is_expanded"))


def _marked(metadata: Column) -> Column:
    others = F.map_filter(metadata, lambda key, _: key != EXPANDED_KEY)
    return F.map_concat(others, F.create_map(F.lit(EXPANDED_KEY), F.lit("true")))
