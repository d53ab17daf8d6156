"""Cost estimates, previews and document counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import token_count
from textloom.operators.numbering import slice_by_position

# List price in dollars per million tokens.
PRICE_PER_MILLION = {
    "text-embedding-3-small": 0.02,
    "text-embedding-3-large": 0.13,
    "mistral-embed": 0.1,
    "mxbai-embed-large": 0.0,
    "nomic-embed-text": 0.0,
    "gemini-embedding-001": 0.0,
}

# Fixed value: documents shown in a preview.
PREVIEW_DOCUMENTS = 10


def estimate_cost(
    chunks: DataFrame,
    models: str | Sequence[str],
    prices: Mapping[str, float] = PRICE_PER_MILLION,
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """One row per model: ``model, token_count, price_per_1m, estimated_price``. Unknown models cost 0.

    The corpus is counted once, whatever the number of models. A stored ``n_tokens`` is used when there is one.
    """
    names = [models] if isinstance(models, str) else list(models)
    own = F.col("n_tokens") if "n_tokens" in chunks.columns else count(F.col("text"))
    total = chunks.agg(F.coalesce(F.sum(own.cast("long")), F.lit(0)).cast("long").alias("token_count"))
    priced = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(float(prices.get(m, 0.0))).alias("price_per_1m")) for m in names]
    )
    return total.select("token_count", F.inline(priced).alias("model", "price_per_1m")).select(
        "model",
        "token_count",
        "price_per_1m",
        (F.col("token_count") * (F.col("price_per_1m") / F.lit(1_000_000.0))).alias("estimated_price"),
    )


def middle_documents(docs: DataFrame, id_col: str = "doc_id", n: int = PREVIEW_DOCUMENTS) -> DataFrame:
    """The ``n`` documents starting at position ``floor(count / 2)`` in id order, empty ones included."""
    return slice_by_position(docs, id_col, lambda rows: rows // 2, n)


def count_documents(docs: DataFrame, set_col: str = "set_id") -> DataFrame:
    """``set_id, total_documents``, derived from the documents themselves."""
    return docs.groupBy(set_col).agg(F.count("*").alias("total_documents"))
