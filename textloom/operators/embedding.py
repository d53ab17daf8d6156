"""Turning chunk texts into vectors with a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.errors import UnknownEmbedderError
from textloom.functions.binding import bind
from textloom.functions.text import token_count, tokens
from textloom.functions.vectors import norm

# Vector dimensions of known models, and the one assumed for all others.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "mxbai-embed-large": 1024,
    "mistral-embed": 1024,
    "gemini-embedding-001": 768,
}
DEFAULT_DIMENSION = 1536

# Texts and tokens per call of a model function.
BATCH_SIZE = 50
REQUEST_TOKENS = 300_000

# Counts that a task holds at once.
_COUNTS = 1 << 20


@dataclass(frozen=True)
class Embedder:
    """A named text-to-vector expression."""

    name: str
    dimension: int
    vector: Callable[[Column], Column]

    def embed_query(self, spark: SparkSession, text: str) -> list[float]:
        """The vector of one query text, on the driver."""
        one = spark.range(1).select(self.vector(F.lit(text)).alias("embedding"))
        return list(one.first()["embedding"])


def mock_embedder() -> Embedder:
    """The same six numbers for every text; for tests."""
    return Embedder("mock", 6, lambda text: F.array(*map(F.lit, (1, 0, 0, 0, 0, 0))).cast("array<float>"))


def hash_embedder(dimension: int = 64) -> Embedder:
    """Offline bag-of-tokens vectors: token counts per hash bucket, the first 32 bits of a token's md5 modulo ``dimension``.

    Tokens are cut by a native expression and travel to Python in Arrow batches, where each distinct one of a batch is hashed once.
    Null texts have null vectors.
    """

    def counted(lists: pa.Array) -> pa.Array:
        words, rows = lists.flatten().dictionary_encode(), len(lists)
        held = words.dictionary.cast(pa.binary()).to_pylist()
        buckets = np.array([int.from_bytes(hashlib.md5(t).digest()[:4], "big") % dimension for t in held], np.int64)
        row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        counts = np.bincount(row * dimension + buckets[words.indices.to_numpy()], minlength=rows * dimension)
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dimension)
        return pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float32)), mask=lists.is_null())

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = max(1, _COUNTS // dimension)
        for batch in batches:
            parts = [counted(batch.slice(first, step)) for first in range(0, len(batch), step)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return Embedder(f"hash-{dimension}", dimension, lambda text: run(tokens(text)))


def requests(tokens_of: Sequence[int], budget: int = REQUEST_TOKENS, batch_size: int = BATCH_SIZE) -> Iterator[slice]:
    """Consecutive slices of at most ``batch_size`` texts and ``budget`` tokens; a text above the budget has a slice of its own."""
    first, held = 0, 0
    for i, n in enumerate(tokens_of):
        if i > first and (i - first == batch_size or held + n > budget):
            yield slice(first, i)
            first, held = i, 0
        held += n
    if first < len(tokens_of):
        yield slice(first, len(tokens_of))


def function_embedder(
    name: str,
    dimension: int,
    model: Callable[[list[str]], Sequence[Sequence[float]]],
    batch_size: int = BATCH_SIZE,
    budget: int = REQUEST_TOKENS,
    count: Callable[[Column], Column] = token_count,
) -> Embedder:
    """A user model ``list of texts -> list of vectors``, called with at most ``batch_size`` texts of together at most ``budget`` tokens.

    A text that alone is above the budget is sent alone. Tokens are counted by the native expression ``count``; only texts and counts
    travel to Python, in Arrow batches, and keep their order.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            vectors: list[Sequence[float]] = []
            for part in requests(sizes.tolist(), budget, batch_size):
                vectors.extend(model(texts.iloc[part].tolist()))
            yield pd.Series(vectors, index=texts.index)

    return Embedder(name, dimension, lambda text: run(text, F.coalesce(count(text), F.lit(0)).cast("long")))


class EmbedderRegistry:
    """Embedders by name; ``mock`` and ``hash`` are always there."""

    def __init__(self, extra: Mapping[str, Embedder] | None = None):
        self._embedders = {"mock": mock_embedder(), "hash": hash_embedder(), **(extra or {})}

    def get(self, name: str) -> Embedder:
        if name not in self._embedders:
            raise UnknownEmbedderError(f"no embedder is registered as {name!r}")
        return self._embedders[name]


def embed_input(df: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_ix")) -> DataFrame:
    """What a model gets to see: the keys and the text, never metadata."""
    return df.select(*keys, "text")


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", checked: bool = False) -> DataFrame:
    """Add ``embedding`` and its ``norm``. With ``checked``, a vector without the embedder's dimension is an error."""

    def of_dimension(vector: Column) -> Column:
        said = F.concat(F.lit(f"{embedder.name} declares {embedder.dimension} dimensions, a vector has "), F.size(vector))
        return F.when(F.size(vector) == embedder.dimension, vector).when(vector.isNotNull(), F.raise_error(said))

    vector = embedder.vector(F.col(text_col))
    return with_norm(df.withColumn("embedding", bind(vector, of_dimension) if checked else vector))


def with_norm(df: DataFrame) -> DataFrame:
    """Add the Euclidean length of ``embedding``, computed once at write time."""
    return df.withColumn("norm", norm(F.col("embedding")))


def check_dimensions(
    df: DataFrame,
    model_col: str = "model",
    dimensions: Mapping[str, int] = MODEL_DIMENSIONS,
    default: int = DEFAULT_DIMENSION,
) -> DataFrame:
    """Rows whose vector length is not the one of their model (``expected`` added); null vectors count as wrong."""
    by_model = F.create_map(*[F.lit(x) for pair in dimensions.items() for x in pair]) if dimensions else None
    known = F.try_element_at(by_model, F.col(model_col)) if dimensions else F.lit(None).cast("int")
    checked = df.withColumn("expected", F.coalesce(known, F.lit(default)))
    return checked.filter(F.col("embedding").isNull() | (F.size("embedding") != F.col("expected")))
