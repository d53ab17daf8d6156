"""Adding new CSV or file-stream documents to a stored set, micro-batch by micro-batch."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.errors import IdentityError
from textloom.operators.numbering import number_in_order
from textloom.plans.corpus import BY_CONTENT, BY_ID, Corpus
from textloom.session import scratch_folder
from textloom.sources.csv import KEY, keyed_rows, unpivot_text
from textloom.sources.store import as_documents, latest_per_key, with_keys_of


def stream_csv(corpus: Corpus, folder: str, schema: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """New CSV files of a folder as a stream of rows; streams need their columns named up front."""
    return (
        corpus.spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .csv(folder)
    )


def stream_documents(rows: DataFrame, text_cols: Sequence[str], id_col: str | None = None) -> DataFrame:
    """Stream rows to documents, identified by ``id_col`` (whole numbers) or else by their content.

    With ``id_col``, ``doc_id = id * len(text_cols) + column position``. Without, a document gets its ``doc_id`` when it is
    stored: a stream has no file-order numbers.
    """
    if id_col:
        return unpivot_text(keyed_rows(rows, id_col), text_cols, id_col=KEY)
    return unpivot_text(rows, text_cols)


def append_batch(corpus: Corpus, set_id: int, documents: DataFrame, stream: str, number: int) -> None:
    """Add batch ``number`` of a stream to a set. Running it again changes nothing.

    Documents with ids go into sets of documents with ids; they are added, or replace those that have their id. Documents
    without go into sets that are told apart by content: those that the set holds are dropped, all others are numbered behind
    the last. Of a batch with few documents the scan looks up their content keys by bounds and Bloom filters of the row groups.
    """
    current = corpus.store.require_set(set_id)
    identity = corpus.config_of(set_id).identity
    by = BY_ID if "doc_id" in documents.columns else BY_CONTENT
    if by != identity:
        raise IdentityError(f"set {set_id} tells documents apart by {identity}, the batch by {by}")
    if current["applied"].get(stream, -1) >= number:
        return
    if by == BY_ID:
        corpus.upsert_documents(set_id, documents, stream, number)
        return
    staged = scratch_folder(corpus.spark, "batch")
    keyed = as_documents(documents.withColumn("doc_id", F.lit(None).cast("long")))
    keyed.withColumn("row", F.monotonically_increasing_id()).write.parquet(staged)
    latest = latest_per_key(corpus.spark.read.parquet(staged), ["content_key"]).drop("doc_id")
    stored = corpus.store.read("documents", set_id, current["folders"]).select("content_key")
    known = with_keys_of(stored, "content_key", latest)
    # Only keys are sorted to be numbered; the texts follow by a join.
    numbers = number_in_order(latest.select("content_key").join(known, "content_key", "left_anti"), ["content_key"], name="doc_id")
    fresh = latest.join(numbers.withColumn("doc_id", F.col("doc_id") + current["next_id"]), "content_key")
    corpus.upsert_documents(set_id, fresh, stream, number)


def ingest_stream(
    corpus: Corpus, set_id: int, documents: DataFrame, checkpoint: str
) -> StreamingQuery:
    """Append a stream of documents to a set until its input is used up, then stop.

    Chunking and embedding keep no state between documents, so every micro-batch runs the batch operators.
    A micro-batch owns a folder named after the stream (its checkpoint folder) and its number; a replay after a failure
    overwrites that folder if it is not committed, and does nothing if it is.
    """
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    return (
        documents.writeStream.foreachBatch(
            lambda batch_df, b: append_batch(corpus, set_id, batch_df, stream, b)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
