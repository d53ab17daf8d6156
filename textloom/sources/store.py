"""The corpus store: documents, chunks and a catalogue as Parquet folders.

Layout under one root (any Hadoop-visible path)::

    documents/set_id=S/batch=B/*.parquet
    chunks/set_id=S/batch=B/*.parquet
    catalog/*.parquet        one small row per state of a set
    ids/S                    set ids that were given out

Batch folders are written once and never changed. The newest catalogue row of a set names the folders it is made of, and is
written last, so whatever a failed writer left behind stays unseen. A change writes a folder of its own; a folder that holds
documents which the change replaces is written anew without them, all others stay as they are.

One writer at a time changes a set; of two states written at once the later one counts. Readers never wait.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textloom.errors import SetNotFoundError
from textloom.functions.binding import quoted

CATALOG_SCHEMA = (
    "set_id int, name string, upload_date timestamp, parameters string, total_documents long, "
    "state long, folders array<string>, applied map<string,long>, next_id long, deleted boolean"
)

# Stored document columns. ``content_key`` identifies a document by what it holds.
DOCUMENT_COLUMNS = ("doc_id", "content_key", "text_column", "text", "metadata")

# The document in whose place a chunk stands, where chunks reach across documents and have none of their own.
OWNER = "owner"

# Most rows in one written file. Files are split by row group when read, so this only bounds single uploads;
# small files would cost more at scale than they save.
MAX_RECORDS_PER_FILE = 250_000

# Up to so many keys are looked up by value in the scan; more are joined.
FETCHED_KEYS = 1000

# Values that the scan tests one by one, against row group bounds, Bloom filters and page bounds; of a longer list it takes the bounds only.
_IN_VALUES = 10

# Columns that rows are looked up by, and the bytes of a row group: small ones skip more.
LOOKUP_COLUMNS = {"documents": ("doc_id", "content_key"), "chunks": ("doc_id", "chunk_id", "text_key", OWNER)}
ROW_GROUP_BYTES = 16 * 1024 * 1024
_FILTER_KEYS = 50_000


def new_batch() -> str:
    """A batch name that no other writer has."""
    return f"bulk-{uuid.uuid4().hex}"


def with_keys(df: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """The rows whose ``column`` is one of a few ``keys``, as comparisons that reach the scan."""
    known = sorted({k for k in keys if k is not None})
    if not known:
        return df.filter(F.lit(False))
    tests = [quoted(column).isin(known[i : i + _IN_VALUES]) for i in range(0, len(known), _IN_VALUES)]
    return df.filter(reduce(or_, tests))


def with_keys_of(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` stands in the same column of ``keys``: looked up if these are few, joined if not."""
    few = keys.select(column).distinct().limit(FETCHED_KEYS + 1).collect()
    if len(few) <= FETCHED_KEYS:
        return with_keys(df, column, [r[0] for r in few])
    return df.join(keys.select(column).distinct(), column, "left_semi")


@dataclass(frozen=True)
class CorpusStore:
    spark: SparkSession
    root: str

    # ---- folders -----------------------------------------------------------------------------------------

    def _folder(self, table: str, set_id: int, batch: str | None = None) -> str:
        parts = [self.root.rstrip("/"), table, f"set_id={set_id}"]
        if batch is not None:
            parts.append(f"batch={batch}")
        return "/".join(parts)

    def _filesystem(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _exists(self, path: str) -> bool:
        filesystem, hadoop_path = self._filesystem(path)
        return filesystem.exists(hadoop_path)

    # ---- catalogue ---------------------------------------------------------------------------------------

    def _catalog(self) -> DataFrame:
        path = f"{self.root.rstrip('/')}/catalog"
        if not self._exists(path):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(path)

    def _states(self) -> DataFrame:
        """The newest state of each live set."""
        rows = self._catalog()
        newest = rows.groupBy("set_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "set_id"]), "state").alias("s"))
        return newest.select("set_id", "s.*").filter(~F.col("deleted"))

    def sets(self) -> DataFrame:
        """Live descriptors: ``set_id, name, upload_date, parameters, total_documents``."""
        return self._states().select("set_id", "name", "upload_date", "parameters", "total_documents")

    def find_set(self, set_id: int) -> Row | None:
        """The newest state of a live set, or ``None``."""
        return self._states().filter(F.col("set_id") == set_id).first()

    def require_set(self, set_id: int) -> Row:
        row = self.find_set(set_id)
        if row is None:
            raise SetNotFoundError(f"document set {set_id} not found")
        return row

    def claim_set_id(self) -> int:
        """A new set id, by creating a marker file, which is atomic on HDFS and local disks."""
        filesystem, folder = self._filesystem(f"{self.root.rstrip('/')}/ids")
        taken = filesystem.listStatus(folder) if filesystem.exists(folder) else []
        candidate = max((int(status.getPath().getName()) for status in taken), default=0) + 1
        while True:
            filesystem, path = self._filesystem(f"{self.root.rstrip('/')}/ids/{candidate}")
            if not filesystem.exists(path) and filesystem.createNewFile(path):
                return candidate
            candidate += 1

    def commit(
        self, set_id: int, name: str, upload_date: datetime, parameters: str, total: int, folders: Sequence[str],
        state: int = 1, applied: dict[str, int] | None = None, next_id: int = 0, deleted: bool = False,
    ) -> None:
        """Append one catalogue row: from here on readers see the set as made of ``folders``.

        ``applied`` holds the last batch number of each stream, ``next_id`` the number for the next document without an id.
        """
        row = (set_id, name, upload_date, parameters, total, state, list(folders), applied or {}, next_id, deleted)
        self.spark.createDataFrame([row], CATALOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.root.rstrip('/')}/catalog"
        )

    # ---- documents and chunks ----------------------------------------------------------------------------

    def write(self, table: str, df: DataFrame, set_id: int, batch: str, max_records: int = MAX_RECORDS_PER_FILE) -> DataFrame:
        """Write one batch folder, replacing what an earlier attempt left there; returns it as written.

        Row groups are small and carry bounds and Bloom filters of the columns that rows are looked up by; within a task
        documents are sorted by id, so that pages can be skipped too.
        """
        path = self._folder(table, set_id, batch)
        data = df.drop("set_id", "batch")
        keys = [c for c in LOOKUP_COLUMNS.get(table, ()) if c in data.columns]
        if table == "documents" and "doc_id" in keys:
            data = data.sortWithinPartitions("doc_id")
        writer = data.write.mode("overwrite").option("maxRecordsPerFile", max_records).option("parquet.block.size", ROW_GROUP_BYTES)
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", _FILTER_KEYS)
        writer.parquet(path)
        return self.spark.read.parquet(path)

    def read(self, table: str, set_id: int, folders: Sequence[str]) -> DataFrame:
        """The rows of batch folders. Only these are listed and scanned."""
        base = self.spark.read.option("basePath", f"{self.root.rstrip('/')}/{table}")
        return base.parquet(*[self._folder(table, set_id, folder) for folder in folders])

    def open_documents(self, set_id: int) -> DataFrame:
        return self.read("documents", set_id, self.require_set(set_id)["folders"])

    def open_chunks(self, set_id: int) -> DataFrame:
        return self.read("chunks", set_id, self.require_set(set_id)["folders"])

    def fetch_documents(self, set_id: int, ids: Sequence[int]) -> DataFrame:
        """The documents with these ids, read from the row groups and pages that can hold them; up to ``FETCHED_KEYS`` ids."""
        if len(set(ids)) > FETCHED_KEYS:
            raise ValueError(f"fetch up to {FETCHED_KEYS} documents by id, join more")
        return with_keys(self.open_documents(set_id), "doc_id", [int(i) for i in ids])

    def documents_of(self, set_id: int, ids: DataFrame) -> DataFrame:
        """The documents whose ``doc_id`` stands in ``ids``: fetched if these are few, joined if not."""
        return with_keys_of(self.open_documents(set_id), "doc_id", ids)

    # ---- changes -----------------------------------------------------------------------------------------

    def replace(self, set_id: int, folders: Sequence[str], ids: DataFrame, batch: str, remade: DataFrame | None = None) -> tuple[list[str], int]:
        """Folders without the documents ``ids`` (``doc_id``), and how many documents that leaves out.

        Chunks go with their documents, or with the larger set of documents ``remade``, whose chunks are made anew. Folders that hold none
        of them stay; the others are written anew under a name made of their own and ``batch``.
        """
        remade = ids if remade is None else remade
        stored = self.read("documents", set_id, folders).select("batch", "doc_id")

        def held(wanted: DataFrame) -> dict[str, int]:
            return {r["batch"]: r["count"] for r in with_keys_of(stored, "doc_id", wanted).groupBy("batch").count().collect()}  # a row per folder

        leaving = held(ids)
        touched = leaving if remade is ids else held(remade)
        kept = []
        for folder in folders:
            if folder not in touched:
                kept.append(folder)
                continue
            rest = f"{folder.split('~')[0]}~{batch}"
            for table, gone in (("documents", ids), ("chunks", remade)):
                rows = self.read(table, set_id, [folder])
                key = OWNER if OWNER in rows.columns else "doc_id"
                gone = gone.select(F.col("doc_id").alias(key))
                self.write(table, rows.join(gone, key, "left_anti").select(*rows.columns), set_id, rest)
            kept.append(rest)
        return kept, sum(leaving.values())

    def delete_set(self, set_id: int) -> bool:
        """Remove a set from the catalogue, then its document and chunk folders. False when it is unknown."""
        current = self.find_set(set_id)
        if current is None:
            return False
        described = [current[c] for c in ("set_id", "name", "upload_date", "parameters")]
        self.commit(*described, 0, [], current["state"] + 1, deleted=True)
        for table in ("documents", "chunks"):
            filesystem, path = self._filesystem(self._folder(table, set_id))
            filesystem.delete(path, True)
        return True


def content_key() -> Column:
    """The md5 of a document's column name, text and metadata, whatever the order of its entries."""
    return F.md5(F.to_json(F.struct("text_column", "text", F.array_sort(F.map_entries("metadata")).alias("metadata"))))


def as_documents(df: DataFrame) -> DataFrame:
    """The stored document columns, each document with its content key."""
    return df.withColumn("content_key", content_key()).select(*DOCUMENT_COLUMNS)


def latest_per_key(staged: DataFrame, keys: Sequence[str], row: str = "row") -> DataFrame:
    """Of the rows of a key the last by ``row``. Only keys and row numbers are shuffled; ``staged`` must be stored."""
    last = staged.groupBy(*keys).agg(F.max(row).alias("_tl_last"), F.count("*").alias("_tl_n")).filter("_tl_n > 1")
    losers = staged.select(*keys, row).join(last, list(keys)).filter(F.col(row) < F.col("_tl_last")).select(row)
    return staged.join(losers, row, "left_anti").drop(row)
