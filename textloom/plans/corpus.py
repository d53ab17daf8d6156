"""The flows a user runs: preview a CSV, ingest it, search a set, fetch documents, list and delete sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textloom.errors import DocumentNotFoundError
from textloom.functions.text import params_from_json
from textloom.operators.catalog import list_sets, require_all_documents
from textloom.operators.chunking import ABBREVIATIONS, check_sizes, chunk_documents, run_transforms
from textloom.operators.embedding import Embedder, EmbedderRegistry, embed
from textloom.operators.expansion import chunk_and_expand, expand_neighbors, neighbour_ids
from textloom.operators.filtering import NUMBERS, PROMOTED, MetadataFilter, apply_filters, promote_keys
from textloom.operators.pivots import PivotIndex, assign_pivots, choose_pivots, cluster, cluster_table, search_index
from textloom.operators.retrieval import attach_source, hits, page_of, page_of_batch, search, search_batch
from textloom.operators.stats import estimate_cost, middle_documents
from textloom.operators.zorder import cluster_by_numbers
from textloom.session import scratch_folder, spread
from textloom.sources.csv import KEY, keyed_rows, read_documents_csv, read_rows_csv, require_documents, unpivot_text
from textloom.sources.store import FETCHED_KEYS, OWNER, CorpusStore, as_documents, latest_per_key, new_batch, with_keys, with_keys_of

# What a ranking carries: a chunk's identity, then its place.
RANKED_COLUMNS = ("batch", "chunk_id", "doc_id", "chunk_ix", "variant")

# Folders whose chunks are clustered around pivots start with this.
INDEXED = "pivots-"

# How the documents of a set are told apart.
BY_ID, BY_CONTENT = "id", "content"


@dataclass(frozen=True)
class IngestConfig:
    """How a set is chunked and embedded; stored with the set as JSON.

    ``metadata_columns`` only says what to show in result lists; all columns are kept. ``filter_columns`` are
    metadata keys stored as columns too, as text and as numbers, for filters that prune the scan; ``cluster_columns`` are those of them
    whose numbers decide which chunks are stored close to each other. ``identity`` is set by the ingest: ``id`` for documents
    that came with ids of their own, ``content`` for those that were only numbered.
    """

    text_columns: Sequence[str] = ("text",)
    metadata_columns: Sequence[str] = ()
    filter_columns: Sequence[str] = ()
    cluster_columns: Sequence[str] = ()
    description: str = ""
    embedder: str = "hash"
    model: str = "text-embedding-3-small"
    chunk_size: int = 1024
    chunk_overlap: int = 20
    expand: bool = False
    expand_scope: str = "document"
    expand_max_tokens: int = 100
    abbreviations: Sequence[str] = field(default=ABBREVIATIONS)
    identity: str = BY_ID

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


def chunk_transforms(config: IngestConfig) -> list[Callable[[DataFrame], DataFrame]]:
    """The table transforms from documents to chunks; expansion only when asked for."""
    sizes = (config.chunk_size, config.chunk_overlap)
    if config.expand and config.expand_scope == "document":
        return [lambda docs: chunk_and_expand(docs, *sizes, config.expand_max_tokens, config.abbreviations)]
    transforms: list[Callable[[DataFrame], DataFrame]] = [
        lambda docs: chunk_documents(docs, *sizes, config.abbreviations)
    ]
    if config.expand:
        transforms.append(lambda chunks: expand_neighbors(chunks, config.expand_max_tokens, config.expand_scope))
    return transforms


def documents_to_chunks(docs: DataFrame, config: IngestConfig, few: bool = False) -> DataFrame:
    """Chunks ``doc_id, text_column, metadata, chunk_ix, variant, text, n_tokens, is_expanded`` and filter columns.

    A ``few`` documents are chunked where they are.
    """
    docs = docs.select("doc_id", "text_column", "metadata", "text")
    docs = docs if few else spread(docs, "doc_id")
    if _reaches_across(config):
        docs = docs.withColumn(OWNER, F.col("doc_id"))
    chunks = run_transforms(docs, chunk_transforms(config))
    chunks = chunks if "variant" in chunks.columns else chunks.withColumn("variant", F.lit(0))
    return promote_keys(chunks, config.filter_columns)


@dataclass(frozen=True)
class Corpus:
    """A corpus store with its embedders."""

    spark: SparkSession
    root: str
    embedders: EmbedderRegistry = field(default_factory=EmbedderRegistry)

    @property
    def store(self) -> CorpusStore:
        return CorpusStore(self.spark, self.root)

    # ---- preview -----------------------------------------------------------------------------------------

    def preview_csv(
        self, path: str, config: IngestConfig, sep: str = ",", multi_line: bool = True
    ) -> tuple[DataFrame, DataFrame]:
        """``(chunks of the ten middle documents, cost of the whole file)`` for the first text column."""
        if not config.text_columns:
            raise ValueError("name at least one text column")
        docs = require_documents(read_documents_csv(self.spark, path, config.text_columns[:1], sep, multi_line))
        return preview(docs, config)

    # ---- ingest ------------------------------------------------------------------------------------------

    def ingest_csv(
        self, path: str, name: str, config: IngestConfig, sep: str = ",", multi_line: bool = True, id_col: str | None = None
    ) -> int:
        """CSV files to a searchable set; returns its id.

        With ``id_col`` (whole numbers) documents keep ids that follow from it, and later batches replace by them. Without, they are
        numbered in file order and later batches are told apart by content.
        """
        if id_col is None:
            docs = read_documents_csv(self.spark, path, config.text_columns, sep, multi_line)
            return self.ingest_documents(docs, name, config, BY_CONTENT)
        rows = keyed_rows(read_rows_csv(self.spark, path, sep, multi_line), id_col)
        return self.ingest_documents(unpivot_text(rows, config.text_columns, id_col=KEY), name, config)

    def ingest_documents(self, docs: DataFrame, name: str, config: IngestConfig, identity: str = BY_ID) -> int:
        """Documents ``(doc_id, text_column, text, metadata)`` to a searchable set; returns its id.

        Documents are written first and chunked from the written table, so both tables agree on ids and a
        lost executor only repeats its own scan. The catalogue row comes last.
        """
        embedder = self.embedders.get(config.embedder)
        check_sizes(config.chunk_size, config.chunk_overlap)
        if not set(config.cluster_columns) <= set(config.filter_columns):
            raise ValueError("cluster by filter columns")
        require_documents(docs)
        config = replace(config, identity=identity)
        store, batch = self.store, new_batch()
        set_id = store.claim_set_id()
        written = store.write("documents", as_documents(docs), set_id, batch)
        store.write("chunks", self._embedded(written, config, embedder), set_id, batch)
        total, last = written.agg(F.count("*"), F.max("doc_id")).first()
        store.commit(set_id, name, datetime.now(timezone.utc), config.to_json(), total, [batch], next_id=last + 1)
        return set_id

    def _embedded(self, docs: DataFrame, config: IngestConfig, embedder: Embedder, known: DataFrame | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Chunks with vectors, ``only`` those of some owners. Texts whose vectors are ``known`` (``text_key, embedding, norm``) do not go to the embedder again.

        With ``known``, chunks are stored first, and each new text goes to the embedder once.
        """
        chunks = documents_to_chunks(docs, config).withColumn("text_key", F.md5("text"))
        if only is not None:
            chunks = with_keys(chunks, OWNER, only)
        if config.cluster_columns:
            # Clustering reads its input three times: for the quantiles, for the ranges and for the rows.
            placed = scratch_folder(self.spark, "unclustered")
            chunks.write.parquet(placed)
            chunks = cluster_by_numbers(self.spark.read.parquet(placed), [NUMBERS + c for c in config.cluster_columns])
        chunks = chunks.withColumn("chunk_id", F.monotonically_increasing_id())
        if known is None:
            return embed(chunks, embedder, checked=True)
        staged = scratch_folder(self.spark, "chunks")
        chunks.write.parquet(staged)
        chunks = self.spark.read.parquet(staged)
        held = with_keys_of(known, "text_key", chunks).groupBy("text_key").agg(F.any_value("embedding").alias("embedding"), F.any_value("norm").alias("norm"))
        vectors = scratch_folder(self.spark, "vectors")
        held.write.parquet(vectors)
        held = self.spark.read.parquet(vectors)
        new = chunks.select("text_key", "text").join(held, "text_key", "left_anti").dropDuplicates(["text_key"])
        return chunks.join(held.unionByName(embed(new, embedder, checked=True).drop("text")), "text_key")

    def _remade(self, set_id: int, folders: Sequence[str], written: DataFrame) -> tuple[DataFrame, DataFrame, list[int] | None]:
        """For a change where chunks reach across documents: the ids whose chunks are made anew, the documents to make them from, and
        the ids again as a list. Beyond ``FETCHED_KEYS`` changed documents, that is all documents of the set (and no list)."""
        stored = self.store.read("documents", set_id, folders)
        changed = [r["doc_id"] for r in written.select("doc_id").limit(FETCHED_KEYS + 1).collect()]
        kept = stored.join(written.select("doc_id"), "doc_id", "left_anti").select(*written.columns)
        if len(changed) > FETCHED_KEYS:
            return stored.select("doc_id").union(written.select("doc_id")).distinct(), kept.unionByName(written), None
        held = self.store.read("chunks", set_id, folders).filter("variant = 0").select("doc_id").distinct()
        nearest, next_to = neighbour_ids(held, changed)
        touched = sorted({*changed, *nearest})
        remade = self.spark.createDataFrame([(i,) for i in touched], "doc_id long")
        around = with_keys(stored.select(*written.columns), "doc_id", sorted({*nearest, *next_to}))
        return remade, around.unionByName(written), touched

    def _known_vectors(self, set_id: int, folders: Sequence[str]) -> DataFrame:
        return self.store.read("chunks", set_id, folders).select("text_key", "embedding", "norm").filter("embedding is not null")

    def upsert_documents(self, set_id: int, docs: DataFrame, stream: str | None = None, number: int = 0) -> None:
        """Add or replace documents of a set by ``doc_id``; of rows with one id the last counts.

        The change is a folder of its own; folders that hold documents with its ids are written anew without those, and the new
        state of the set is committed last. As batch ``number`` of a ``stream``, it does nothing if that number or a
        later one is already applied. Where chunks reach across documents, those next to changed documents are made anew too.
        """
        store, current = self.store, self.store.require_set(set_id)
        config, applied = _config(current), dict(current["applied"])
        if stream is not None and applied.get(stream, -1) >= number:
            return
        batch = new_batch() if stream is None else f"{stream}-{number}"
        applied.update({} if stream is None else {stream: number})
        embedder = self.embedders.get(config.embedder)
        staged = scratch_folder(self.spark, "batch")
        as_documents(docs).withColumn("row", F.monotonically_increasing_id()).write.parquet(staged)
        latest = latest_per_key(self.spark.read.parquet(staged), ["doc_id"])
        written = store.write("documents", latest, set_id, batch)
        ids, known = written.select("doc_id"), self._known_vectors(set_id, current["folders"])
        remade, around, touched = None, written, None
        if _reaches_across(config):
            remade, around, touched = self._remade(set_id, current["folders"], written)
        chunks = self._embedded(around, config, embedder, known, touched)
        store.write("chunks", chunks, set_id, batch)
        folders, replaced = store.replace(set_id, current["folders"], ids, batch, remade)
        folders, total = [*folders, batch], current["total_documents"] - replaced + written.count()
        next_id = max(current["next_id"], (written.agg(F.max("doc_id")).first()[0] or 0) + 1)
        described = [current[c] for c in ("name", "upload_date", "parameters")]
        store.commit(set_id, *described, total, folders, current["state"] + 1, applied, next_id)

    def build_index(self, set_id: int) -> None:
        """Store the chunks of a set anew, clustered around pivots, so that searches read the clusters that matter.

        Results stay the same. Chunks of later changes are searched by a scan until the index is built again.
        """
        store, current = self.store, self.store.require_set(set_id)
        batch = f"{INDEXED}{new_batch()}"
        chunks = store.read("chunks", set_id, current["folders"]).drop("set_id", "pivot", "angle")
        chunks = chunks.drop("batch").withColumn("chunk_id", F.monotonically_increasing_id())
        pivots = choose_pivots(chunks)
        written = store.write("chunks", cluster(assign_pivots(chunks, pivots)), set_id, batch)
        store.write("pivots", cluster_table(written, pivots).coalesce(1), set_id, batch)
        store.write("documents", store.read("documents", set_id, current["folders"]), set_id, batch)
        described = [current[c] for c in ("name", "upload_date", "parameters", "total_documents")]
        store.commit(set_id, *described, [batch], current["state"] + 1, current["applied"], current["next_id"])

    # ---- search ------------------------------------------------------------------------------------------

    def config_of(self, set_id: int) -> IngestConfig:
        return _config(self.store.require_set(set_id))

    def search_page(
        self, set_id: int, text: str, n: int = 10, filters: Sequence[MetadataFilter | tuple] = (), offset: int = 0
    ) -> DataFrame:
        """A ranked page of a set's chunks (all stored columns but the vectors) for one query text.

        The ranking scan reads ids, vectors and filtered columns only. A page of up to ``FETCHED_KEYS`` is ranked at once, and
        the rest of its chunks is read from the files and row groups that hold their ids; larger ones are joined.
        """
        current = self.store.require_set(set_id)
        chunks = self.store.read("chunks", set_id, current["folders"])
        query = self.embedders.get(_config(current).embedder).embed_query(self.spark, text)
        indexed = [f for f in current["folders"] if f.startswith(INDEXED)]
        if indexed:
            ranked = self._rank_indexed(set_id, indexed, [f for f in current["folders"] if f not in indexed], query, n, filters, offset)
        else:
            ranked = rank_chunks(chunks, query, n, filters, offset)
        rest = chunks.drop("embedding", "norm", "pivot", "angle", "text_key", *RANKED_COLUMNS[2:])
        if n <= FETCHED_KEYS:
            page = ranked.collect()  # n rows of ids and scores
            ranked = self.spark.createDataFrame(page, ranked.schema)
            rest = with_keys(rest.filter(F.col("batch").isin(list({r["batch"] for r in page}))), "chunk_id", [r["chunk_id"] for r in page])
        return ranked.join(rest, ["batch", "chunk_id"])

    def _rank_indexed(self, set_id: int, indexed: Sequence[str], others: Sequence[str], query, n: int, filters, offset: int) -> DataFrame:
        """A page ranked from clustered folders through their pivots, and from the others by a scan."""
        n, offset, store = max(1, n), max(0, offset), self.store
        wanted, ids = offset + n + 1, ("doc_id", "chunk_ix", "variant", "batch", "chunk_id")
        parts = []
        for folder in indexed:
            table = store.read("pivots", set_id, [folder.split("~")[0]])
            rows = store.read("chunks", set_id, [folder])
            fields = [f"`{c}`" for c in rows.columns if c not in ("text", "metadata") or any(_needs(rows, key, c) for key, *_ in filters)]
            found = search_index(PivotIndex(rows.select(*fields), table), query, wanted, filters, 0, ids)
            parts.append(found.select(*RANKED_COLUMNS, "score"))
        if others:
            parts.append(rank_chunks(store.read("chunks", set_id, others), query, wanted, filters, 0).select(*RANKED_COLUMNS, "score"))
        best = reduce(DataFrame.unionByName, parts)
        return page_of(best, ids, n, offset)

    def search(
        self, set_id: int, text: str, n: int = 10, filters: Sequence[MetadataFilter | tuple] = (), offset: int = 0
    ) -> DataFrame:
        """``rank, text, score, metadata, source_doc_id, has_more``."""
        return hits(self.search_page(set_id, text, n, filters, offset)).orderBy("rank")

    def search_with_sources(self, set_id: int, text: str, n: int = 10, filters=(), offset: int = 0) -> DataFrame:
        """:meth:`search` with the source documents' text and metadata.

        A page of up to ``FETCHED_KEYS`` hits is found first; its documents are then fetched by id.
        """
        found = self.search(set_id, text, n, filters, offset)
        if n <= FETCHED_KEYS:
            page = found.collect()  # n hits
            found = self.spark.createDataFrame(page, found.schema)
            docs = self.store.fetch_documents(set_id, [r["source_doc_id"] for r in page if r["source_doc_id"] is not None])
        else:
            docs = self.store.open_documents(set_id)
        docs = docs.select("doc_id", "text", "metadata")
        return attach_source(found, docs, hit_id="source_doc_id", prefix="document_").orderBy("rank")

    def search_batch(
        self, set_id: int, queries: DataFrame, n: int = 10, filters: Sequence[MetadataFilter | tuple] = (), offset: int = 0
    ) -> DataFrame:
        """One page for each of many query texts (``query_id, text``): ``query_id, rank``, chunk ids, ``score, has_more``."""
        embedder = self.embedders.get(self.config_of(set_id).embedder)
        chunks = apply_filters(self.store.open_chunks(set_id), filters)
        vectors = queries.select("query_id", embedder.vector(F.col("text")).alias("embedding"))
        n, offset = max(1, n), max(0, offset)
        found = search_batch(chunks, vectors, offset + n + 1, id_cols=("doc_id", "chunk_ix", "variant", "batch", "chunk_id"))
        return page_of_batch(found, n, offset)

    # ---- catalogue ---------------------------------------------------------------------------------------

    def list_sets(self, page: int = 1, page_size: int = 10) -> DataFrame:
        """Newest sets first, one page, with the total number of sets; ``parameters`` as a map."""
        listed = list_sets(self.store.sets(), page=page, page_size=page_size)
        return listed.withColumn("parameters", params_from_json(F.col("parameters")))

    def get_set(self, set_id: int) -> dict | None:
        """The descriptor of a set, its parameters parsed; ``None`` when there is no such set."""
        row = self.store.find_set(set_id)
        described = ("set_id", "name", "upload_date", "total_documents")
        return None if row is None else {**{c: row[c] for c in described}, "parameters": json.loads(row["parameters"])}

    def get_documents(self, set_id: int, ids: Sequence[int]) -> DataFrame:
        """The documents with these ids; an error when one is missing.

        Up to ``FETCHED_KEYS`` ids are looked up: one read of their ids alone, then the documents when they are used.
        """
        if len(set(ids)) > FETCHED_KEYS:
            wanted = self.spark.createDataFrame([(int(i),) for i in ids], "doc_id long")
            return require_all_documents(self.store.open_documents(set_id), wanted)
        docs = self.store.fetch_documents(set_id, ids)
        missing = {int(i) for i in ids} - {r["doc_id"] for r in docs.select("doc_id").collect()}
        if missing:
            raise DocumentNotFoundError(f"documents not found: {', '.join(map(str, sorted(missing)[:5]))}")
        return docs

    def delete_set(self, set_id: int) -> bool:
        return self.store.delete_set(set_id)


def _reaches_across(config: IngestConfig) -> bool:
    return config.expand and config.expand_scope == "corpus"


def _needs(rows: DataFrame, key: str, column: str) -> bool:
    """Whether a filter on ``key`` reads ``column``."""
    return column == key or (column == "metadata" and PROMOTED + key not in rows.columns and key not in rows.columns)


def _config(state: Row) -> IngestConfig:
    return IngestConfig(**json.loads(state["parameters"]))


def rank_chunks(
    chunks: DataFrame, query: Sequence[float], n: int = 10, filters: Sequence[MetadataFilter | tuple] = (), offset: int = 0
) -> DataFrame:
    """The ids of a page of stored chunks with ``score, rank, has_more``; texts and metadata are not read, unless filtered by."""
    narrow = apply_filters(chunks, filters).select(*RANKED_COLUMNS, "embedding")
    return search(narrow, query, n, (), offset, id_cols=("doc_id", "chunk_ix", "variant", "batch", "chunk_id"))


def preview(docs: DataFrame, config: IngestConfig) -> tuple[DataFrame, DataFrame]:
    """``(chunks of the ten middle documents, cost over all)``. The slice is taken before empties are dropped."""
    shown = documents_to_chunks(middle_documents(docs), config, few=True).select("doc_id", "chunk_ix", "variant", "text", "metadata")
    return shown, estimate_cost(documents_to_chunks(docs, config), config.model)
