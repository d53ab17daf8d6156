"""Op 1: documents packed into training sequences along a Hilbert curve.

A document's token counts, hashed to a small vector, are projected to ``DIMENSIONS`` numbers; their Hilbert key puts like
documents next to each other. Documents are range-sorted by it and laid end to end, so a sequence holds neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, written

SEQUENCE = 1024
# A range of the curve that one task packs; only its last sequence is padded.
RANGE_TOKENS = 4_000_000
DIMENSIONS, DIMENSION_BITS = 4, 8
# Stretches of the curve that tokens are counted for, as a power of two.
_BIN_BITS = 16
_BUCKETS = 4096
_PROJECTION = np.random.default_rng(7).standard_normal((_BUCKETS, DIMENSIONS)).astype(np.float32)

# Characters of encoded units that a worker remembers before it starts afresh.
REMEMBERED = 8_000_000

# Texts of these characters alone are cut at blanks before they are encoded: there all libraries agree on letters, digits and
# white space, and no token reaches across a blank that precedes a visible character.
_USUAL = re.compile("[^\x09\x0a\x0d\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]")
_UNCLEAR_BLANK = re.compile(r" (?=\s|$)")


class Encoder:
    """Ids of whole texts by the tokenizer file ``json_path``.

    ``ranks_path`` is the same vocabulary as ranks. With it, usual texts are encoded unit by unit, each distinct unit once;
    all other texts, and those that hold a special token's string, go whole through the tokenizer file.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._firsts: dict[str, bytes] = {}  # units at a text's start
        self._later: dict[str, bytes] = {}  # units behind a blank, which is left out of the key
        self._held = 0
        self._units = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self._sizes[rank] = len(token)
            self._units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.block([text])[0]

    def block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; units that are not known yet are encoded together."""
        out = [b""] * len(texts)
        usual = []
        for i, text in enumerate(texts):
            if self._units is None or _USUAL.search(text) or _UNCLEAR_BLANK.search(text) or any(s in text for s in self._special):
                out[i] = np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                first, *rest = text.split(" ")
                usual.append((i, first, rest))
        if self._held > REMEMBERED:
            self._firsts, self._later, self._held = {}, {}, 0
        firsts, later = self._firsts, self._later
        for _, first, _ in usual:
            if first not in firsts:
                firsts[first] = np.array(self._units(first), "<u4").tobytes()
                self._held += len(first)
        self._learn([unit for unit in set().union(*(rest for _, _, rest in usual)) if unit not in later])
        for i, first, rest in usual:
            out[i] = firsts[first] + b"".join([later[unit] for unit in rest])
        return out

    def _learn(self, units: list[str]) -> None:
        """Encode units behind blanks in one call: no token reaches across such a blank, so the ids can be cut where a unit's bytes end."""
        ids = np.array(self._units("".join([" " + unit for unit in units])) if units else [], "<u4")
        ends = np.cumsum([1 + len(unit.encode()) for unit in units], dtype=np.int64)
        cuts = [0, *(np.searchsorted(np.cumsum(self._sizes[ids]), ends) + 1).tolist()] if units else []
        raw = ids.tobytes()
        for unit, low, high in zip(units, cuts, cuts[1:]):
            self._later[unit] = raw[4 * low : 4 * high]
            self._held += len(unit)


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """A worker's encoder, kept for its next tasks."""
    return Encoder(json_path, ranks_path)


def hilbert_keys(points: np.ndarray, bits: int = DIMENSION_BITS) -> np.ndarray:
    """Hilbert curve positions of integer points (rows) with ``bits`` bits in each dimension, by Gray-code axis transposition."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for i in range(n):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & mask)
            axes[0] = np.where(high, axes[0] ^ mask, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
        q >>= 1
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((axes[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    axes = [axis ^ turn for axis in axes]
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _curve_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Curve keys of documents whose ids, ``sizes`` of them each, stand one after another.

    The direction of a projected count vector counts, so that the key does not depend on a text's length.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points = np.add.reduceat(_PROJECTION[ids & (_BUCKETS - 1)], starts, axis=0)
    points /= np.maximum(np.sqrt((points * points).sum(axis=1, keepdims=True)), 1e-30)
    top = (1 << DIMENSION_BITS) - 1
    return hilbert_keys(np.clip(((points + 1) / 2 * top).astype(np.int64), 0, top))


def _ranges(encoded: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``encoded`` with the number of its range of about ``size`` tokens, in curve order, and how many ranges there are.

    Tokens are counted for each of at most ``2 ** _BIN_BITS`` stretches of the curve. A document's place among all tokens follows from its
    stretch and, within it, from a hash, so that many documents of one key, such as copies, still spread over ranges.
    """
    stretch = F.shiftright("curve", DIMENSIONS * DIMENSION_BITS - _BIN_BITS)
    counted = encoded.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("tokens")).orderBy("stretch").collect()
    total = sum(r.tokens for r in counted)
    before, bounds = 0, []
    for r in counted:
        bounds.append((r.stretch, before, r.tokens))
        before += r.tokens
    number = 1 + total // size
    table = F.broadcast(encoded.sparkSession.createDataFrame(bounds, "stretch bigint, before bigint, tokens bigint"))
    share = F.pmod(F.xxhash64("key.key", "key.row"), F.lit(1 << 20)) / float(1 << 20)
    at = F.floor((F.col("before") + share * F.col("tokens")) / (total / number if total else 1)).cast("int")
    placed = encoded.withColumn("stretch", stretch).join(table, "stretch").withColumn("range", F.least(at, F.lit(number - 1)))
    return placed.select("range", "curve", "key.key", "key.row", "n", "ids"), number


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row's ids and one ``end_id`` after them are laid along the curve; a document is cut where a sequence is full. Each
    range of the curve ends with one sequence that is not full. A null or empty text is its ``end_id`` alone. Repeated rows and keys are
    packed as rows of their own, side by side. No rows make no sequence.

    Texts are encoded once; ids are stored, then shuffled once to ranges of the curve that hold about as many tokens each; copies of a
    text, whose Hilbert keys are equal, spread over ranges too. Texts have any length; each is encoded whole.
    """
    rows = keyed_texts(documents, key, text).withColumn("key", F.struct("key", F.monotonically_increasing_id().alias("row")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, ranks)
        last = np.array([end_id], "<u4").tobytes()
        for part, _, _ in A.blocks(batches):
            ids = [np.frombuffer(own + last, "<u4") for own in encoder.block(part.column("text").to_pylist())]
            small = [i.astype("<u2").tobytes() if i.max() < 1 << 16 else i.tobytes() for i in ids]
            sizes = np.array([len(i) for i in ids], np.int64)
            columns = [part.column("key"), pa.array(_curve_keys(np.concatenate(ids), sizes)), pa.array(sizes), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "curve", "n", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    encoded = written(rows.mapInArrow(encode, f"key {kind}, curve bigint, n bigint, ids binary"), "token-ids", compression="zstd")
    ranged, number = _ranges(encoded, RANGE_TOKENS)
    sorted_rows = ranged.repartitionById(number, "range").sortWithinPartitions("range", "curve", "key", "row")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() << 32, 0
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            owners, pieces = [], []
            for i, (n, stored) in enumerate(zip(batch.column("n").to_pylist(), batch.column("ids"))):
                raw = stored.as_buffer()
                ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes())
                start = 0
                while start < n:
                    offset = at % sequence
                    length = min(n - start, sequence - offset)
                    owners.append(i)
                    pieces.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, first + at // sequence, offset))
                    start, at = start + length, at + length
            columns = zip(*pieces) if pieces else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owners, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=["key", *names])

    key_kind = rows.schema["key"].dataType["key"].dataType.simpleString()
    shape = f"key {key_kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return sorted_rows.select("key", "n", "ids").mapInArrow(lay, shape).withColumnRenamed("key", key)
