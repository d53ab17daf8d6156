"""Op 5: removal of repeated byte strings, decided by merged Burrows-Wheeler transforms.

Every ``WINDOW``-byte string is filed under the least hash of the ``GRAM``-byte strings in it, its anchor, so equal strings meet
under one anchor. Windows of an anchor that follow each other are one segment; equal segments collapse to the earliest. For
anchors with several segments, tasks build the transforms of shards of segments and merge them by refining their
interleave; what then lies in one interval of common prefix ``WINDOW`` is one string, and its earliest place stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, written

WINDOW = 100
GRAM = 32
_INSIDE = WINDOW - GRAM + 1  # grams of a window
_PLACE_BITS = 20
# Windows of one segment, at most; longer runs are several segments.
_LONGEST = 512

# Bytes of one symbol of the transforms, 5 doubled some times; must divide WINDOW.
SYMBOL = 20
# Filters that tell tasks which anchors occur twice and which segments are to be compared: fixed size; a false alarm only brings a segment
# too many.
FILTER_BITS = 1 << 27
# Segments are merged in batches of about so many bytes, from shards of this size. A batch takes about 100 times its bytes of a worker's memory.
BATCH_BYTES, SHARD_BYTES = 1 << 19, 1 << 18
# Bytes of segments that one task merges, batch by batch, about.
TASK_BYTES = 4 << 20
# An anchor with more different segments than this is not one task's work: its windows are grouped one by one.
HOT_SEGMENTS = 20_000


# ---------------------------------------------------------------- segments


def _segments(data: np.ndarray, bounds: np.ndarray):
    """Runs of windows with one anchor place: anchor, row, first byte, number of windows."""
    n = len(data)
    count = n - WINDOW + 1
    if count <= 0:
        return [np.zeros(0, np.int64)] * 4
    least = A.window_hashes(A.prefix_hashes(data), GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least &= ~low
    least |= np.arange(len(least), dtype=np.uint64) & low
    span, other = 1, np.empty_like(least)
    while span < _INSIDE:
        step = min(span, _INSIDE - span)
        least, other = np.minimum(least[:-step], least[step:], out=other[: len(least) - step]), least
        span += step
    first, last = bounds[:-1], np.maximum(bounds[1:] - WINDOW + 1, bounds[:-1])
    inside = np.repeat(np.tile([True, False], len(first)), np.stack([last - first, bounds[1:] - last], 1).ravel())[:count]
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    # A row whose windows adjoin the row before it starts a run of its own.
    heads = first[(first < last) & (first < count)]
    fresh[heads] = True
    begin = np.flatnonzero(fresh)
    rows = np.searchsorted(bounds, begin, "right") - 1
    following = np.append(begin[1:], count)
    length = np.minimum(following, last[rows]) - begin
    pieces = -(-length // _LONGEST)
    owner = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begin[owner] + nth * _LONGEST
    size = np.minimum(length[owner] - nth * _LONGEST, _LONGEST)
    anchors = (least[begin] >> np.uint64(_PLACE_BITS)).astype(np.int64)[owner]
    return anchors, rows[owner], at, size


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, bounds in A.blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_segments(data, bounds)[0])], names=["anchor"])


def _filter_bits(slots: DataFrame) -> np.ndarray:
    """A bit array of the numbers in column ``slot``; its words are combined on the executors."""
    held = slots.groupBy(F.expr("slot div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for part in held.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        bits[part.column("at").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
    return bits


def _knows(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def _place_slots(row_hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Filter slots of places: the hash of a row's key and text, and an offset in the text."""
    return (A.mix(row_hashes.view(np.uint64) ^ A.mix(at.astype(np.uint64) + np.uint64(1))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_place_slots(batch.column("hash").to_numpy(), batch.column("at").to_numpy()))], names=["slot"])


# ---------------------------------------------------------------- transforms


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers; sorted together with their places where both fit into 64 bits, which is much faster."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = _ordered(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank


def _strings(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ``SYMBOL`` bytes: each segment gives one string for every phase, closed by symbol 0.

    Returns the symbols, the index of the symbol that follows (cyclic in its string), the symbol index of each byte, and where
    the symbols of each segment begin.
    """
    lengths = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(s + bytes(SYMBOL) for s in segments) + bytes(2 * SYMBOL), np.uint8)
    begins = np.cumsum(lengths + SYMBOL) - lengths - SYMBOL
    owner = np.repeat(np.arange(len(segments)), lengths)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = begins[owner] + inner
    # Exact ranks of the bytes read from each place: five, then twice as many each time. What closes a segment keeps the next one out.
    rank = np.zeros(len(data) - SYMBOL, np.int64)
    for i in range(5):
        rank = (rank << 8) | data[i : i + len(rank)]
    rank, size = _ranked(rank), 5
    while size < SYMBOL:
        rank = _ranked(rank[:-size] * (int(rank.max()) + 1) + rank[size:])
        size *= 2
    rank = rank[at]
    phases = np.arange(SYMBOL)
    counts = (lengths[:, None] - phases + SYMBOL - 1) // SYMBOL + 1  # and the closing symbol
    counts = np.maximum(counts, 1)
    ends = np.cumsum(counts.ravel())
    firsts = ends - counts.ravel()
    where = firsts[SYMBOL * owner + inner % SYMBOL] + inner // SYMBOL
    symbols = np.zeros(ends[-1], np.int64)
    symbols[where] = rank + 1
    following = np.arange(1, len(symbols) + 1)
    following[ends - 1] = firsts
    return symbols, following, where, np.append(firsts[::SYMBOL], ends[-1])


def _shard_order(symbols: np.ndarray, following: np.ndarray, depth: int) -> np.ndarray:
    """Places of a shard sorted by the ``depth`` or more symbols read from them."""
    rank, jump, reach = symbols, following, 1
    while reach < depth:
        rank = _ranked(rank * (int(rank.max()) + 1) + rank[jump])
        jump, reach = jump[jump], reach * 2
    return _ordered(rank)


def merged_intervals(segments: list[bytes], shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the segments, the number of its interval: equal where at least ``WINDOW`` equal bytes follow.

    Bytes nearer to their segment's end get some interval too, which means nothing. Also returns the offsets of the segments'
    bytes.

    Shards of segments are sorted each on its own and give their transforms. The merge keeps, for each place of the
    common order, the shard it comes from. It starts with all of one shard after the other; each round reads the
    transforms along the interleave and deals the places out by the symbol before them, so that after ``r`` rounds they are in order
    of ``r`` symbols. Intervals of common prefix are split where the dealt symbol or the interval before differ.
    """
    lengths = np.array([len(s) for s in segments])
    sizes = np.cumsum(lengths)
    bounds = np.flatnonzero(np.diff(sizes // shard_bytes, prepend=-1)).tolist() + [len(segments)]
    symbols, following, where, firsts = _strings(segments)
    orders, transforms, sources = [], [], []
    for number, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        a, b = int(firsts[low]), int(firsts[high])
        order = _shard_order(symbols[a:b], following[a:b] - a, WINDOW // SYMBOL)
        before = np.empty(b - a, np.int64)
        before[following[a:b] - a] = np.arange(b - a)
        orders.append(order + a)
        transforms.append(symbols[a:b][before[order]])
        sources.append(np.full(b - a, number, np.uint16))
    transform, source = np.concatenate(transforms), np.concatenate(sources)
    interval = np.zeros(len(source), np.int64)
    read = np.empty(len(source), np.int64)
    for _ in range(WINDOW // SYMBOL):
        read[np.argsort(source, kind="stable")] = transform
        dealt = _ordered(read)
        source, symbol, interval = source[dealt], read[dealt], interval[dealt]
        split = np.zeros(len(source), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(split)
    place = np.empty(len(source), np.int64)
    place[np.concatenate(orders)] = interval[np.argsort(source, kind="stable")]
    return place[where], np.concatenate([[0], sizes])


def _decide(segments: list[bytes], counts: list[int]) -> list[list[tuple[int, int]]]:
    """Removed windows of each segment, as runs ``[first, last)`` of its windows; segments are in order of their places."""
    interval, offsets = merged_intervals(segments)
    lengths = np.array(counts)
    owner = np.repeat(np.arange(len(segments)), lengths)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = offsets[owner] + inner
    earliest = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, interval[at], at)
    gone = earliest[interval[at]] < at
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    runs: list[list[tuple[int, int]]] = [[] for _ in segments]
    firsts = np.cumsum(lengths) - lengths
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
        while low < high:  # a run may go on into the next segment
            i = int(owner[low])
            stop = min(high, int(firsts[i] + lengths[i]))
            runs[i].append((low - int(firsts[i]), stop - int(firsts[i])))
            low = stop
    return runs


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges of the segments, which are sorted by anchor and place; whole anchors are decided together."""
    held: list[tuple] = []
    size, last = 0, None
    key_type = None

    def decided():
        rows = []
        for (key, at, _, _), runs in zip(held, _decide([h[3] for h in held], [h[2] for h in held])):
            rows += [(key, at + low, at + high + WINDOW - 1) for low, high in runs]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["key", "low", "high"])

    for batch in batches:
        key_type = batch.column("key").type
        for anchor, *segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "at", "windows", "bytes"))):
            if size > BATCH_BYTES and anchor != last:
                yield decided()
                held, size = [], 0
            if held and anchor == last and held[-1][:2] == tuple(segment[:2]):
                continue  # of a row that is there twice
            held.append(tuple(segment))
            size, last = size + len(segment[3]), anchor
    if held:
        yield decided()


# ---------------------------------------------------------------- removal


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in A.blocks(batches):
        out = []
        for i, runs in enumerate(rows.column("runs").to_pylist()):
            text = data[bounds[i] : bounds[i + 1]]
            gone = np.zeros(len(text) + 2, np.int32)
            for run in runs or ():
                gone[run["low"] + 1] += 1
                gone[run["high"] + 1] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            kept = text[~covered[1:]].tobytes()
            out.append((len(text), int(covered.sum()), int((covered[1:] & ~covered[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([rows.column("key"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if it lies in a ``WINDOW``-byte string that also starts earlier: in a row with a smaller key (null first), or further left in the same
    row. Strings are those of the input. Rows of one key are ordered by a hash of their texts; fully equal rows count as
    one document and get the same result. Null and short texts keep all.
    """
    spark = documents.sparkSession
    rows = keyed_texts(documents, key, text).withColumn("key", F.struct("key", F.xxhash64("text").alias("hash")))
    twice = rows.mapInArrow(_anchors, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    bits = spark.sparkContext.broadcast(_filter_bits(twice.select(F.col("anchor").bitwiseAND(FILTER_BITS - 1).alias("slot"))))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            anchors, owner, at, size = _segments(data, bounds)
            wanted = _knows(bits.value, anchors & (FILTER_BITS - 1))
            anchors, owner, at, size = anchors[wanted], owner[wanted], at[wanted], size[wanted]
            hashes = A.span_hashes(A.prefix_hashes(data), at, at + size + WINDOW - 1).view(np.int64)
            columns = [part.column("key").take(pa.array(owner)), *map(pa.array, (anchors, hashes, at - bounds[owner], size))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "anchor", "hash", "at", "windows"])

    kind = rows.schema["key"].dataType.simpleString()
    found = written(rows.mapInArrow(collect, f"key {kind}, anchor bigint, hash bigint, at bigint, windows bigint"), "segments", compression="zstd")

    # Equal segments collapse to the earliest; all others go wholly.
    place = F.struct("key", "at")
    variants = written(found.groupBy("anchor", "hash").agg(F.min(place).alias("first"), F.max("windows").alias("windows")), "segment-variants", compression="zstd")
    later = found.join(variants.select("anchor", "hash", "first"), ["anchor", "hash"]).filter(place != F.col("first"))
    from_copies = later.select("key", F.col("at").alias("low"), (F.col("at") + F.col("windows") + WINDOW - 1).alias("high"))

    # Anchors with several different segments: the segments' bytes are fetched and compared.
    several = written(variants.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("windows") + WINDOW - 1).alias("bytes")).filter("n > 1"), "segment-anchors")
    hot = several.filter(F.col("n") > HOT_SEGMENTS).select("anchor")
    needed = variants.join(several, "anchor").select("first.key", "first.at", F.xxhash64("first.key.key", "first.key.hash").alias("hash"))
    asked = spark.sparkContext.broadcast(_filter_bits(needed.select("hash", "at").mapInArrow(_place_rows, "slot bigint")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            anchors, owner, at, size = _segments(data, bounds)
            own = np.asarray(part.column("own")).astype(np.int64)
            wanted = _knows(bits.value, anchors & (FILTER_BITS - 1)) & _knows(asked.value, _place_slots(own[owner], at - bounds[owner]))
            anchors, owner, at, size = anchors[wanted], owner[wanted], at[wanted], size[wanted]
            raw = data.tobytes()
            pieces = [raw[a : a + s + WINDOW - 1] for a, s in zip(at.tolist(), size.tolist())]
            columns = [part.column("key").take(pa.array(owner)), pa.array(anchors), pa.array(at - bounds[owner]), pa.array(size), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "anchor", "at", "windows", "bytes"])

    # The filter may let other places through, and all rows of one key and text hold the place: just one row's segment stays, as copies
    # would all lie under one anchor.
    fetched = rows.withColumn("own", F.xxhash64("key.key", "key.hash")).mapInArrow(fetch, f"key {kind}, anchor bigint, at bigint, windows bigint, bytes binary")
    segments = fetched.join(needed.select("key", "at"), ["key", "at"], "left_semi")
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        segments = segments.dropDuplicates(["key", "at"])
    removed, mild = from_copies, segments
    if not hot.isEmpty():
        segments = written(segments, "segment-bytes", compression="zstd")
        mild = segments.join(hot, "anchor", "left_anti")
        single = segments.join(hot, "anchor", "left_semi").select("key", "at", "bytes", F.explode(F.expr("sequence(0L, windows - 1)")).alias("i"))
        single = written(single.select("key", (F.col("at") + F.col("i")).alias("at"), F.expr(f"substring(bytes, int(i) + 1, {WINDOW})").alias("bytes")), "hot-windows", compression="zstd")
        earliest = single.groupBy("bytes").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
        from_hot = single.join(earliest, "bytes").filter(place != F.col("earliest")).select("key", F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high"))
        removed = removed.unionByName(from_hot)
    total = several.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    by_anchor = mild.repartition(1 + int(total) // TASK_BYTES, "anchor").sortWithinPartitions("anchor", "key", "at")
    removed = removed.unionByName(by_anchor.mapInArrow(_merge_batches, f"key {kind}, low bigint, high bigint"))

    runs = removed.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    key_kind = rows.schema["key"].dataType["key"].dataType.simpleString()
    joined = rows.join(runs, "key", "left").select("key.key", "text", "runs")
    shape = f"key {key_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.mapInArrow(_cut, shape).withColumnRenamed("key", key)
