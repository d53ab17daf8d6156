"""Bit filters over 64-bit hashes: which keys a task has to look at.

A filter never says no to a key that is in it, so it steers work and never results. Its size follows the number of keys up to a
bound; beyond the bound it lets more keys through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of a filter for every key, and at most: 32 MB.
BITS_A_KEY = 16
MOST_BITS = 1 << 28
_FEWEST_BITS = 1 << 16

# The second bit number comes from the upper bits of a hash, which the first never uses.
_UPPER = 34


def filter_bits(keys: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for so many keys, a power of two."""
    bits = _FEWEST_BITS
    while bits < keys * BITS_A_KEY and bits < most:
        bits *= 2
    return bits


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit numbers of each hash."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(_UPPER)) & mask).astype(np.int64)


class KeyFilter:
    """A packed array of bits that is asked by hash."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, len(packed) * 8

    def has(self, hashes: np.ndarray) -> np.ndarray:
        one, other = slots(hashes, self.bits)
        return self._bit(one) & self._bit(other)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def add(self, hashes: np.ndarray) -> None:
        for at in slots(hashes, self.bits):
            np.bitwise_or.at(self.packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def filter_of(keys: DataFrame, column: str, rows: int | None = None, most: int = MOST_BITS) -> KeyFilter:
    """A filter of the 64-bit values in ``column``, nulls left out.

    Spark combines the bits; the driver receives at most one row for every 64 bits of the filter.
    """
    bits = filter_bits(keys.count() if rows is None else rows, most)
    value = F.col(column)
    both = F.array(value.bitwiseAND(bits - 1), F.shiftrightunsigned(value, _UPPER).bitwiseAND(bits - 1))
    words = (
        keys.filter(value.isNotNull())
        .select(F.explode(both).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    packed = np.zeros(bits // 64, np.int64)
    packed[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return KeyFilter(packed.view(np.uint8))


class SeenTwice:
    """What a task has seen: a filter of keys seen once or more and one of keys seen twice or more."""

    def __init__(self, bits: int):
        self.once, self.twice = KeyFilter(np.zeros(bits // 8, np.uint8)), KeyFilter(np.zeros(bits // 8, np.uint8))

    def see(self, hashes: np.ndarray) -> None:
        """Note sightings; a hash that is given several times is seen several times."""
        fresh, counts = np.unique(hashes, return_counts=True)
        self.twice.add(fresh[(counts > 1) | self.once.has(fresh)])
        self.once.add(fresh)

    def pieces(self) -> Iterator[pa.RecordBatch]:
        """The pieces of both filters that are not empty, packed."""
        for at in range(0, len(self.once.packed), _PIECE):
            once = self.once.packed[at : at + _PIECE]
            if once.any():
                both = [pa.array([pa.compress(f.tobytes(), "zstd", asbytes=True)], pa.binary()) for f in (once, self.twice.packed[at : at + _PIECE])]
                yield pa.RecordBatch.from_arrays([pa.array([at // _PIECE], pa.int32()), *both], names=["piece", "once", "twice"])


# Bytes of a filter that travel as one row.
_PIECE = 1 << 13
PIECES = "piece int, once binary, twice binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by number become one each: what two tasks have seen once has been seen twice."""

    def unpacked(value) -> np.ndarray:
        return np.frombuffer(pa.decompress(value.as_py(), _PIECE, "zstd", asbytes=True), np.uint8)

    def row(piece: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["piece", "twice"])

    last, seen, again = None, None, None
    for batch in batches:
        for piece, once, twice in zip(batch.column("piece").to_pylist(), batch.column("once"), batch.column("twice")):
            if piece != last:
                if last is not None:
                    yield row(last, again)
                last, seen, again = piece, np.zeros(_PIECE, np.uint8), np.zeros(_PIECE, np.uint8)
            own = unpacked(once)
            again |= unpacked(twice) | (seen & own)
            seen |= own
    if last is not None:
        yield row(last, again)


def seen_twice(pieces: DataFrame, bits: int) -> KeyFilter:
    """One filter of the keys seen twice by all tasks together, from the ``pieces`` of each.

    Pieces are merged on the executors, one at a time; the driver receives the result, which is as large as the filter.
    """
    spark = pieces.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    merged = pieces.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(_merged, "piece int, twice binary")
    packed = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        packed[r.piece * _PIECE : (r.piece + 1) * _PIECE] = np.frombuffer(bytes(r.twice), np.uint8)
    return KeyFilter(packed)
