"""Numpy views of text columns inside Arrow tasks: bounded blocks, word spans and 64-bit hashes.

A block is a run of rows with their UTF-8 bytes in one array. Everything here works on all rows of a block at once
and never joins bytes of two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a task turns into arrays at once; one longer row is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES):
    """Yield ``(rows, data, bounds)``: a slice of a batch, its bytes, and ``len(rows) + 1`` offsets into them.

    Null texts count as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        payload = column.buffers()[2]
        everything = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            low, high = int(offsets[first]), int(offsets[last])
            yield batch.slice(first, last - first), everything[low:high], offsets[first : last + 1] - low
            first = last


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` within rows: starts, ends and the row of each."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    starts[heads] = inside[heads]
    ends[tails] = inside[tails]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(first, bounds)))


def _power(base: int, length: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < length:
        size = max(length, BLOCK_BYTES + 1)
        known = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            done = 1
            while done < size:
                step = min(done, size - done)
                known[done : done + step] = known[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        _powers[base] = known
    return known


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        values = values ^ (values >> np.uint64(27))
        values = values * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which ``span_hashes`` gets the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        terms = np.add(data, np.uint64(1), out=sums[1:])
        np.multiply(terms, _power(_BASE, len(data))[: len(data)], out=terms)
        np.cumsum(terms, out=terms)
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        value = (sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of the ``size`` bytes from each place that has as many."""
    count = max(len(sums) - size, 0)
    with np.errstate(over="ignore"):
        value = (sums[size:] - sums[:count]) * _power(_INVERSE, len(sums))[:count]
        return mix(value + np.uint64(size * 0xD6E8FEB86659FD93 & _MASK))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes (``len(words) - size + 1`` of them, rows not looked at)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mix(total + words[i : i + count] * np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & _MASK))
    return total


def cuts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's items in an array sorted by ``rows``."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
