"""Op 11: periodic runs of words, by enumeration of maximal pairs.

A maximal pair is two equal spans of words whose left neighbours differ and whose right neighbours differ. A run with period ``q``
is the pair of itself without its last ``q`` words and itself without its first ``q`` words: the two stand ``q`` words apart, and
as no neighbour extends the run, the pair is maximal. So maximal pairs whose distance is small against their length are the
runs, and nothing has to be extended.

The pairs of a text come from its tree of LCP intervals, built bottom-up: an interval of length ``L`` joins the places where one
span of ``L`` words stands, by classes of their left words; its children differ in the next word. Places of different children and
different classes are a pair. Only pairs at most ``L / (exponent - 1)`` words apart matter. Places that close to each other overlap
and follow one period, so that all of them but the first have one left word: in such a stretch only the two ends can
be of different classes, and no more than those are looked at. That keeps the work near-linear.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts

LEAST_WORDS = 6
LEAST_EXPONENT = 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"

Pair = tuple[int, int, int]


class _Interval:
    """Places of one span in text order, and their left word if it is the same for all."""

    __slots__ = ("places", "only")

    def __init__(self, place: int, left: int):
        self.places, self.only = [place], left


def _join(one: _Interval, other: _Interval, length: int, reach: int, left: dict[int, int], found: list[Pair]) -> _Interval:
    """One interval of both children's places; pairs between them that differ in their left words go to ``found``."""
    if len(one.places) < len(other.places):
        one, other = other, one
    places = one.places
    if one.only is None or one.only != other.only:
        for place in other.places:
            own = left[place]
            at = bisect_left(places, place)
            first = bisect_left(places, place - reach, 0, at)
            if first < at and left[places[first]] != own:
                found.append((places[first], place, length))
            while at < len(places) and places[at] <= place + reach and left[places[at]] != own:
                found.append((place, places[at], length))
                at += 1
        one.only = None
    if len(other.places) < 8:
        for place in other.places:
            insort(places, place)
    else:
        places.extend(other.places)
        places.sort()
    return one


def close_pairs(order: list[int], shared: list[int], left: dict[int, int], exponent: int = LEAST_EXPONENT) -> list[Pair]:
    """Maximal pairs ``(place, later place, length)`` that stand at most ``length / (exponent - 1)`` apart.

    ``order`` are the places in suffix order, ``shared[k]`` is how many words places ``k`` and ``k - 1`` share, ``left`` the left word of each place.
    """
    found: list[Pair] = []
    unfinished: list[tuple[int, _Interval]] = []
    child = _Interval(order[0], left[order[0]])
    for place, length in zip([*order[1:], None], [*shared[1:], 0]):
        while unfinished and unfinished[-1][0] > length:
            size, interval = unfinished.pop()
            child = _join(interval, child, size, size // (exponent - 1), left, found)
        if unfinished and unfinished[-1][0] == length:
            size, interval = unfinished.pop()
            child = _join(interval, child, size, size // (exponent - 1), left, found)
        if length:
            unfinished.append((length, child))
            child = _Interval(place, left[place])
    return found


def suffix_order(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places sorted by row and then by the words from there to the row's end, in any fixed order of words, by doubling prefixes."""
    count = len(words)
    numbers = np.unique(words, return_inverse=True)[1]
    keys = rows.astype(np.int64) * (int(numbers.max(initial=0)) + 1) + numbers
    order = np.argsort(keys, kind="stable")
    rank = np.empty(count, np.int64)
    open_at, size = np.arange(count), 1
    ranked = keys[order]
    while True:
        heads = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        first = np.maximum.accumulate(np.where(heads, open_at, 0))
        rank[order[open_at]] = first
        alone = heads & np.concatenate([heads[1:], [True]])
        open_at = open_at[~alone]
        if not len(open_at):
            return order
        places = order[open_at]
        ahead = places + size
        # Beyond the last word every place has a value of its own; places of later rows rank behind all of this row.
        beyond = np.where(ahead < count, rank[np.minimum(ahead, count - 1)], ahead)
        keys = rank[places] * (2 * count + size) + beyond
        by = np.argsort(keys, kind="stable")
        order[open_at] = places[by]
        ranked, size = keys[by], 2 * size


def _least_pair(words: int, exponent: int) -> int:
    """Words that the two spans of a run's pair share at least."""
    return min(max(words - d, (exponent - 1) * d) for d in range(1, words + 1))


def block_runs(words: np.ndarray, rows: np.ndarray, n_rows: int, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each row that has any, sorted by start and period; starts count from the first of ``words``."""
    seed = _least_pair(least, exponent)
    grams = A.gram_hashes(words, seed)
    at = np.flatnonzero(rows[: len(grams)] == rows[seed - 1 : seed - 1 + len(grams)])
    if not len(at):
        return {}
    left = np.zeros(len(words), np.uint64)
    left[1:] = np.where(rows[1:] == rows[:-1], words[:-1], np.uint64(0))
    # Groups of equal first words, within rows; only those with several left words can have a maximal pair.
    keys = A.mix(grams[at] ^ A.mix(rows[at].astype(np.uint64) + np.uint64(1)))
    by = np.argsort(keys, kind="stable")
    keys, at = keys[by], at[by]
    follows = np.concatenate([[False], keys[1:] == keys[:-1]])
    group = np.cumsum(~follows) - 1
    differs = follows & (left[at] != left[at[np.flatnonzero(~follows)][group]])
    mixed_group = np.zeros(int(group[-1]) + 1, bool)
    mixed_group[group[differs]] = True
    mixed = at[mixed_group[group]]
    if not len(mixed):
        return {}

    live = np.zeros(n_rows, bool)
    live[rows[mixed]] = True
    inside = np.flatnonzero(live[rows])
    own, own_rows = words[inside], rows[inside]
    ends = np.searchsorted(own_rows, own_rows, "right")
    wanted = np.zeros(len(words), bool)
    wanted[mixed] = True
    order = suffix_order(own, own_rows)
    order = order[wanted[inside[order]]]
    shared = np.concatenate([[0], _shared_words(own, ends, order[:-1], order[1:], seed)])
    heads = np.flatnonzero(shared == 0)
    found: dict[int, dict[tuple[int, int], int]] = {}
    for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
        places = order[low:high]
        row = int(own_rows[places[0]])
        known = found.setdefault(row, {})
        classes = dict(zip(places.tolist(), left[inside[places]].tolist()))
        for place, later, length in close_pairs(places.tolist(), [0, *shared[low + 1 : high].tolist()], classes, exponent):
            period = later - place
            if length + period >= max(least, exponent * period):
                span = (int(inside[place]), length + period)
                known[span] = min(period, known.get(span, period))
    return {row: sorted(((s, n, q) for (s, n), q in known.items()), key=lambda r: (r[0], r[2])) for row, known in found.items() if known}


def _shared_words(words: np.ndarray, ends: np.ndarray, one: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """How many words the spans at two places have in common up to the end of their row; 0 if fewer than ``least``."""
    sums = A.prefix_hashes(words)

    def equal(length: np.ndarray) -> np.ndarray:
        return A.span_hashes(sums, one, one + length) == A.span_hashes(sums, other, other + length)

    high = np.where(ends[one] == ends[other], ends[one] - np.maximum(one, other), 0)
    low = np.zeros(len(one), np.int64)
    while True:
        middle = (low + high + 1) // 2
        if not (low < high).any():
            return np.where(low >= least, low, 0)
        same = equal(middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)


def find_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per row: ``key``, n_words, runs, best, collapsed.

    Words are runs of characters that are no ASCII white space. ``runs`` holds start, length and (smallest) period in words of every
    maximal stretch of at least ``least_words`` words and ``least_exponent`` (3 or more) times its period, by start and period; ``best`` is the
    run with the greatest length / period (ties: smallest start, then period), null without runs. ``collapsed`` are the words joined by
    single blanks, without those that a run holds after its first period. A null, empty or blank text has no words and an empty
    ``collapsed``; repeated rows and null keys keep their rows; other columns are ignored; an empty table gives no rows. Texts
    have any length: a text is worked on whole, in memory in proportion to its words, and nothing is shuffled.
    """
    if least_exponent < 3 or least_words < 1:
        raise ValueError("runs need an exponent of at least 3 and a word")
    rows = keyed_texts(documents, key, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            start, end, row = A.spans(A.NOT_SPACE[data], bounds)
            words = A.span_hashes(A.prefix_hashes(data), start, end)
            firsts = A.cuts(row, part.num_rows)
            runs_of = block_runs(words, row, part.num_rows, least_words, least_exponent)
            runs, best, collapsed = [], [], []
            for i in range(part.num_rows):
                tokens = data[bounds[i] : bounds[i + 1]].tobytes().split()
                runs.append([{"start": s - int(firsts[i]), "length": n, "period": q} for s, n, q in runs_of.get(i, ())])
                best.append(_best(runs[-1]))
                collapsed.append(b" ".join(_kept(tokens, runs[-1]) if runs[-1] else tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(np.diff(firsts), pa.int64()),
                    pa.array(runs, pa.list_(_RUN)),
                    pa.array(best, _RUN),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=["key", "n_words", "runs", "best", "collapsed"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, n_words bigint, runs array<{_RUN_SQL}>, best {_RUN_SQL}, collapsed string").withColumnRenamed("key", key)


def _best(runs: list[dict]) -> dict | None:
    best = None
    for run in runs:  # in order of the ties
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def _kept(tokens: list[bytes], runs: list[dict]) -> list[bytes]:
    depth = np.zeros(len(tokens) + 1, np.int64)
    for run in runs:
        depth[run["start"] + run["period"]] += 1
        depth[run["start"] + run["length"]] -= 1
    return [tokens[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
