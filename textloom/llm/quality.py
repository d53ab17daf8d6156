"""Op 6: quality rules, with perplexity bands from two modified Kneser-Ney models that Spark counts over the corpus.

One model is over byte classes: ``ORDER`` classes of ``BITS`` bits each, one model per language. That bounds a
language's model by ``2 ** (ORDER * BITS)`` n-grams whatever the corpus, so it may be broadcast, ``LANGUAGES`` models at a time.

The other is over pairs of units, which are words, or characters in scripts without blanks. It is counted by ranges of 64-bit hashes and
grows with the corpus. A text is scored by what all other texts hold: its own part is taken from the counts,
as pairs that no other text has would vouch for themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, quoted, released, written
from textloom.llm.filters import KeyFilter, filter_of
from textloom.session import broadcast_if_small

MIN_WORDS = 50
REPEAT_PERCENT = 50
ORDER, BITS = 4, 5
# Class models of so many languages are broadcast at a time; each further slice of languages is a pass of its own.
LANGUAGES = 16
# A document is rejected if its bits per byte lie further from the quartiles of its language than BAND quartile ranges
# (or BAND times LEAST_RANGE bits, where a language's documents are nearly alike).
BAND = 4.0
LEAST_RANGE = 0.02
# The same for bits per unit, where only the upper side rejects: near copies of other texts have few bits.
LEAST_UNIT_RANGE = 0.5
# Bytes of text in a chunk, and pairs in a range of hashes that one task counts at once, both about.
CHUNK_BYTES = 1 << 22
RANGE_PAIRS = 1 << 21
# Pairs that are scored at once, about; a text is scored whole.
SCORED_PAIRS = 1 << 16
# Ranges of pairs and chunks are shuffled in so many turns, whatever the input, which bounds the disk taken; units are asked for in
# ``UNIT_ROUNDS`` and each round's ranges shuffled in ``UNIT_TURNS``.
PAIR_SLICES, CHUNK_SLICES, UNIT_ROUNDS, UNIT_TURNS = 3, 8, 2, 4

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_CLASS = np.full(256, 29, np.uint8)  # 29: other ASCII
_CLASS[:33] = 0
for _i in range(26):
    _CLASS[[ord("a") + _i, ord("A") + _i]] = 1 + _i
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 28
_CLASS[0x80:0xC0] = 30
_CLASS[0xC0:] = 31

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _equals(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal items of a row together, and whether each there equals the one before it."""
    keys = hashes ^ A.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    return order, same


def base_stats(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The columns ``_STATS`` of each row of a block."""
    n_rows = len(bounds) - 1
    inside = A.NOT_SPACE[data]
    sums = A.prefix_hashes(data)
    start, end, row = A.spans(inside, bounds)
    n_words = np.bincount(row, minlength=n_rows)
    word_chars = _per_row(inside & ((data & 0xC0) != 0x80), bounds)

    l_start, l_end, l_row = A.spans(data != 10, bounds)
    words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    filled = words_before[l_end] > words_before[l_start]
    l_row = l_row[filled]
    order, same = _equals(A.span_hashes(sums, l_start[filled], l_end[filled]), l_row)
    n_dup_lines = np.bincount(l_row[order[same]], minlength=n_rows)

    words = A.span_hashes(sums, start, end)
    grams = A.gram_hashes(words, 3)
    repeated = np.zeros(len(words), bool)
    if len(grams):
        at = np.flatnonzero(row[: len(grams)] == row[2 : 2 + len(grams)])
        order, same = _equals(grams[at], row[at])
        twice = same.copy()
        twice[:-1] |= same[1:]
        hits = at[order[twice]]
        for i in range(3):
            repeated[hits + i] = True
    n_repeat = np.bincount(row[repeated], minlength=n_rows)
    return [n_words, word_chars, _per_row(_SYMBOLS[data], bounds), n_dup_lines, n_repeat]


def _gram_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed class n-grams of a block and whether each lies within one row."""
    classes = _CLASS[data].astype(np.int64)
    count = max(len(classes) - ORDER + 1, 0)
    keys = np.zeros(count, np.int64)
    for i in range(ORDER):
        keys = (keys << BITS) | classes[i : i + count]
    whole = np.ones(count, bool)
    for back in range(1, ORDER):
        ends = bounds[1:-1] - back
        whole[ends[(ends >= 0) & (ends < count)]] = False
    return keys, whole


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams by language; at most ``2 ** (ORDER * BITS)`` counters per language are held."""
    counts: dict[str, np.ndarray] = {}
    for rows, data, bounds in A.blocks(batches):
        keys, whole = _gram_keys(data, bounds)
        names = np.array(rows.column("more_0").to_pylist(), object)
        for name in set(names):
            mine = np.repeat(names == name, np.diff(bounds))[: len(keys)] & whole
            held = counts.setdefault(name, np.zeros(1 << (ORDER * BITS), np.int64))
            found, times = np.unique(keys[mine], return_counts=True)
            held[found] += times
    for name, held in counts.items():
        at = np.flatnonzero(held)
        for part in range(0, len(at), 100_000):
            some = at[part : part + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(held[some])], names=["lang", "gram", "c"])


@dataclass
class LanguageModel:
    """One language: sorted n-gram keys of each order with their discounted shares, and contexts with what they leave to the order below."""

    keys: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]

    def table(self) -> np.ndarray:
        """Bits of every possible n-gram of the highest order."""
        p = np.full(1, 1.0 / (1 << BITS))
        for n in range(ORDER):
            size = 1 << (BITS * (n + 1))
            everything = np.arange(size)
            left = np.ones(size >> BITS)
            left[self.contexts[n]] = self.left[n]
            share = np.zeros(size)
            share[self.keys[n]] = self.shares[n]
            # An n-gram's probability: its own share, and of what its context leaves, the probability one order below.
            p = share + left[everything >> BITS] * p[everything & ((size >> BITS) - 1)]
        return -np.log2(np.maximum(p, 1e-30)).astype(np.float32)


def fit_models(documents: DataFrame, text: str, lang: str) -> dict[str, LanguageModel]:
    """Modified Kneser-Ney counts of ``documents`` by language.

    The highest order has counts, each lower one the number of different n-grams it ends. Counting, discounts and
    context sums are Spark aggregations over all documents; the driver gets the finished n-grams, at most
    ``2 ** (ORDER * BITS)`` and their suffixes for each of at most ``LANGUAGES`` languages.
    """
    top = written(
        keyed_texts(documents, text, text, lang).drop("key").mapInArrow(_count_grams, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c")),
        "gram-counts",
    )
    orders = [top]
    for n in range(ORDER - 1, 0, -1):
        orders.append(orders[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * n)) - 1).alias("gram")).agg(F.count("*").alias("c")))
    grams = orders[0].withColumn("n", F.lit(ORDER))
    for step, lower in enumerate(orders[1:], 1):
        grams = grams.unionByName(lower.withColumn("n", F.lit(ORDER - step)))
    grams = written(grams, "gram-orders")

    ones, twos, threes, fours = (F.sum((F.col("c") == i).cast("double")) for i in (1, 2, 3, 4))
    seen = grams.groupBy("lang", "n").agg(ones.alias("n1"), twos.alias("n2"), threes.alias("n3"), fours.alias("n4"))
    y = F.expr("try_divide(n1, n1 + 2 * n2)")

    def discount(i: int):
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0) & (value > 0), value).otherwise(F.lit(0.5 * i))

    discounts = seen.select("lang", "n", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    taken = F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end")
    priced = grams.join(F.broadcast(discounts), ["lang", "n"]).withColumn("taken", F.least(taken, F.col("c")))  # ORDER rows a language
    context = F.shiftright("gram", BITS)
    totals = priced.groupBy("lang", "n", context.alias("context")).agg(F.sum("c").alias("total"), (F.sum("taken") / F.sum("c")).alias("left"))
    shares = priced.withColumn("context", context).join(totals, ["lang", "n", "context"]).select("lang", "n", "gram", ((F.col("c") - F.col("taken")) / F.col("total")).alias("share"))

    # As columns of numbers: rows would be an object each in the driver.
    gram_rows, context_rows = shares.toArrow(), totals.select("lang", "n", "context", "left").toArrow()
    models = {}
    for name in sorted(pc.unique(gram_rows["lang"]).to_pylist()):
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for n in range(1, ORDER + 1):
            for rows, part in ((gram_rows, 0), (context_rows, 2)):
                mine = rows.filter(pc.and_(pc.equal(rows["lang"], name), pc.equal(rows["n"], n)))
                order = np.argsort(mine.column(2).to_numpy())
                parts[part].append(mine.column(2).to_numpy()[order].astype(np.uint32))
                parts[part + 1].append(mine.column(3).to_numpy()[order].astype(np.float32))
        models[name] = LanguageModel(*parts)
    return models


# ---------------------------------------------------------------- pairs of units


def _alone(data: np.ndarray) -> np.ndarray:
    """Lead bytes of characters that are units of their own: kana, Chinese, Thai, Lao, Burmese, Khmer."""
    following = np.append(data[1:], 0).astype(np.uint8)
    found = (data >= 0xE3) & (data <= 0xE9) | (data == 0xF0) & (following >= 0xA0)
    found |= (data == 0xE0) & (following >= 0xB8) & (following <= 0xBB)
    return found | (data == 0xE1) & ((following >= 0x80) & (following <= 0x82) | (following >= 0x9E) & (following <= 0x9F))


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of a block, A-Z lower-cased, and the row of each."""
    data = A.LOWER[data]
    start, end, row = A.spans(A.NOT_SPACE[data], bounds)
    lead = np.flatnonzero(_alone(data))
    if len(lead):
        size = np.where(data[lead] >= 0xF0, 4, 3)
        cut = np.union1d(np.union1d(lead, lead + size), start)
        edges = np.union1d(cut, end)
        begin = edges[:-1]
        word = np.searchsorted(start, begin, "right") - 1
        inside = (word >= 0) & (begin < end[word])
        start, end, row = begin[inside], edges[1:][inside], row[word[inside]]
    return A.span_hashes(A.prefix_hashes(data), start, end), row


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: the upper bytes of small numbers are zeros and cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, count * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).reshape(-1).view(kind)


def _inverse(order: np.ndarray) -> np.ndarray:
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places


_CHUNKS = (
    "chunk bigint, slice int, n_pairs bigint, n_units bigint, n_places bigint, langs array<string>, lang binary, hash array<bigint>, other_hash array<bigint>,"
    " sizes binary, units binary, places binary"
)


def _chunk(parts: list) -> pa.RecordBatch:
    """One row for texts of several blocks: their units as places in a list of the different ones. Units differ by language.

    The list has the frequent units first, by powers of two, and those of one power in order: small places and small differences pack well.
    """
    names = [n for part, _, _ in parts for n in part.column("more_0").to_pylist()]
    langs = sorted(set(names))
    units, places, times = np.unique(np.concatenate([u for _, u, _ in parts]), return_inverse=True, return_counts=True)
    listed = np.argsort(-np.frexp(times)[1], kind="stable")
    units, places = units[listed], _inverse(listed)[places]
    chunk = uuid.uuid4().int >> 65
    sizes = np.concatenate([np.bincount(owner, minlength=part.num_rows) for part, _, owner in parts])
    n_pairs = int(np.maximum(sizes - 1, 0).sum())
    number = {name: i for i, name in enumerate(langs)}
    columns = {
        "chunk": pa.array([chunk], pa.int64()),
        "slice": pa.array([chunk % CHUNK_SLICES], pa.int32()),
        "n_pairs": pa.array([n_pairs], pa.int64()),
        "n_units": pa.array([len(units)], pa.int64()),
        "n_places": pa.array([len(places)], pa.int64()),
        "langs": pa.array([langs], pa.list_(pa.string())),
        "lang": pa.array([_packed(np.array([number[n] for n in names], np.uint32))], pa.binary()),
        **{name: pa.array([np.concatenate([part.column(c).to_numpy() for part, _, _ in parts])], pa.list_(pa.int64())) for name, c in (("hash", "more_1"), ("other_hash", "more_2"))},
        "sizes": pa.array([_packed(sizes.astype(np.uint32))], pa.binary()),
        "units": pa.array([_packed(np.diff(units, prepend=np.uint64(0)))], pa.binary()),
        "places": pa.array([_packed(places.astype(np.uint32))], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _chunked(skipped=None):
    """Texts become rows of ``_CHUNKS``, about ``CHUNK_BYTES`` each; those whose hash the filter may know are left out."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if skipped is not None:
                batch = batch.filter(pa.array(~KeyFilter(skipped.value).has(batch.column("more_1").to_numpy().view(np.uint64))))
            for rows, data, bounds in A.blocks([batch]):
                units, owner = _units(data, bounds)
                salts = A.mix(rows.column("more_3").to_numpy().view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
                held.append((rows, A.mix(units ^ salts[owner]) if len(units) else units, owner))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield _chunk(held)
                    held, size = [], 0
        if held:
            yield _chunk(held)

    return chunks


class _Pairs:
    """The pairs of following units of a chunk, whose ``units`` are in order.

    ``hashes`` are those of its different pairs, in order, and ``v``, ``w`` the places of their units in ``units``. Of each text's different
    pairs, ``row`` is the text, ``pair`` the place in ``hashes`` and ``times`` how often it stands there.
    """

    def __init__(self, r: dict):
        units = np.cumsum(_unpacked(r["units"], r["n_units"], np.uint64), dtype=np.uint64)
        order = np.argsort(units)
        self.units = units[order]
        self.langs, self.lang = r["langs"], _unpacked(r["lang"], len(r["hash"]), np.uint32)
        places = _inverse(order)[_unpacked(r["places"], r["n_places"], np.uint32)]
        owner = np.repeat(np.arange(len(r["hash"])), _unpacked(r["sizes"], len(r["hash"]), np.uint32))
        self.unit_lang = np.zeros(len(self.units), np.int64)
        self.unit_lang[places] = self.lang[owner]
        at = np.flatnonzero(owner[:-1] == owner[1:])
        self.hashes, first, pair = np.unique(A.gram_hashes(self.units[places], 2)[at], return_index=True, return_inverse=True)
        self.v, self.w = places[at[first]], places[at[first] + 1]
        held, self.times = np.unique(owner[at] * max(len(self.hashes), 1) + pair, return_counts=True)
        self.row, self.pair = np.divmod(held, max(len(self.hashes), 1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_ASKED = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary()), ("langs", pa.list_(pa.string())), ("lang", pa.binary())])
_ASKED_DDL = "range int, chunk bigint, n bigint, hashes binary, values binary, langs array<string>, lang binary"


def _by_range(bits: int, chunk: int, hashes: np.ndarray, values: list[np.ndarray], langs: list[str], lang: np.ndarray, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """One row for each range of the sorted ``hashes``: these, as differences, with the values and language of each."""
    lows = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    ends = np.append(np.searchsorted(hashes, lows), len(hashes))
    out = []
    for i in range(part, 1 << bits, parts):
        mine = slice(ends[i], ends[i + 1])
        if ends[i] < ends[i + 1]:
            numbers = np.concatenate([v[mine] for v in values]).astype(np.uint32)
            out.append((i, chunk, int(ends[i + 1] - ends[i]), _packed(np.diff(hashes[mine], prepend=lows[i])), _packed(numbers), langs, _packed(lang[mine].astype(np.uint32))))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ASKED.types)], schema=_ASKED)


class _Asked:
    """The lists of one range of hashes: their lengths, and the items of all brought together by ``order``; ``heads`` are the first of each hash."""

    def __init__(self, asked: pa.Table, bits: int):
        self.counts = asked.column("n").to_pylist()
        low = np.uint64(asked.column("range")[0].as_py() << (64 - bits))
        hashes = np.concatenate([np.cumsum(_unpacked(h.as_py(), n, np.uint64), dtype=np.uint64) + low for h, n in zip(asked.column("hashes"), self.counts)])
        self.order = np.argsort(hashes, kind="stable")
        hashes = hashes[self.order]
        self.heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.sizes = np.diff(np.append(self.heads, len(hashes)))

    def values(self, asked: pa.Table, width: int) -> np.ndarray:
        return np.concatenate([_unpacked(v.as_py(), width * n, np.uint32).reshape(width, n) for v, n in zip(asked.column("values"), self.counts)], 1)

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(self.counts)[:-1])


def _pairs_asked(bits: int, part: int):
    """Per chunk and range of hashes: the hashes of its pairs there, and how many texts hold each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            pairs = _Pairs(r)
            holders = np.bincount(pairs.pair, minlength=len(pairs.hashes))
            yield from _by_range(bits, r["chunk"], pairs.hashes, [holders], [], np.zeros(len(holders), np.uint32), part, PAIR_SLICES)

    return ask


def _pairs_answered(bits: int):
    """For one range of hashes, in the order asked: twice the number of texts that hold a pair, and one more in the first chunk that asks."""

    def answer(asked: pa.Table) -> pa.Table:
        lists = _Asked(asked, bits)
        held = lists.values(asked, 1)[0].astype(np.int64)[lists.order]
        said = np.zeros(len(held), np.uint32)
        said[lists.order] = np.repeat(2 * np.add.reduceat(held, lists.heads), lists.sizes)
        said[lists.order[lists.heads]] += 1
        answers = [_packed(part) for part in lists.split(said)]
        return pa.table({"chunk": asked.column("chunk"), "range": asked.column("range"), "n": asked.column("n"), "answer": pa.array(answers, pa.binary())})

    return answer


def _heard(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each of a chunk's different pairs the number of texts that hold it, and whether this chunk speaks for it."""
    said = np.concatenate([_unpacked(a["answer"], a["n"], np.uint32) for a in sorted(r["answers"], key=lambda a: a["range"])]).astype(np.int64)
    return said >> 1, said & 1 == 1


def _units_asked(bits: int, part: int):
    """Per chunk and range of hashes of this part, for each unit there: texts times pairs that begin with it, different such pairs held by 1 to 4 and more
    texts, and different pairs that end with it. A pair held by several chunks is told by one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            pairs = _Pairs(r)
            c, speaks = _heard(r)
            size = len(pairs.units)
            values = [np.bincount(pairs.v[pairs.pair], minlength=size)]
            values += [np.bincount(pairs.v[speaks & (np.minimum(c, 5) == n)], minlength=size) for n in range(1, 6)]
            values.append(np.bincount(pairs.w[speaks], minlength=size))
            yield from _by_range(bits, r["chunk"], pairs.units, values, r["langs"], pairs.unit_lang, part, UNIT_ROUNDS)

    return ask


_SEEN = ["d_n1", "d_n2", "d_n3", "d_n4", "d_kinds", "d_all", "e_n1", "e_n2", "e_n3", "e_n4", "e_kinds", "e_all"]
_TOLD = 5


def _units_answered(bits: int):
    """For one range of hashes, in the order asked: the sums for each unit, those of pairs held by 3 texts and more as one. Rows without a
    chunk tell ``_SEEN`` of the range's units of a language."""

    def answer(asked: pa.Table) -> pa.Table:
        lists = _Asked(asked, bits)
        total, n1, n2, n3, n4, n5, kinds = np.add.reduceat(lists.values(asked, 7).astype(np.int64)[:, lists.order], lists.heads, axis=1)
        told = np.stack([total, n1, n2, n3 + n4 + n5, kinds])
        back = np.zeros(len(lists.order), np.int64)
        back[lists.order] = np.repeat(np.arange(len(lists.heads)), lists.sizes)
        answers = [_packed(told[:, at].reshape(-1)) for at in lists.split(back)]

        names = sorted({name for langs in asked.column("langs").to_pylist() for name in langs})
        of = [np.array([names.index(name) for name in langs])[_unpacked(lang.as_py(), n, np.uint32)] for langs, lang, n in zip(asked.column("langs").to_pylist(), asked.column("lang"), lists.counts)]
        of = np.concatenate(of)[lists.order[lists.heads]]
        seen = [n1, n2, n3, n4, n1 + n2 + n3 + n4 + n5, total, *[kinds == i for i in range(1, 5)], kinds > 0, kinds]
        seen = np.stack([np.bincount(of, weights=n, minlength=len(names)) for n in seen], 1)
        rows = [(c, r, n, a, None, None) for c, r, n, a in zip(asked.column("chunk").to_pylist(), asked.column("range").to_pylist(), lists.counts, answers)]
        rows += [(None, None, None, None, name, numbers.tolist()) for name, numbers in zip(names, seen)]
        kept = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kept)], names=["chunk", "range", "n", "answer", "lang", "seen"])

    return answer


_RULES = ["d1", "d2", "d3", "e1", "e2", "e3", "e_kinds", "e_all", "e_lost"]


def _taken(counts: np.ndarray, *by: np.ndarray) -> np.ndarray:
    return np.where(counts <= 0, 0.0, np.where(counts == 1, by[0], np.where(counts == 2, by[1], by[2])))


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For each item the number of items of its key and the sums of ``values`` over them."""
    _, group = np.unique(keys, return_inverse=True)
    return [np.bincount(group)[group], *[np.bincount(group, weights=v)[group] for v in values]]


def _bits(row: np.ndarray, c: np.ndarray, v: np.ndarray, w: np.ndarray, told: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Bits of the pairs of whole texts; what only the text itself adds is taken out of every count, sum and discount."""
    d1, d2, d3, e1, e2, e3, e_kinds, e_all, e_lost = rules
    total, n1, n2, more = told[:4, v]
    kinds, alone, size = told[4, w], (c == 1).astype(np.float64), told.shape[1]
    own, own_lost = _sums(row * size + v, _taken(c, d1, d2, d3) - _taken(c - 1, d1, d2, d3))
    others, others_lost = total - own, n1 * d1 + n2 * d2 + more * d3 - own_lost
    ways, gone = _sums(row * size + w, alone)
    before = kinds - np.rint(gone).astype(np.int64)
    _, lone, lost = _sums(row, alone, (_taken(kinds, e1, e2, e3) - _taken(before, e1, e2, e3)) / ways)
    base, base_lost = e_all - lone, e_lost - lost
    unit = np.where(base > 0, (before - _taken(before, e1, e2, e3) + base_lost / e_kinds) / np.where(base > 0, base, 1), 1 / e_kinds)
    pair = np.where(others > 0, (c - 1 - _taken(c - 1, d1, d2, d3) + others_lost * unit) / np.where(others > 0, others, 1), unit)
    return -np.log2(np.maximum(pair, 1e-30))


def _unit_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text of two units or more its bits, some texts of a chunk at a time."""
    for r in _rows(batches):
        pairs, (c, _) = _Pairs(r), _heard(r)
        told = np.concatenate([_unpacked(t["answer"], _TOLD * t["n"], np.int64).reshape(_TOLD, -1) for t in sorted(r["told"], key=lambda t: t["range"])], 1)
        by_lang = {rule["lang"]: [rule[name] for name in _RULES] for rule in r["rules"]}
        rules = np.array([by_lang.get(name, [0.0] * len(_RULES)) for name in r["langs"]]).T
        sums, count = np.zeros(len(r["hash"])), np.zeros(len(r["hash"]))
        edges = np.append(np.unique(np.searchsorted(pairs.row, pairs.row[::SCORED_PAIRS])), len(pairs.row))
        for low, high in zip(edges[:-1], edges[1:]):
            row, pair, times = pairs.row[low:high], pairs.pair[low:high], pairs.times[low:high]
            bits = _bits(row, c[pair], pairs.v[pair], pairs.w[pair], told, rules[:, pairs.lang[row]])
            sums += np.bincount(row, weights=times * bits, minlength=len(sums))
            count += np.bincount(row, weights=times, minlength=len(sums))
        some = np.flatnonzero(count)
        names = [pa.array(np.array(r[name], np.int64)[some]) for name in ("hash", "other_hash")]
        yield pa.RecordBatch.from_arrays([*names, pa.array(sums[some] / count[some])], names=["hash", "other_hash", "unit_bits"])


def _discounts(seen: DataFrame, prefix: str) -> DataFrame:
    """Per language the discounts of counts of one, two and more, and the sums of all counts and of what they lose. ``seen`` has n1 to n4,
    how many counts are 1 to 4, and the number (kinds) and sum (all) of all."""
    y = F.expr("try_divide(n1, n1 + 2 * n2)")

    def discount(i: int):
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        # Counts get smaller by a text's own part, so a discount is never more than its count.
        return F.least(F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (value > 0), value).otherwise(F.lit(0.5 * i)), F.lit(float(i)))

    seen = seen.select("*", *[discount(i).alias(f"{prefix}{i}") for i in (1, 2, 3)])
    lost = F.expr(f"n1 * {prefix}1 + n2 * {prefix}2 + (kinds - n1 - n2) * {prefix}3")
    return seen.select("lang", *[f"{prefix}{i}" for i in (1, 2, 3)], F.col("kinds").alias(f"{prefix}_kinds"), F.col("all").alias(f"{prefix}_all"), lost.alias(f"{prefix}_lost"))


def _chunks_of(texts: DataFrame) -> DataFrame:
    """The different texts of each language in chunks. Only texts whose hash stands twice, or seems to, are shuffled to find the copies."""
    context = texts.sparkSession.sparkContext
    copied = context.broadcast(filter_of(texts.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1"), "hash").packed)
    rows = keyed_texts(texts, "hash", "text", "lang", "hash", "other_hash", "salt")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(KeyFilter(copied.value).has(batch.column("more_1").to_numpy().view(np.uint64))))

    once = written(rows.mapInArrow(suspects, rows.schema).dropDuplicates(["more_1", "more_2"]), "quality-copied-texts", compression="zstd")
    chunks = written(rows.mapInArrow(_chunked(copied), _CHUNKS).unionAll(once.mapInArrow(_chunked(), _CHUNKS)).filter("n_pairs > 0"), "unit-chunks", by="slice")
    released(once)
    return chunks


def unit_bits(texts: DataFrame) -> DataFrame:
    """Per different text of ``texts`` (lang, text, hash, other_hash; not empty): hash, other_hash, unit_bits, the mean bits of a unit after the
    one before it. The two hashes name a text of a language.

    The model is of order two, interpolated, and counts texts: a pair counts once for each text that holds it, a unit by the different
    units before it. What only the scored text adds is left out of every count, sum and discount of the formula. Vocabularies
    are closed: an unknown unit is one of the language's. Texts of less than two units have no row.

    Texts are cut into units once and kept as chunks. Chunks ask how many texts hold each of their pairs by sorted 64-bit hashes, one list for
    each range of hashes; where a range is counted, each list is answered in its order. Units are counted in the same way. So no pair or unit
    is ever a row. All goes in slices, which bound what is shuffled and stored at a time.
    """
    chunks = _chunks_of(texts.withColumn("salt", F.xxhash64("lang")))
    n_pairs = chunks.agg(F.sum("n_pairs")).first()[0] or 0
    bits = max(-(-n_pairs // RANGE_PAIRS) - 1, 2 * chunks.sparkSession.sparkContext.defaultParallelism).bit_length()

    def some(i: int, *heard: DataFrame) -> DataFrame:
        mine = F.col("chunk") % CHUNK_SLICES == i
        return reduce(lambda rows, table: rows.join(table.filter(mine), "chunk"), heard, chunks.filter(F.col("slice") == i))

    def gathered(slices: list[DataFrame], name: str) -> DataFrame:
        answers = reduce(DataFrame.unionAll, slices).filter("chunk is not null")
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "answer")).alias(name))

    shape = "chunk bigint, range int, n bigint, answer binary"
    counted = [written(chunks.mapInArrow(_pairs_asked(bits, i), _ASKED_DDL).groupBy("range").applyInArrow(_pairs_answered(bits), shape), "pair-counts") for i in range(PAIR_SLICES)]
    answers = gathered(counted, "answers")
    shape_of_units = f"{shape}, lang string, seen array<double>"
    units = []
    for part in range(UNIT_ROUNDS):
        asked = [written(some(i, answers).mapInArrow(_units_asked(bits, part), _ASKED_DDL), "units-asked") for i in range(CHUNK_SLICES)]
        lists = reduce(DataFrame.unionAll, asked)
        for turn in range(part, UNIT_ROUNDS * UNIT_TURNS, UNIT_ROUNDS):
            mine = lists.filter(F.col("range") % (UNIT_ROUNDS * UNIT_TURNS) == turn)
            units.append(written(mine.groupBy("range").applyInArrow(_units_answered(bits), shape_of_units), "unit-counts"))
        released(*asked)
    told = gathered(units, "told")
    seen = reduce(DataFrame.unionAll, units).filter("lang is not null").groupBy("lang").agg(*[F.sum(F.col("seen")[i]).alias(name) for i, name in enumerate(_SEEN)])
    rules = [_discounts(seen.select("lang", *[F.col(name).alias(name[2:]) for name in _SEEN if name.startswith(prefix)]), prefix) for prefix in "de"]
    rules = written(rules[0].join(rules[1], "lang").select("lang", *_RULES), "pair-rules")
    rules = chunks.select("chunk", F.explode("langs").alias("lang")).join(rules, "lang").groupBy("chunk").agg(F.collect_list(F.struct("lang", *_RULES)).alias("rules"))
    found = [written(some(i, answers, told, rules).mapInArrow(_unit_scores, "hash bigint, other_hash bigint, unit_bits double"), "unit-bits") for i in range(CHUNK_SLICES)]
    released(chunks, *counted, *units)
    return reduce(DataFrame.unionAll, found)


# ---------------------------------------------------------------- scores


def _class_scores(prepared: DataFrame) -> DataFrame:
    """Per row: key, lang, hash, other_hash, the columns ``_STATS`` and bits. ``prepared`` holds key, text, lang and both hashes."""
    models = prepared.sparkSession.sparkContext.broadcast(fit_models(prepared, "text", "lang"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for rows, data, bounds in A.blocks(batches):
            stats = base_stats(data, bounds)
            keys, whole = _gram_keys(data, bounds)
            names = np.array(rows.column("more_0").to_pylist(), object)
            bits = np.zeros(len(data))
            for name in set(names):
                if name not in tables:
                    tables[name] = models.value[name].table() if name in models.value else np.zeros(1 << (ORDER * BITS), np.float32)
                mine = np.repeat(names == name, np.diff(bounds))[: len(keys)] & whole
                bits[: len(keys)][mine] = tables[name][keys[mine]]
            sums = np.concatenate([[0.0], np.cumsum(bits)])
            count = np.maximum(np.diff(bounds) - ORDER + 1, 0)
            mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(count, 1)
            columns = [*[rows.column(c) for c in ("key", "more_0", "more_1", "more_2")], *[pa.array(s, pa.int64()) for s in stats], pa.array(mean, pa.float64(), mask=count == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "hash", "other_hash", *_STATS, "bits"])

    kind = prepared.schema["key"].dataType.simpleString()
    shape = f"key {kind}, lang string, hash bigint, other_hash bigint, {', '.join(s + ' bigint' for s in _STATS)}, bits double"
    return written(keyed_texts(prepared, "key", "text", "lang", "hash", "other_hash").mapInArrow(score, shape), "quality-scores")


def score_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, base counts, base_failed, kept, lang_class, bits (bits per byte; null below ``ORDER`` bytes), unit_bits (see there).

    Words are runs without ASCII white space. ``kept`` is false for rows that fail a base rule, for those whose bits per byte lie outside
    their language's band, and for those whose bits per unit lie above it. Every language has models and bands of its own; rows
    without one are a class of their own, with a null lang_class. Null and empty texts have no words and fail. Repeated and null keys keep
    their rows. Without documents there are no rows.
    """
    # "=" tells the empty name from none.
    own = F.coalesce(F.concat(F.lit("="), quoted(lang).cast("string")), F.lit(""))
    prepared = documents.select(quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("text"), own.alias("lang"))
    prepared = prepared.select("*", F.xxhash64("lang", "text").alias("hash"), F.xxhash64(F.lit(1), "lang", "text").alias("other_hash"))
    names = [r.lang for r in prepared.groupBy("lang").count().orderBy(F.desc("count"), "lang").select("lang").collect()]
    slices = [names[i : i + LANGUAGES] for i in range(0, len(names), LANGUAGES)] or [[]]
    scored = _class_scores(prepared if len(slices) == 1 else prepared.filter(F.col("lang").isin(slices[0])))
    for some in slices[1:]:
        scored = scored.unionByName(_class_scores(prepared.filter(F.col("lang").isin(some))))

    # Equal texts of a language are one: copies would vouch for each other.
    units = unit_bits(prepared.drop("key").filter("text <> ''"))
    scored = written(scored.join(units, ["hash", "other_hash"], "left").drop("hash", "other_hash"), "quality-unit-scores")

    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    quartiles = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(q) for c, q in (("bits", "q"), ("unit_bits", "u"))]
    bands = (
        scored.filter(~failed)
        .groupBy(F.col("lang").alias("band_lang"))
        .agg(*quartiles)
        .selectExpr("band_lang", "q[0] as q1", "q[1] as q3", f"greatest(q[1] - q[0], {LEAST_RANGE}D) as width", f"u[1] + {BAND}D * greatest(u[1] - u[0], {LEAST_UNIT_RANGE}D) as most")
    )
    outside = F.expr(f"bits < q1 - {BAND} * width or bits > q3 + {BAND} * width")
    return scored.join(broadcast_if_small(bands), F.col("lang") == F.col("band_lang"), "left").select(
        F.col("key").alias(key),
        *_STATS,
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(outside, F.lit(False)) & ~F.coalesce(F.expr("unit_bits > most"), F.lit(False))).alias("kept"),
        F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("lang_class"),
        "bits",
        "unit_bits",
    )


def good_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, columns unchanged. Keys must identify rows; rows with a null key go."""
    kept = score_documents(documents, key, text, lang).filter("kept").select(quoted(key).alias("kept_key"))
    return documents.join(kept, quoted(key) == F.col("kept_key"), "left_semi")
