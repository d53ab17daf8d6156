"""Op 13: phrase collocations by best-first branch and bound.

A phrase scores by its weakest cut: its count times the number of words, over the product of the counts of both parts. Cut after
the first word, the second part is no rarer than the phrase. So no phrase that starts with a word found ``f`` times scores above
``n / f``, and each first word is a branch whose bound is known before any phrase is counted.

Branches are taken best bound first, in batches that grow by a factor. A batch is grown word by word, each step one scan that
extends only prefixes counted often enough. Then one scan counts the second parts of all cuts and looks at the word before each
phrase, which tells whether a longer phrase takes its place. A language is settled as soon as its last wanted
score is above the bound of the next branch: whatever was not grown scores less, and ties are all in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, written
from textloom.llm.filters import KeyFilter, filter_of

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
UNKNOWN = "und"

# Branches of the first batch for every wanted phrase, and how much the batches grow.
FIRST_BRANCHES = 4
GROWTH = 8

_NO_WORD = np.zeros(256, bool)
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_WORD[[0x20, 0x09]] = True
_IN_WORD = ~(_NO_WORD | _BREAKS)

_WORDS = [f"w{i}" for i in range(1, MOST_WORDS + 1)]

# Counts of up to 18 digits: their products are exact in decimals.
_SCORE = "cast(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) as decimal(38,0)) * 1000 div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"


class _Words:
    """The words of a block: hashes that differ by language, rows, and how many more words follow in the same piece."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.data = A.LOWER.take(data)
        self.start, self.end, self.row = A.spans(_IN_WORD.take(data), bounds)
        languages = part.column("more_0").dictionary_encode()
        salts = np.array([_salt(name) for name in languages.dictionary.to_pylist()], np.uint64)
        self.language = languages.indices.to_numpy(zero_copy_only=False)[self.row]
        self.names = languages.dictionary
        hashes = A.span_hashes(A.prefix_hashes(self.data), self.start, self.end)
        self.hash = A.mix(hashes ^ salts[self.language]) if len(hashes) else hashes
        # A piece starts with the first word behind a break and with that of a row.
        count = len(self.hash)
        fresh = np.zeros(count + 1, bool)
        fresh[np.searchsorted(self.start, np.flatnonzero(_BREAKS.take(data)))] = True
        fresh[1:count] |= self.row[1:] != self.row[:-1]
        fresh[[0, count]] = True
        heads = np.flatnonzero(fresh)
        sizes = np.diff(heads)
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        self.after = np.repeat(heads[1:] - 1, sizes) - np.arange(count)

    def grams(self, size: int) -> np.ndarray:
        """The hash of the words from each place, in no way checked for the piece's end."""
        return A.gram_hashes(self.hash, size)

    def inside(self, size: int) -> np.ndarray:
        """Places where ``size`` words of one piece start."""
        return np.flatnonzero(self.after >= size - 1)


def _salt(name: str) -> int:
    """A hash of a language's name that no word's hash follows from, or the word "de" of "en" would be the word "en" of "de"."""
    data = np.frombuffer(name.encode(), np.uint8)
    hashes = A.span_hashes(A.prefix_hashes(data), np.array([0]), np.array([len(data)]))
    return int(A.mix(hashes ^ np.uint64(0xA0761D6478BD642F))[0])


def gram_hash(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each row of word hashes, of which the first ``sizes`` count; as ``_Words.grams`` has it."""
    out = np.zeros(len(words), np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        total = A.gram_hashes(words[at, :size].reshape(-1), size)[::size] if len(at) else np.zeros(0, np.uint64)
        out[at] = total
    return out


def _filter(phrases: DataFrame) -> np.ndarray:
    """The packed filter of the gram hashes of phrases, given by ``size`` and word columns."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in _WORDS], 1).view(np.uint64)
            hashes = gram_hash(words, batch.column("size").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    return filter_of(phrases.select("size", *_WORDS).mapInArrow(hashed, "h bigint"), "h", phrases.count()).packed


def _counted(words: _Words, size: int, at: np.ndarray, width: int, neighbours: bool) -> list[np.ndarray]:
    """Phrases of ``size`` words at the places ``at``, each once: its words (0 beyond its size, ``width`` in all) and count.

    With ``neighbours`` also the least and greatest word before it, 0 where a piece starts.
    """
    hashes = words.grams(size)[at]
    by = np.argsort(hashes)
    at, hashes = at[by], hashes[by]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    first = at[heads]
    columns = [np.full(len(heads), size, np.int64)]
    columns += [(words.hash[first + i] if i < size else np.zeros(len(first), np.uint64)).view(np.int64) for i in range(width)]
    columns.append(np.diff(np.append(heads, len(at))))
    if neighbours:
        before = np.zeros(len(words.hash), np.uint64)
        before[1:] = np.where(words.piece[1:] == words.piece[:-1], words.hash[:-1], np.uint64(0))
        before = before.view(np.int64)[at]
        columns += [np.minimum.reduceat(before, heads), np.maximum.reduceat(before, heads)]
    return columns


def _count_phrases(rows: DataFrame, places, width: int, neighbours: bool = False) -> DataFrame:
    """Counts of the phrases of up to ``width`` words that ``places(words)`` yields as ``(size, places)`` for each block."""
    keys = ["size", *_WORDS[:width]]
    names = [*keys, "a"] + (["least", "greatest"] if neighbours else [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            words = _Words(part, data, bounds)
            for size, at in places(words):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _counted(words, size, at, width, neighbours)], names=names)

    more = [F.min("least").alias("least"), F.max("greatest").alias("greatest")] if neighbours else []
    counted = rows.mapInArrow(scan, ", ".join(f"{n} bigint" for n in names)).groupBy(*keys).agg(F.sum("a").alias("a"), *more)
    return counted.select(*keys, *[F.lit(0).cast("long").alias(w) for w in _WORDS[width:]], *names[len(keys) :])


def _count_words(rows: DataFrame) -> DataFrame:
    """``lang, word, w, f`` of every word; a row with a null word holds the number of words of a language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            words = _Words(part, data, bounds)
            hashes, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
            language, totals = np.unique(words.language, return_counts=True)
            texts = [words.data[a:b].tobytes() for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    words.names.take(pa.array(np.concatenate([words.language[first], language]).astype(np.int64))),
                    pa.array(texts + [None] * len(language), pa.binary()).cast(pa.string()),
                    pa.array(np.concatenate([hashes.view(np.int64), np.zeros(len(language), np.int64)])),
                    pa.array(np.concatenate([counts, totals]).astype(np.int64)),
                ],
                names=["lang", "word", "w", "f"],
            )

    return rows.mapInArrow(scan, "lang string, word string, w bigint, f bigint").groupBy("lang", "word", "w").agg(F.sum("f").alias("f"))


_PART = ["part_size", *[f"p{i + 1}" for i in range(MOST_WORDS)]]


def _parts(phrases: DataFrame, second: bool) -> DataFrame:
    """One row for each phrase and cut: the phrase, ``k``, and the size and words of one part: the first ``k`` words or those behind."""
    words, none = F.array(*_WORDS, *[F.lit(0).cast("long")] * MOST_WORDS), F.lit(0).cast("long")
    cuts = phrases.select("size", *_WORDS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - 1)).alias("k"))
    if second:
        part = [(F.col("size") - F.col("k")), *[F.get(words, (F.col("k") + i).cast("int")) for i in range(MOST_WORDS)]]
    else:
        part = [F.col("k"), *[F.when(F.col("k") > i, F.col(w)).otherwise(none) for i, w in enumerate(_WORDS)]]
    return cuts.select("size", *_WORDS, "k", *[c.alias(name) for c, name in zip(part, _PART)])


def collocations(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    top: int = TOP,
    least_count: int = LEAST_COUNT,
    first_branches: int | None = None,
) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line breaks into pieces and at blanks and tabs into words; a null
    text is empty, a null language is ``UNKNOWN``. ``n`` is the number of words of the language. A candidate is a phrase of 2 to ``MOST_WORDS``
    words found ``a >= least_count`` times within pieces, overlaps included. Cut after its first ``k`` words, its parts are found
    ``l`` and ``r`` times and the cut scores ``floor(1000 a n / (l r))``; the lowest score counts, ties go to the smallest ``k``. A
    candidate that stands inside a longer one with the same count is dropped. Order: score and ``a`` descending, then the phrase. Scores are
    computed in decimals of 38 digits. Repeated rows count each; other columns and the values of ``key`` are ignored; an empty table, or one
    without candidates, gives no rows. Texts have any length; a text is worked on whole.
    """
    spark = documents.sparkSession
    rows = keyed_texts(documents, key, text, lang).select("text", F.coalesce(F.col("more_0").cast("string"), F.lit(UNKNOWN)).alias("more_0"))
    counted = written(_count_words(rows).filter((F.col("f") >= least_count) | F.col("word").isNull()), "frequent-words", "zstd")
    words = counted.filter("word is not null")
    totals = counted.filter("word is null").select("lang", F.col("f").alias("n"))
    word_phrases = words.select(F.lit(1).cast("long").alias("size"), F.col("w").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _WORDS[1:]], F.col("f").alias("a"))
    frequent = spark.sparkContext.broadcast(_filter(word_phrases))

    # A branch is a first word; its place in its language's order of bounds decides its batch. Words of one count share a batch.
    before = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    by_count = words.groupBy("lang", "f").agg(F.count("*").alias("branches")).withColumn("before", F.coalesce(F.sum("branches").over(before), F.lit(0)))
    size, batch = first_branches or FIRST_BRANCHES * top, F.lit(0)
    steps = 0
    while size * GROWTH**steps < (1 << 62) // GROWTH:
        batch = batch + (F.col("before") >= size * GROWTH**steps).cast("int")
        steps += 1
    branches = written(by_count.select("lang", "f", batch.alias("batch")), "branches")
    batches = [r.batch for r in branches.select("batch").distinct().orderBy("batch").collect()]  # grow by a factor, so they are few

    scored: DataFrame | None = None
    settled = None
    for number in batches:
        taken = words.join(branches.filter(F.col("batch") == number), ["lang", "f"])
        if settled is not None:
            taken = taken.join(settled, "lang", "left_anti")
        taken = written(taken.select("lang", "w"), "branches-taken")
        if taken.isEmpty():
            continue
        grown = _grow(rows, frequent, taken, least_count)
        new = written(_scored(rows, grown, word_phrases, words, totals), "scored-phrases", "zstd")
        scored = new if scored is None else scored.unionAll(new)
        settled = written(_settled(scored, branches.filter(F.col("batch") > number), totals, top), "settled-languages")
    if scored is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    return _ranked(scored, words, top)


def _grow(rows: DataFrame, frequent, taken: DataFrame, least_count: int) -> DataFrame:
    """Every phrase of two words or more that starts with a word of ``taken`` and is frequent, with its count."""
    spark = rows.sparkSession
    heads = spark.sparkContext.broadcast(_filter(taken.select(F.lit(1).cast("long").alias("size"), F.col("w").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _WORDS[1:]])))
    prefixes, found = heads, None
    for size in range(2, MOST_WORDS + 1):
        count = _count_phrases(rows, _extensions(size, prefixes, frequent), size).filter(F.col("a") >= least_count)
        # The filters may have let others through; phrases of other branches lack the counts of their prefixes here.
        count = count.join(taken.select(F.col("w").alias("w1")), "w1", "left_semi").select("size", *_WORDS, "a")
        count = written(count, f"phrases-of-{size}", "zstd")
        found = count if found is None else found.unionAll(count)
        if count.isEmpty():
            break
        prefixes = spark.sparkContext.broadcast(_filter(count))
    return written(found, "phrases-grown", "zstd")


def _extensions(size: int, prefixes, frequent):
    """Places where a prefix that the filter knows is followed by one more frequent word."""

    def places(words: _Words):
        at = words.inside(size)
        at = at[KeyFilter(frequent.value).has(A.gram_hashes(words.hash, 1)[at + size - 1])]
        yield size, at[KeyFilter(prefixes.value).has(words.grams(size - 1)[at])]

    return places


def _scored(rows: DataFrame, grown: DataFrame, word_phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one replaces, with their weakest cut."""
    seconds = _parts(grown, True)
    asked = seconds.filter("part_size > 1").select(F.col("part_size").alias("size"), *[F.col(f"p{i + 1}").alias(w) for i, w in enumerate(_WORDS)])
    asked = written(asked.unionAll(grown.filter(F.col("size") < MOST_WORDS).select("size", *_WORDS)).distinct(), "phrases-asked", "zstd")
    wanted = rows.sparkSession.sparkContext.broadcast(_filter(asked))

    def places(block: _Words):
        known = KeyFilter(wanted.value)
        for size in range(2, MOST_WORDS):
            at = block.inside(size)
            yield size, at[known.has(block.grams(size)[at])]

    looked_up = written(_count_phrases(rows, places, MOST_WORDS - 1, neighbours=True).join(asked, ["size", *_WORDS], "left_semi"), "phrases-looked-up", "zstd")

    def counts(name: str, *tables: DataFrame) -> DataFrame:
        known = reduce(DataFrame.unionAll, [t.select("size", *_WORDS, "a") for t in tables])
        return known.select(*[F.col(c).alias(p) for c, p in zip(["size", *_WORDS], _PART)], F.col("a").alias(name))

    # A longer phrase with the same count: the next word or the word before is always the same.
    longer = grown.filter("size > 2").select((F.col("size") - 1).alias("size"), *[F.when(F.col("size") > i + 1, F.col(w)).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(_WORDS)], F.col("a"))
    to_the_left = looked_up.filter("least = greatest and least <> 0").select("size", *_WORDS)
    alive = grown.join(longer, ["size", *_WORDS, "a"], "left_anti").join(to_the_left, ["size", *_WORDS], "left_anti")
    alive = written(alive, "phrases-alive", "zstd")

    phrase = ["size", *_WORDS]
    first = written(_parts(alive, False).join(counts("l", word_phrases, grown), _PART).select(*phrase, "k", "l"), "first-parts", "zstd")
    second = written(_parts(alive, True).join(counts("r", word_phrases, looked_up), _PART).select(*phrase, "k", "r"), "second-parts", "zstd")
    cuts = first.join(second, [*phrase, "k"])
    language = words.select(F.col("w").alias("w1"), "lang").join(totals, "lang")
    one = alive.join(language, "w1").join(cuts, phrase).withColumn("score", F.expr(_SCORE))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return one.groupBy(*phrase, "lang", "a", "n").agg(weakest).select(*phrase, "lang", "a", "n", "cut.l", "cut.r", "cut.score")


def _settled(scored: DataFrame, open_branches: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Languages whose last wanted score is above the bound of every branch that was not taken."""
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
    last = scored.select("lang", "score").withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= top).groupBy("lang").agg(F.min("score").alias("last"), F.count("*").alias("found"))
    bound = open_branches.groupBy("lang").agg(F.min("f").alias("f")).join(totals, "lang").select("lang", F.expr("cast(n as decimal(38,0)) * 1000 div f").alias("bound"))
    return last.filter(F.col("found") >= top).join(bound, "lang").filter("last > bound").select("lang")


def _ranked(scored: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The best phrases with their words; texts are joined only to phrases that can be among them."""
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    phrase = ["size", *_WORDS]
    best = written(scored.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place"), "best-phrases", "zstd")
    spelled = (
        best.select(*phrase, F.posexplode(F.array(*_WORDS)).alias("at", "w"))
        .filter("at < size")
        .join(words.select("w", "word"), "w")
        .groupBy(*phrase)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelled, phrase).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
