"""Cutting documents into sentence-aware, token-bounded, overlapping chunks.

Everything happens inside one row: a document's pieces live in an array, the packing is a fold over their
token counts, and chunks leave through a single ``posexplode``. There is no shuffle, so a corpus of any size
is chunked in the tasks that scan it, and no document is ever gathered from several rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.binding import bind
from textloom.functions.text import strip_blank, token_count

# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "dr.", "vs.", "mr.", "ms.", "mx.", "mrs.", "prof.", "inc.", "corp.", "co.", "llc.", "ltd.", "etc.",
    "i.e.", "A.S.A.P.",
)

# The separators and patterns of the five levels. Every pattern is lossless (matches re-join
# to the input) and free of repeated groups, which overflow the regex stack on long text.
PARAGRAPH_SEPARATOR = "\n\n\n"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*"
CLAUSE_PATTERN = r"[^,.;。？！]+[,.;。？！]*|[,.;。？！]+"
WORD_PATTERN = r"\s*\S+\s*\z|\s*\S+|\s+"
CHARACTER_PATTERN = r"(?s)."

# The mark and what follows stand for a dot that must not end a sentence, or for a mark of the text's own. All three are Unicode
# noncharacters, which neither split nor belong to words.
_MARK, _DOT, _OWN = "\ufdd0", "\ufdd1", "\ufdd2"

# Characters for each token of a chunk in the start of a text that is counted first.
_PREFIX_CHARACTERS = 8

# Pieces folded at a time.
_BLOCK_PIECES = 1024

_BOUNDS = "array<struct<first:int,stop:int>>"


# ---- splitting -------------------------------------------------------------------------------------------


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def paragraphs(text: Column, separator: str = PARAGRAPH_SEPARATOR) -> Column:
    """Text parts between separators, each later part keeping the separator in front."""
    parts = F.split(text, re.escape(separator) if separator.strip() else separator)
    led = F.transform(parts, lambda part, i: F.when(i > 0, F.concat(F.lit(separator), part)).otherwise(part))
    return F.filter(led, lambda part: part != "")


def quiet_dot_pattern(abbreviations: Sequence[str] = ABBREVIATIONS) -> str:
    """Matches each dot that ends no sentence: inside a decimal, or in or after an abbreviation.

    One pass: the match is a dot, found first, and only then looked around. Abbreviations stand alone (no letter
    or digit before them) and their case does not matter.
    """
    alone = r"(?:^|[^\p{L}\p{N}])"
    around = [r"(?<=[0-9]\.)(?=[0-9])"]
    simple = []
    for abbreviation in dict.fromkeys(a.lower() for a in abbreviations if a.strip(".")):
        parts = abbreviation.split(".")
        for i in range(1, len(parts)):
            before, after = (r"\.".join(map(re.escape, half)) for half in (parts[:i], parts[i:]))
            if after:
                around.append(f"(?<={alone}(?i:{before})\\.)(?=(?i:{after}))")
            else:
                simple.append(before)
    if simple:
        around.append(f"(?<={alone}(?i:{'|'.join(simple)})\\.)")
    return f"\\.(?:{'|'.join(around)})"


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Sentences with their trailing whitespace, not split after the given abbreviations or inside decimals."""
    # A mark that the text itself holds is written as two, so that it comes back as it was.
    mark, own, dot = F.lit(_MARK), F.lit(_MARK + _OWN), F.lit(_MARK + _DOT)
    quiet = F.regexp_replace(F.replace(text, mark, own), quiet_dot_pattern(abbreviations), _MARK + _DOT)
    return F.transform(
        _matches(SENTENCE_PATTERN)(quiet), lambda s: F.replace(F.replace(s, dot, F.lit(".")), own, mark)
    )


def _levels(abbreviations: Sequence[str]) -> list[Callable[[Column], Column]]:
    return [
        paragraphs,
        lambda text: sentences(text, abbreviations),
        _matches(CLAUSE_PATTERN),
        _matches(WORD_PATTERN),
        _matches(CHARACTER_PATTERN),
    ]


def pieces(
    text: Column,
    chunk_size: int,
    abbreviations: Sequence[str] = ABBREVIATIONS,
    count: Callable[[Column], Column] = token_count,
) -> Column:
    """``array<struct<text, n_tokens>>``: the text cut by ever finer levels until each piece fits ``chunk_size``.

    A level only touches pieces that are still too long. ``count`` is any native token-count expression.
    """

    def size(part: Column) -> Column:
        if count is not token_count:
            return count(part)
        # The start of a text has no more tokens than the text: most long ones are known as too long by it, and are cut further anyway.
        start = _PREFIX_CHARACTERS * chunk_size
        too_long = (F.length(part) > start) & (count(F.substring(part, 1, start)) > chunk_size)
        return F.when(too_long, chunk_size + 1).otherwise(count(part))

    def measured(part: Column) -> Column:
        return F.struct(part.alias("text"), size(part).alias("n_tokens"))

    def refine(level: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda piece: F.when(
            piece["n_tokens"] > chunk_size, F.transform(level(piece["text"]), measured)
        ).otherwise(F.array(piece))

    return reduce(
        lambda found, level: F.flatten(F.transform(found, refine(level))),
        _levels(abbreviations),
        F.array(measured(text)),
    )


# ---- packing ---------------------------------------------------------------------------------------------


def chunk_bounds(lengths: Column, chunk_size: int, chunk_overlap: int) -> Column:
    """Greedy packing as ``array<struct<first, stop>>`` over an array of piece lengths.

    A chunk is closed when the next piece would exceed ``chunk_size``; the new one starts with the longest
    tail of the closed chunk that has at most ``chunk_overlap`` tokens, and always takes the next piece. So a
    chunk holds at most ``chunk_size + chunk_overlap`` tokens.

    The fold runs over blocks of pieces, and within each block over its pieces: every step copies its state, so
    the list of chunks inside it must stay short for the time to stay linear on very long documents.
    """

    def state(first: Column, held: Column, done: Column) -> Column:
        return F.struct(first.alias("first"), held.alias("held"), done.alias("done"))

    def close(s: Column, stop: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), stop.alias("stop"))))

    def tail(s: Column, stop: Column) -> Column:
        """How many pieces to carry over, and their tokens."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(True).alias("open"))
        return F.aggregate(
            F.sequence(stop - 1, s["first"], F.lit(-1)),
            start,
            lambda t, i: F.when(
                t["open"] & (t["tokens"] + F.get(lengths, i) <= chunk_overlap),
                F.struct(
                    (t["n"] + 1).alias("n"),
                    (t["tokens"] + F.get(lengths, i)).alias("tokens"),
                    F.lit(True).alias("open"),
                ),
            ).otherwise(F.struct(t["n"].alias("n"), t["tokens"].alias("tokens"), F.lit(False).alias("open"))),
        )

    def step(s: Column, i: Column) -> Column:
        held = s["held"] + F.get(lengths, i)
        reopened = bind(
            tail(s, i), lambda t: state(i - t["n"], t["tokens"] + F.get(lengths, i), close(s, i))
        )
        return F.when((held > chunk_size) & (i > 0), reopened).otherwise(state(s["first"], held, s["done"]))

    def block(s: Column, start: Column) -> Column:
        inside = F.sequence(start, F.least(start + _BLOCK_PIECES, F.size(lengths)) - 1)
        return bind(
            F.aggregate(inside, state(s["first"], s["held"], none), step),
            lambda b: state(b["first"], b["held"], F.concat(s["done"], b["done"])),
        )

    none = F.array().cast(_BOUNDS)
    n = F.size(lengths)
    starts = F.sequence(F.lit(0), n - 1, F.lit(_BLOCK_PIECES))
    folded = F.aggregate(starts, state(F.lit(0), F.lit(0), none), block, lambda s: close(s, n))
    return F.when(n > 0, folded).otherwise(none)


def _members(found: Column, bound: Column) -> Column:
    """The pieces of one chunk, taken by position: ``slice`` walks the array from its start each time."""
    return F.transform(F.sequence(bound["first"], bound["stop"] - 1), lambda i: F.get(found, i))


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda piece: piece["text"]), "")


def _map_bounds(found: Column, chunk_size: int, chunk_overlap: int, chunk: Callable[[Column, Column], Column]) -> Column:
    """``chunk(pieces, bound)`` for every chunk of an array of pieces, which is evaluated once."""

    def pack(all_pieces: Column) -> Column:
        return bind(
            F.transform(all_pieces, lambda piece: piece["n_tokens"]),
            lambda lengths: F.transform(
                chunk_bounds(lengths, chunk_size, chunk_overlap), lambda bound: chunk(all_pieces, bound)
            ),
        )

    return bind(found, pack)


def packed(found: Column, chunk_size: int, chunk_overlap: int) -> Column:
    """Chunks ``array<struct<text, n_pieces, n_packed>>`` from an array of pieces; text untrimmed."""

    def describe(members: Column) -> Column:
        return F.struct(
            _joined(members).alias("text"),
            F.size(members).alias("n_pieces"),
            F.aggregate(members, F.lit(0), lambda total, piece: total + piece["n_tokens"]).alias("n_packed"),
        )

    return _map_bounds(found, chunk_size, chunk_overlap, lambda ps, bound: bind(_members(ps, bound), describe))


def chunk_texts(
    text: Column,
    chunk_size: int,
    chunk_overlap: int,
    abbreviations: Sequence[str] = ABBREVIATIONS,
    count: Callable[[Column], Column] = token_count,
) -> Column:
    """Trimmed, non-blank chunk texts of a document as ``array<string>``."""

    found = pieces(text, chunk_size, abbreviations, count)
    raw = _map_bounds(found, chunk_size, chunk_overlap, lambda ps, bound: _joined(_members(ps, bound)))
    return F.filter(F.transform(raw, strip_blank), lambda chunk: chunk != "")


# ---- table operators -------------------------------------------------------------------------------------


def drop_empty(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep documents with non-null, non-empty text (blank-only text passes)."""
    return df.filter(F.length(text_col) > 0)


def split_sentences(df: DataFrame, text_col: str = "text", abbreviations: Sequence[str] = ABBREVIATIONS) -> DataFrame:
    """One row per sentence: ``text_col`` replaced by the sentence, ``pos`` added."""
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(sentences(F.col(text_col), abbreviations)).alias("pos", text_col))


def split_pieces(
    df: DataFrame, chunk_size: int, text_col: str = "text", abbreviations: Sequence[str] = ABBREVIATIONS
) -> DataFrame:
    """Documents with ``text_col`` replaced by their ``pieces`` array."""
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, pieces(F.col(text_col), chunk_size, abbreviations).alias("pieces"))


def piece_rows(
    df: DataFrame, chunk_size: int, text_col: str = "text", abbreviations: Sequence[str] = ABBREVIATIONS
) -> DataFrame:
    """One row per piece: ``text_col`` replaced by the piece, ``pos`` and ``n_tokens`` added."""
    # The generator takes the expression itself: given a column, the optimizer adds a filter on the array's
    # size and pushes it below, which would split the text twice.
    kept = [c for c in df.columns if c != text_col]
    found = pieces(F.col(text_col), chunk_size, abbreviations)
    rows = df.select(*kept, F.posexplode(found).alias("pos", "piece"))
    return rows.select(*kept, "pos", F.col("piece.text").alias(text_col), "piece.n_tokens")


def pack_chunks(df: DataFrame, chunk_size: int, chunk_overlap: int) -> DataFrame:
    """One row per packed chunk of a ``pieces`` array: ``chunk_ix, text, n_pieces, n_packed``, untrimmed."""
    kept = [c for c in df.columns if c != "pieces"]
    chunks = packed(F.col("pieces"), chunk_size, chunk_overlap)
    return df.select(*kept, F.posexplode(chunks).alias("chunk_ix", "chunk")).select(*kept, "chunk_ix", "chunk.*")


def clean_chunks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim chunk texts and drop blank ones."""
    return df.withColumn(text_col, strip_blank(F.col(text_col))).filter(F.col(text_col) != "")


def chunk_documents(
    df: DataFrame,
    chunk_size: int = 1024,
    chunk_overlap: int = 20,
    abbreviations: Sequence[str] = ABBREVIATIONS,
    count: Callable[[Column], Column] = token_count,
    text_col: str = "text",
) -> DataFrame:
    """Documents to chunks: the other columns kept, plus ``chunk_ix``, ``text``, ``n_tokens``, ``is_expanded``.

    Metadata never counts towards the size. Empty documents are dropped first.
    """
    check_sizes(chunk_size, chunk_overlap)
    kept = [c for c in df.columns if c != text_col]
    texts = chunk_texts(F.col(text_col), chunk_size, chunk_overlap, abbreviations, count)
    chunks = drop_empty(df, text_col).select(*kept, F.posexplode(texts).alias("chunk_ix", "text"))
    return chunks.select("*", count(F.col("text")).alias("n_tokens"), F.lit(False).alias("is_expanded"))


def check_sizes(chunk_size: int, chunk_overlap: int) -> None:
    if chunk_size <= 0:
        raise ValueError(f"chunk_size must be positive, got {chunk_size}")
    if not 0 <= chunk_overlap <= chunk_size:
        raise ValueError(f"chunk_overlap must lie between 0 and chunk_size ({chunk_size}), got {chunk_overlap}")


def run_transforms(df: DataFrame, transforms: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply table transforms in order."""
    return reduce(DataFrame.transform, transforms, df)
