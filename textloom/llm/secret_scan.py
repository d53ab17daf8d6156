"""Op 2: secrets found by fixed patterns and by a linear-chain conditional random field over tokens.

Tokens are tagged secret begin (B), inside (I) or outside (O). A token's score for being secret comes from its shape, the words and
separators beside it and features of its whole text; transitions tell B from I. Viterbi decodes each text. The field learns from a
bounded sample: texts with a pattern match, and variations of the sample's texts that hold made-up secrets of other alphabets, lengths and
settings, or harmless tokens that look odd. Neighbours are masked at random, so that shape has to count. It adds spans that no pattern covers.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from string import ascii_letters, ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, quoted
from textloom.session import ship_package

# The base patterns, their kinds in order, and the least length of what they must hold.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEARNED = "learned"

# Training takes about so many texts with and without a pattern match, chosen by a hash of their key, and so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARACTERS = 400, 800
# Variations of each sample text, and the share of tokens whose neighbouring words are masked.
VARIATIONS, MASKED = 1, 0.5
STEPS, RATE, PENALTY = 80, 0.15, 1e-3
# Tokens' scores are lowered by this much before decoding; below zero favours finding over leaving.
MARGIN = -2.0

_NEIGHBOURS = 1 << 11
_TOKEN = np.zeros(256, bool)
for _low, _high in ("09", "az", "AZ"):
    _TOKEN[ord(_low) : ord(_high) + 1] = True
_TOKEN[[ord(c) for c in "+/_-"]] = True
_TOKEN[0x80:] = True
_KIND = np.zeros(256, np.uint8)  # 1 digit, 2 lower, 3 upper, 4 mark, 5 beyond ASCII
_KIND[ord("0") : ord("9") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1] = 1, 2, 3
_KIND[[ord(c) for c in "+/_-"]] = 4
_KIND[0x80:] = 5
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_LENGTHS = np.array([4, 6, 9, 13, 17, 21, 25, 41])

# Number of values of each feature, and where its weights begin.
_WIDTHS = [9, 5, 5, 4, 6, 3, 6, 6, 4, 4, _NEIGHBOURS, _NEIGHBOURS]
_BASES = np.concatenate([[0], np.cumsum(_WIDTHS)])


def base_matches(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches ``(start, end, kind)`` in code points, ordered by start, then kind."""
    found: list[tuple[int, int, str]] = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- features


def _quarter(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 none, 1 to 3 thirds, 4 all."""
    return np.where(part == 0, 0, np.where(part == whole, 4, 1 + np.minimum(3 * part // np.maximum(whole, 1), 2)))


def token_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block: start, end, row, and the weight index of each of their features (features x tokens).

    Features: length, share of digits, share of capitals, marks, changes between kinds of characters, hexadecimal, separator before,
    separator behind, digits of the text, marks of the text, word before, word behind.
    """
    start, end, row = A.spans(_TOKEN[data], bounds)
    count = len(start)
    kinds = _KIND[data]

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[end] - sums[start]

    length = end - start
    digits, capitals, marks = inside(kinds == 1), inside(kinds == 3), inside(kinds == 4)
    turns = np.zeros(len(data), bool)
    turns[1:] = kinds[1:] != kinds[:-1]
    changes = inside(turns) - (turns[start] if count else 0)
    hexadecimal = inside(_HEXADECIMAL[data]) == length
    # The byte next to a token tells how it is set off: blank, quote, equals, colon, other, edge of the text.
    code = np.full(256, 4, np.uint8)
    code[[0x20, 0x0A, 0x09, 0x0D]] = 0
    code[[0x22, 0x27, 0x60]] = 1
    code[ord("=")], code[ord(":")] = 2, 3
    before = np.where(start > bounds[row], code[data[np.maximum(start - 1, 0)]], 5) if count else np.zeros(0, np.int64)
    behind = np.where(end < bounds[row + 1], code[data[np.minimum(end, len(data) - 1)]], 5) if count else np.zeros(0, np.int64)
    size = np.maximum(np.diff(bounds), 1)
    share = np.stack([100 * (np.add.reduceat(np.append(flags, 0).astype(np.int64), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)) for flags in (kinds == 1, kinds == 4)])
    share[:, np.diff(bounds) == 0] = 0
    density = np.searchsorted([1, 5, 20], share / size, "right")
    words = A.span_hashes(A.prefix_hashes(A.LOWER[data]), start, end) & np.uint64(_NEIGHBOURS - 1)
    words = words.astype(np.int64)
    left, right = np.zeros(count, np.int64), np.zeros(count, np.int64)
    left[1:] = np.where(row[1:] == row[:-1], words[:-1], 0)
    right[:-1] = np.where(row[1:] == row[:-1], words[1:], 0)
    values = [
        np.searchsorted(_LENGTHS, length, "right"),
        _quarter(digits, length),
        _quarter(capitals, length),
        np.minimum(marks, 3),
        np.minimum(changes, 10) // 2,
        np.where(hexadecimal, np.where(length >= 12, 2, 1), 0),
        before,
        behind,
        density[0][row],
        density[1][row],
        left,
        right,
    ]
    return start, end, row, np.stack(values).astype(np.int32) + _BASES[:-1, None].astype(np.int32)


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """``weights``: score of B and I over O by feature value; ``steps``: transition scores, O B I by O B I (never O to I)."""

    weights: np.ndarray
    steps: np.ndarray

    def outside_lead(self) -> float:
        """What a single token can gain by its transitions at most, if it is not O."""
        allowed = self.steps[self.steps > -1e8]
        return 3.0 * float(allowed.max() - allowed.min())


O, B, I = 0, 1, 2


def _new_field() -> Field:
    steps = np.zeros((3, 3))
    steps[O, I] = -1e9
    return Field(np.zeros(int(_BASES[-1])), steps)


def _chains(sequences: list[np.ndarray], tags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side: feature indices (time, features, lanes), tags, and which places are filled."""
    steps = max(s.shape[1] for s in sequences)
    index = np.zeros((steps, len(_WIDTHS), len(sequences)), np.int32)
    tag = np.zeros((steps, len(sequences)), np.int64)
    filled = np.zeros((steps, len(sequences)), bool)
    for lane, (features, own) in enumerate(zip(sequences, tags)):
        index[: features.shape[1], :, lane] = features.T
        tag[: len(own), lane] = own
        filled[: len(own), lane] = True
    return index, tag, filled


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train_field(sequences: list[np.ndarray], tags: list[np.ndarray], steps: int = STEPS) -> Field:
    """Maximum conditional likelihood by Adam, with gradients from the forward-backward recursion over all sequences at once."""
    field = _new_field()
    pairs = [(s, t) for s, t in zip(sequences, tags) if s.shape[1]]
    if not any((t != O).any() for _, t in pairs):
        return field
    index, tag, filled = _chains([s for s, _ in pairs], [t for _, t in pairs])
    length, lanes = tag.shape
    moments = [[np.zeros_like(field.weights)] * 2, [np.zeros_like(field.steps)] * 2]
    allowed = field.steps > -1e8
    for step in range(1, steps + 1):
        score = field.weights[index].sum(axis=1)
        emit = np.stack([np.zeros_like(score), score, score], axis=2)
        emit[~filled] = 0
        forward = np.empty((length, lanes, 3))
        forward[0] = emit[0] + field.steps[O]
        for t in range(1, length):
            forward[t] = np.where(filled[t][:, None], _log_sum(forward[t - 1][:, :, None] + field.steps, 1) + emit[t], forward[t - 1])
        whole = _log_sum(forward[-1], 1)
        backward = np.zeros((length, lanes, 3))
        used = np.zeros((3, 3))
        for t in range(length - 1, 0, -1):
            inner = field.steps + (emit[t] + backward[t])[:, None, :]
            both = np.exp(forward[t - 1][:, :, None] + inner - whole[:, None, None]) * filled[t][:, None, None]
            used += both.sum(axis=0)
            backward[t - 1] = np.where(filled[t][:, None], _log_sum(inner, 2), backward[t])
        share = np.exp(forward + backward - whole[None, :, None]) * filled[:, :, None]
        used[O] += share[0].sum(axis=0)
        previous = np.concatenate([np.zeros((1, lanes), np.int64), tag[:-1]])
        seen = np.zeros((3, 3))
        np.add.at(seen, (previous[filled], tag[filled]), 1)
        wrong = share[:, :, 1:].sum(axis=2) - (tag != O) * filled
        gradient = np.zeros_like(field.weights)
        for f in range(index.shape[1]):
            gradient += np.bincount(index[:, f].ravel(), weights=wrong.ravel(), minlength=len(gradient))
        for which, (value, slope) in enumerate(((field.weights, gradient / lanes + PENALTY * field.weights), (field.steps, (used - seen) / lanes * allowed + PENALTY * field.steps * allowed))):
            m, v = moments[which]
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            moments[which] = [m, v]
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        # Small transitions keep the bound of outside_lead() small.
        np.clip(field.steps, -2.0, 2.0, out=field.steps)
        field.steps[~allowed] = -1e9
    return field


def viterbi(score: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best tags of one chain; ``score``: B and I over O, of each token. Ties go to O, then B."""
    best = [0.0, -1e18, -1e18]
    back = []
    for own in score.tolist():
        came, now = [], []
        for to in (O, B, I):
            options = [best[a] + steps[a, to] for a in (O, B, I)]
            choice = options.index(max(options))
            came.append(choice)
            now.append(options[choice] + (own if to else 0.0))
        best = now
        back.append(came)
    tag = best.index(max(best))
    tags = np.zeros(len(back), np.int64)
    for t in range(len(back) - 1, -1, -1):
        tags[t] = tag
        tag = back[t][tag]
    return tags


def decode(field: Field, score: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Best tags of all chains of a block (tokens with one row are a chain).

    A token that trails "outside" by more than transitions can ever win back is O on the best path, whatever its neighbours; so the
    chains fall apart there and only the stretches between are decoded. That is exact.
    """
    tags = np.zeros(len(score), np.int64)
    open_ = score >= -field.outside_lead()
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    splits = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) != 0)) + 1
    for part in np.split(at, splits):
        # One forced O behind the stretch lets the last open token pay for its way back to O.
        closed = part[-1] + 1 < len(row) and row[part[-1] + 1] == row[part[-1]]
        own = np.append(score[part], -1e12) if closed else score[part]
        tags[part] = viterbi(own, field.steps)[: len(part)]
    return tags


# ---------------------------------------------------------------- Spark


def _tagged(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of one training text; the value of a pattern match is secret, its keyword is not."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _, features = token_features(data, np.array([0, len(data)]))
    tags = np.zeros(len(start), np.int64)
    for low, high, kind in base_matches(text):
        if kind == "assign":
            low = ASSIGN.match(text, low).start(2)
        first, last = len(text[:low].encode()), len(text[:high].encode())
        inside = np.flatnonzero((start < last) & (end > first))
        tags[inside] = I
        tags[inside[:1]] = B
    return features, tags


# Made-up secrets are drawn from these alphabets and stand in these settings; harmless tokens stand for what only looks odd.
_ALPHABETS = [digits + letters for digits in ("0123456789",) for letters in ("abcdef", "ABCDEF", ascii_lowercase, ascii_uppercase, ascii_letters, ascii_letters + "+/", ascii_letters + "-_")]
_SETTINGS = [" {w} {v} ", ' {w}="{v}" ', " {w}: {v}\n", " {w} = {v}; ", ' "{v}" ', " ({v}) ", " {v} ", " {w}={v}&{w} ", " {w}/{w}:{v}, "]
_HARMLESS = [
    lambda draw, word: "".join(draw.choice("0123456789") for _ in range(draw.randint(1, 20))),
    lambda draw, word: "-".join(str(draw.randint(1, 9999)) for _ in range(draw.randint(2, 4))),
    lambda draw, word: word() + "-" + word(),
    lambda draw, word: word() + word().capitalize() + word().capitalize(),
    lambda draw, word: (word() + "_" + word() + "_" + word()).upper(),
    lambda draw, word: word() + str(draw.randint(0, 9999)),
    lambda draw, word: f"https://{word()}.{word()}/{word()}/{word()}-{draw.randint(1, 99999)}?{word()}={word()}",
    lambda draw, word: f"{word()}.{word()}{draw.randint(1, 99)}@{word()}.{word()}",
    lambda draw, word: "".join(word() for _ in range(draw.randint(2, 5))),
    lambda draw, word: f"v{draw.randint(0, 9)}.{draw.randint(0, 20)}-{word()}{draw.randint(1, 9)}",
    lambda draw, word: word().upper() * draw.randint(1, 3),
]


def _varied(piece: str, draw: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a piece with its pattern matches cut out and some made-up secrets and harmless tokens put in."""
    parts, at = [], 0
    for low, high, _ in base_matches(piece):
        parts.append(piece[at : max(low, at)])
        at = max(high, at)
    words = ("".join([*parts, piece[at:]])).split() or ["word"]
    word = lambda: draw.choice(words)
    text, marked = "", []
    put = {draw.randrange(len(words) + 1): kind for kind in ["secret"] * draw.randint(0, 2) + ["harmless"] * draw.randint(1, 4)}
    for i, own in enumerate([*words, ""]):
        if i in put:
            secret = put[i] == "secret"
            alphabet = draw.choice(_ALPHABETS)
            value = "".join(draw.choice(alphabet) for _ in range(draw.randint(14, 48))) if secret else draw.choice(_HARMLESS)(draw, word)
            before, behind = draw.choice(_SETTINGS).replace("{w}", word()).split("{v}")
            text += before
            if secret:
                marked.append((len(text.encode()), len((text + value).encode())))
            text += value + behind
        text += own + draw.choice([" ", " ", " ", " ", "\n"])
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _, features = token_features(data, np.array([0, len(data)]))
    tags = np.zeros(len(start), np.int64)
    for low, high in marked:
        inside = np.flatnonzero((start < high) & (end > low))
        tags[inside] = I
        tags[inside[:1]] = B
    return features, tags


def _masked(features: np.ndarray, draw: random.Random) -> np.ndarray:
    """Features with the neighbouring words of some tokens taken away."""
    features = features.copy()
    for line in (-2, -1):
        gone = np.array([draw.random() < MASKED for _ in range(features.shape[1])], bool)
        features[line, gone] = _BASES[line - 1]
    return features


def learn_field(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """Train on about ``SAMPLE_TEXTS`` texts with and as many without a pattern match, a piece around the first match of each, and on
    ``VARIATIONS`` of every piece."""
    pattern = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"
    rows = documents.filter(F.length(quoted(text)) > 0).select(quoted(text).alias("text"), F.xxhash64(quoted(key), quoted(text), F.lit(2)).alias("draw"))
    hit = F.regexp_instr("text", F.lit(pattern)) > 0
    hits, misses = rows.agg(F.count_if(hit), F.count_if(~hit)).first()
    # A draw below the wanted share of its kind is in the sample: the driver gets about SAMPLE_TEXTS of each, however many tasks there are.
    span = 1 << 40
    shares = [min(span, span * SAMPLE_TEXTS // max(n, 1)) for n in (hits, misses)]
    drawn = rows.withColumn("draw", F.pmod("draw", F.lit(span))).filter(F.col("draw") < max(shares))
    found = drawn.withColumn("at", F.regexp_instr("text", F.lit(pattern)))
    chosen = found.filter(F.col("draw") < F.when(F.col("at") > 0, F.lit(shares[0])).otherwise(F.lit(shares[1])))
    start = F.greatest(F.col("at") - SAMPLE_CHARACTERS // 2, F.lit(1))
    piece = F.substring(F.col("text"), start, F.lit(SAMPLE_CHARACTERS))
    picked = [r.piece for r in chosen.select("draw", piece.alias("piece")).orderBy("draw", "piece").limit(4 * SAMPLE_TEXTS).collect()]
    draw = random.Random(0)
    examples = [_tagged(p) for p in picked] + [_varied(p, draw) for p in picked for _ in range(VARIATIONS)]
    return train_field([_masked(f, draw) for f, _ in examples], [t for _, t in examples])


def _all_spans(field: Field, margin: float, data: np.ndarray, bounds: np.ndarray, texts: list[str]) -> Iterator[tuple[list, list]]:
    """Of each text of a block, its pattern matches, and these together with the spans that the field adds."""
    start, end, row, features = token_features(data, bounds)
    score = field.weights[features[0]].copy()
    for line in features[1:]:
        score += field.weights[line]
    tags = decode(field, score - margin, row)
    added: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(tags == B).tolist():
        last = i
        while last + 1 < len(tags) and tags[last + 1] == I and row[last + 1] == row[i]:
            last += 1
        added.setdefault(int(row[i]), []).append((int(start[i]), int(end[last])))
    order = [*KINDS, LEARNED]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if added else None
    for number, content in enumerate(texts):
        base = base_matches(content)
        spans = list(base)
        starts, ends = [a for a, _, _ in base], [0, *accumulate((b for _, b, _ in base), max)]
        for low, high in added.get(number, ()):
            low, high = (int(chars[x] - chars[bounds[number]]) for x in (low, high))
            if ends[bisect_left(starts, high)] <= low:
                spans.append((low, high, LEARNED))
        spans.sort(key=lambda s: (s[0], order.index(s[2])))
        yield base, spans


def find_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None, margin: float = MARGIN) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive. Pattern matches are always there; spans that the field adds are of
    kind ``learned`` and overlap none of them. Null texts are empty; an empty text has no span. Repeated and null keys keep their rows.
    Nothing is shuffled.
    """
    rows = keyed_texts(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(field or learn_field(documents, key, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches):
            out = []
            for base, spans in _all_spans(shared.value, margin, data, bounds, part.column("text").to_pylist()):
                listed, everything = (",".join(f"{k}:{a}:{b}" for a, b, k in some) for some in (base, spans))
                out.append((*[sum(k == kind for _, _, k in base) for kind in KINDS], hashlib.sha256(listed.encode()).hexdigest(), everything))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            names = ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=names)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("key", key)


def without_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", field: Field | None = None, margin: float = MARGIN) -> DataFrame:
    """All rows of ``documents`` with every secret replaced by ``<secret>``, other columns unchanged; a null text stays null.

    If there is an integer ``length`` column, it becomes the number of characters where the text changed. The rows stay where they are.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(field or learn_field(documents, key, text))
    names = documents.columns
    at, count = names.index(text), names.index(length) if length in names else None
    # Positions as names, so that odd column names do not matter inside.
    plain = documents.select([quoted(c).alias(f"c{i}") for i, c in enumerate(names)])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in A.blocks(batches, text=f"c{at}"):
            texts = part.column(at).to_pylist()
            filled = [t or "" for t in texts]
            clean = [None if t is None else _redacted(t, spans) for t, (_, spans) in zip(texts, _all_spans(shared.value, margin, data, bounds, filled))]
            columns = list(part.columns)
            columns[at] = pa.array(clean, part.column(at).type)
            if count is not None and pa.types.is_integer(columns[count].type):
                lengths = [n if new == old else len(new) for n, old, new in zip(columns[count].to_pylist(), texts, clean)]
                columns[count] = pa.array(lengths, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return plain.mapInArrow(redact, plain.schema).toDF(*names)


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for low, high, _ in spans:
        if high > at:
            parts += [text[at:low], "<secret>"] if low >= at else []
            at = high
    return "".join([*parts, text[at:]]) if spans else text
