"""Op 4: language identification by a bidirectional gated recurrent network over bytes.

Every text is cut into windows of ``SPAN`` bytes. Two recurrent nets read a window, one from each side; their states at a byte give
that byte's language probabilities, and a document's are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, quoted

SPAN = 128
HIDDEN = 8
UNKNOWN = "und"

# Training: about so many documents (all languages together, the same number of each), so many characters of each, and so
# many steps over batches of windows of TRAIN_SPAN bytes.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 2400, 1500
STEPS, BATCH, TRAIN_SPAN, RATE = 200, 192, 48, 0.02

_PAD = 256
_LANES = 2048  # windows that are read side by side


@dataclass
class ByteGru:
    """Weights of both directions: byte tables (3 gates x hidden, 257), recurrent weights, and the output layer."""

    langs: list[str]
    inputs: list[np.ndarray]
    gates: list[np.ndarray]
    candidates: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidates, self.out, self.bias]


def new_model(langs: list[str], seed: int = 5) -> ByteGru:
    draw = np.random.default_rng(seed)
    h = HIDDEN

    def weights(*shape: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    inputs = [weights(3 * h, 257, scale=0.3) for _ in range(2)]
    for table in inputs:
        table[:, _PAD] = 0
    return ByteGru(langs, inputs, [weights(2 * h, h, scale=0.3) for _ in range(2)], [weights(h, h, scale=0.3) for _ in range(2)], weights(len(langs), 2 * h, scale=0.3), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _read(model: ByteGru, side: int, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, lanes) of one direction over byte codes (time, lanes); ``keep`` receives what the way back needs.

    Padding leaves a lane's state as it is, which is zero before the reverse net meets the text.
    """
    table, gates, candidate = model.inputs[side], model.gates[side], model.candidates[side]
    steps, lanes = codes.shape
    states = np.empty((steps, HIDDEN, lanes), np.float32)
    state = np.zeros((HIDDEN, lanes), np.float32)
    ragged = bool((codes[-1] == _PAD).any())
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        given = table.take(codes[t], axis=1)
        both = _sigmoid(gates @ state + given[: 2 * HIDDEN])
        update, reset = both[:HIDDEN], both[HIDDEN:]
        gated = reset * state
        fresh = np.tanh(candidate @ gated + given[2 * HIDDEN :])
        if ragged:
            update = update * (codes[t] != _PAD)
        before, state = state, state + update * (fresh - state)
        states[t] = state
        if keep is not None:
            keep.append((t, before, update, reset, gated, fresh))
    return states


def byte_log_probabilities(model: ByteGru, codes: np.ndarray) -> np.ndarray:
    """Log probabilities (time, language, lanes) of every byte."""
    states = np.concatenate([_read(model, 0, codes), _read(model, 1, codes)], axis=1)
    scores = np.matmul(model.out, states) + model.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def gradients(model: ByteGru, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes (``target``: language of each lane) and its gradients, by backpropagation through time."""
    keeps: list[list] = [[], []]
    states = np.concatenate([_read(model, side, codes, keeps[side]) for side in (0, 1)], axis=1)
    scores = np.matmul(model.out, states) + model.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    shares = np.exp(scores)
    shares /= shares.sum(axis=1, keepdims=True)
    real = (codes != _PAD).astype(np.float32)
    total = max(real.sum(), 1.0)
    lanes = np.arange(codes.shape[1])
    loss = float(-(np.log(np.maximum(shares[:, target, lanes], 1e-12)) * real).sum() / total)
    delta = shares
    delta[:, target, lanes] -= 1
    delta *= real[:, None, :] / total
    d_out = np.einsum("tlb,thb->lh", delta, states, optimize=True)
    d_states = np.matmul(model.out.T, delta)
    d_inputs, d_gates, d_candidates = [], [], []
    for side in (0, 1):
        gates, candidate = model.gates[side], model.candidates[side]
        d_table, d_gate, d_candidate = np.zeros_like(model.inputs[side]), np.zeros_like(gates), np.zeros_like(candidate)
        back = np.zeros((HIDDEN, codes.shape[1]), np.float32)
        for t, before, update, reset, gated, fresh in reversed(keeps[side]):
            back = back + d_states[t, side * HIDDEN : (side + 1) * HIDDEN]
            d_fresh = back * update * (1 - fresh * fresh)
            d_gated = candidate.T @ d_fresh
            d_update = back * (fresh - before) * update * (1 - update)
            d_reset = d_gated * before * reset * (1 - reset)
            both = np.concatenate([d_update, d_reset])
            back = back * (1 - update) + d_gated * reset + gates.T @ both
            d_gate += both @ before.T
            d_candidate += d_fresh @ gated.T
            given = np.concatenate([both, d_fresh])
            for row in range(3 * HIDDEN):
                d_table[row] += np.bincount(codes[t], weights=given[row], minlength=257)
        d_table[:, _PAD] = 0
        d_inputs.append(d_table)
        d_gates.append(d_gate)
        d_candidates.append(d_candidate)
    return loss, [*d_inputs, *d_gates, *d_candidates, d_out, delta.sum(axis=(0, 2))]


def _lanes(texts: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts as columns of codes (time, window), and the text of each."""
    sizes = np.array([-(-len(t) // span) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = np.full((int(sizes.sum()), span), _PAD, np.int16)
    first = 0
    for text, size in zip(texts, sizes):
        codes[first : first + size].reshape(-1)[: len(text)] = text
        first += size
    return np.ascontiguousarray(codes.T), owner


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> ByteGru:
    """Fit by Adam on random windows, drawn evenly over languages. Fixed seeds: the same sample gives the same model."""
    langs = sorted(set(labels))
    model = new_model(langs)
    draw = np.random.default_rng(seed)
    by_lang = [[np.frombuffer(t, np.uint8) for t, label in zip(texts, labels) if label == lang and t] for lang in langs]
    if len(langs) < 2 or not all(by_lang):
        return model
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    for step in range(1, steps + 1):
        target = np.arange(BATCH) % len(langs)
        codes = np.full((TRAIN_SPAN, BATCH), _PAD, np.int16)
        for lane, lang in enumerate(target):
            text = by_lang[lang][draw.integers(len(by_lang[lang]))]
            at = draw.integers(max(len(text) - TRAIN_SPAN, 0) + 1)
            part = text[at : at + TRAIN_SPAN]
            codes[: len(part), lane] = part
        _, grads = gradients(model, codes, target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for p, g, (m, v) in zip(model.parameters(), grads, moments):
            g = g.astype(np.float32) * min(1.0, 5.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(key: Column) -> Column:
    """Whether a record is kept from training: crc32 of its key as text leaves 2 when divided by 4."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def training_sample(documents: DataFrame, key: str, text: str, lang: str) -> tuple[list[bytes], list[str]]:
    """About ``SAMPLE_DOCUMENTS`` labelled documents that are not held out, chosen by a hash of their key, a piece of each."""
    labelled = documents.filter(~held_out(quoted(key)) & quoted(lang).isNotNull() & (F.length(quoted(text)) > 0))
    labelled = labelled.select(quoted(lang).alias("lang"), quoted(text).alias("text"), F.xxhash64(quoted(key), F.lit(4)).alias("draw"))
    sizes = labelled.groupBy("lang").count().collect()  # one row per language, as many as the model gets
    if not sizes:
        return [], []
    wanted = SAMPLE_DOCUMENTS / len(sizes)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(wanted / r["count"], 1.0) * (1 << 30)))])
    chosen = labelled.filter(F.pmod("draw", F.lit(1 << 30)) < F.element_at(shares, F.col("lang")))
    start = F.pmod(F.shiftright("draw", 31), F.greatest(F.length("text") - SAMPLE_CHARACTERS, F.lit(1))).cast("int") + 1
    rows = chosen.select("lang", "draw", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARACTERS)).alias("piece")).orderBy("draw", "piece").limit(2 * SAMPLE_DOCUMENTS).collect()
    return [r.piece.encode() for r in rows], [r.lang for r in rows]


def predict(documents: DataFrame, model: ByteGru, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score (the predicted language's pooled probability). Only the text is looked at.

    Texts that are null or have no letter are ``und`` with score 0, all texts are if the model knows no language. Nothing is shuffled.
    """
    prepared = documents.select(quoted(key).alias("key"), quoted(text).alias("text"), F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    rows = keyed_texts(prepared, "key", "text", "letters")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part, data, bounds in A.blocks(batches):
            texts = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            pooled = np.zeros((len(texts), max(len(net.langs), 1)))
            if net.langs:
                codes, owner = _lanes(texts, SPAN)
                for first in range(0, codes.shape[1], _LANES):
                    some = np.ascontiguousarray(codes[:, first : first + _LANES])
                    shares = np.exp(byte_log_probabilities(net, some))
                    shares *= (some != _PAD)[:, None, :]
                    np.add.at(pooled, owner[first : first + _LANES], shares.sum(axis=0).T)
                pooled /= np.maximum(np.diff(bounds), 1)[:, None]
            best = pooled.argmax(axis=1)
            known = np.array(part.column("more_0").to_pylist(), bool) & bool(net.langs)
            names = [net.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(label, f"key {kind}, lang_pred string, score double")


def identify_languages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, held_out, lang_pred, score. Learns from labelled rows that are not held out, then labels all rows.

    Repeated and null keys keep their rows; other columns are ignored.
    """
    model = train(*training_sample(documents, key, text, lang))
    return predict(documents, model, key, text).select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
