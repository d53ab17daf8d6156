import random
import zlib

import numpy as np

from textloom.llm import language_id as L

WORDS = {"aa": "the of and to in that with for was this".split(), "bb": "der die und das nicht eine für auf über".split()}


def rows(n):
    draw = random.Random(1)
    return [(i, " ".join(draw.choice(WORDS[lang]) for _ in range(40)), lang) for i in range(n) for lang in [draw.choice(["aa", "bb"])]]


def test_backpropagation_gives_the_slope_of_the_loss():
    model, draw = L.new_model(["a", "b", "c"]), np.random.default_rng(0)
    for group in (model.inputs, model.gates, model.candidates):
        group[:] = [w.astype(np.float64) for w in group]
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    codes = draw.integers(0, 256, (7, 5)).astype(np.int16)
    codes[5:, 1] = 256
    target = np.array([0, 1, 2, 0, 1])
    _, slopes = L.gradients(model, codes, target)
    for weight, slope in zip(model.parameters(), slopes):
        at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
        losses = []
        for step in (1e-2, -2e-2):
            weight[at] += step
            losses.append(L.gradients(model, codes, target)[0])
        weight[at] += 1e-2
        assert abs((losses[0] - losses[1]) / 2e-2 - slope[at]) < 1e-4


def test_padding_changes_no_byte():
    model, draw = L.new_model(["a", "b"]), np.random.default_rng(2)
    codes = draw.integers(0, 256, (10, 3)).astype(np.int16)
    padded = np.concatenate([codes, np.full((6, 3), 256, np.int16)])
    assert np.allclose(L.byte_log_probabilities(model, codes), L.byte_log_probabilities(model, padded)[:10], atol=1e-5)


def test_held_out_accuracy_and_column_rules(spark):
    df = spark.createDataFrame(rows(400), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify_languages(df).collect()}
    held = [(i, lang) for i, _, lang in rows(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_and_languages_are_not_looked_at(spark):
    df = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    other = df.selectExpr("doc_id", "text", "case when crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2 then 'zz' else lang end as lang")
    plain, changed = (sorted(map(tuple, L.identify_languages(d).collect())) for d in (df, other))
    assert plain == changed


def test_odd_rows(spark, odd, nothing):
    got = L.identify_languages(odd).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert L.identify_languages(nothing).count() == 0
    assert {r.lang_pred for r in L.identify_languages(odd.withColumn("lang", odd["lang"].substr(9, 0)).na.replace("", None, "lang")).collect()} == {"und"}


def plain_log_probabilities(model, window):
    """One window, one byte and one unit of the state after the other."""
    import math

    def states(side, order):
        table, gates, candidate, state, out = model.inputs[side], model.gates[side], model.candidates[side], [0.0] * L.HIDDEN, {}
        for t in order:
            given = [float(x) for x in table[:, window[t]]]
            both = [1 / (1 + math.exp(-(given[i] + sum(float(gates[i][j]) * state[j] for j in range(L.HIDDEN))))) for i in range(2 * L.HIDDEN)]
            gated = [both[L.HIDDEN + i] * state[i] for i in range(L.HIDDEN)]
            fresh = [math.tanh(given[2 * L.HIDDEN + i] + sum(float(candidate[i][j]) * gated[j] for j in range(L.HIDDEN))) for i in range(L.HIDDEN)]
            state = [s + u * (f - s) for s, u, f in zip(state, both, fresh)]
            out[t] = state
        return out

    forth, back = states(0, range(len(window))), states(1, reversed(range(len(window))))
    rows = []
    for t in range(len(window)):
        scores = [float(b) + sum(float(w) * x for w, x in zip(line, forth[t] + back[t])) for line, b in zip(model.out, model.bias)]
        whole = math.log(sum(math.exp(s) for s in scores))
        rows.append([s - whole for s in scores])
    return np.array(rows)


def test_byte_labels_equal_a_plain_loop_over_time():
    model, draw = L.train([b"the of and to in that", b"der die und das nicht"], ["aa", "bb"], steps=15), np.random.default_rng(3)
    codes = draw.integers(0, 256, (20, 4)).astype(np.int16)
    got = L.byte_log_probabilities(model, codes.copy())
    for lane in range(4):
        assert np.allclose(got[:, :, lane], plain_log_probabilities(model, codes[:, lane]), atol=1e-4)
