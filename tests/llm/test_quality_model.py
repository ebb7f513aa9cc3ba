"""The classifier's forward pass against plain Python, its gradient against differences, long texts against short pieces."""

import math

import numpy as np
import pyarrow as pa

from redactrix.llm import quality_model, textnp

TEXTS = ["a short text of words", "", "word " * 200, "Ünïcode!! 12 #tags\n- list\n- list", "x"]


def features(texts):
    data, offsets = textnp.text_bytes(pa.array(texts, pa.string()))
    return quality_model.passage_features(data, offsets)


def plainly(m, x, rows, held, starts):
    """Scores of documents, one number at a time."""
    at, h, e = 0, [], []
    for p in range(len(x)):
        own = rows[at : at + held[p]]
        at += held[p]
        bag = [sum(m["E"][r][k] for r in own) / len(own) for k in range(quality_model.VECTOR)]
        s = [(x[p][k] - m["mean"][k]) / m["std"][k] for k in range(len(x[p]))]
        v = [math.tanh(sum(s[k] * m["W"][k][i] for k in range(len(s))) + sum(bag[k] * m["B"][k][i] for k in range(len(bag))) + m["b"][i]) for i in range(quality_model.HIDDEN)]
        h.append(v)
        e.append(sum(math.tanh(sum(v[i] * m["V"][i][j] for i in range(len(v)))) / (1 + math.exp(-sum(v[i] * m["U"][i][j] for i in range(len(v))))) * m["w"][j] for j in range(quality_model.ATTENTION)))
    out = []
    for b, c in zip(starts, [*starts[1:], len(x)], strict=True):
        weight = [math.exp(e[p]) for p in range(b, c)]
        z = [sum(weight[p - b] * h[p][i] for p in range(b, c)) / sum(weight) for i in range(quality_model.HIDDEN)]
        out.append(1 / (1 + math.exp(-(sum(z[i] * m["c"][i] for i in range(len(z))) + m["d"][0]))))
    return out


def test_forward_equals_plain_python():
    x, t, rows, held = features(TEXTS)
    starts = np.searchsorted(t, np.arange(len(TEXTS)))
    m = quality_model.new_model(x.astype(float))
    assert len(x) == 1 + 1 + 4 + 1 + 1 and int(held.sum()) == len(rows)
    got = quality_model.forward(m, x.astype(float), rows, held, starts)["score"]
    assert np.allclose(got, plainly(m, x, rows.tolist(), held.tolist(), starts.tolist()))


def test_gradient_equals_differences():
    x, t, rows, held = features(TEXTS)
    x, starts, y = x.astype(float), np.searchsorted(t, np.arange(len(TEXTS))), np.array([1, 0, 1, 0, 1.0])
    m = quality_model.new_model(x)
    g = quality_model.gradients(m, x, rows, held, starts, y)

    def loss():
        p = quality_model.forward(m, x, rows, held, starts)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    rng = np.random.default_rng(1)
    for name in quality_model.NAMES:
        flat, grad = m[name].reshape(-1), g[name].reshape(-1)
        places = rng.choice(len(flat), min(12, len(flat)), replace=False) if name != "E" else [int(r) * quality_model.VECTOR + 3 for r in rows[:12]]
        for k in places:
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-5 - grad[k]) < 1e-7, (name, k)


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(textnp, "BLOCK", 500)
    texts = ["a few words", "one two three " * 400, " " * 5000, "w" * 7000 + " end", None, "last"]
    seen = {}
    for b, i, j, x, t, rows, held in quality_model._passages([pa.record_batch({"text": pa.array(texts, pa.string())})]):
        assert len(x) == len(t) == len(held) and held.sum() == len(rows) and (held > 0).all()
        for k in t:
            seen[i + int(k)] = seen.get(i + int(k), 0) + 1
    assert set(seen) == set(range(6)) and seen[1] >= 1200 // 64 and seen[2] == 1 and seen[3] >= 7 and seen[0] == 1
