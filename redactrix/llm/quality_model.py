"""Quality classifier by attention-based multiple-instance learning: passages are encoded, gated attention weighs them, the document's label teaches both.

A passage is a run of 64 words. It is encoded from the mean of learned vectors of its words and word pairs (hashed into
a table) and from counts of characters and words. Long texts are read in pieces; a passage ends with its piece, and
repeats are looked for within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrix.llm import textnp

PASSAGE = 64
#: Rows of the table of word and pair vectors (row 0: no words), numbers of a vector, of an encoded passage and of the attention.
TABLE, VECTOR, HIDDEN, ATTENTION = 8192, 16, 16, 8
#: Labelled documents the model is fitted on at most (those of the smallest hashed ids), and passages of each (evenly spaced).
SAMPLE, SAMPLE_PASSAGES = 4000, 64
#: Steps of gradient descent, documents of a step, rate, and decay of the weights.
STEPS, BATCH, RATE, DECAY = 600, 64, 0.01, 1e-4
SEED = 11
FOLDS = 5


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


UPPER, LETTER = _lut(bytes(range(65, 91))), _lut(bytes([*range(65, 91), *range(97, 123)]))
CLASSES = [_lut(b"#*$%&|<>"), _lut(b"!?"), _lut(b".,;:"), _lut(b"0123456789"), _lut(b"\n"), _lut(bytes(range(192, 256))), _lut(b"/\\_=+~^@{}[]()\"")]
N_FEATURES = 20


def _chosen(values: np.ndarray, counts: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of values, those numbered ``by``, one after another, with their lengths."""
    begin, n = (np.cumsum(counts) - counts)[by], counts[by]
    return values[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, text number, rows of the table, how many of those) of the passages; a text without words has one passage that says so."""
    n = len(offsets) - 1
    begin, end, text = textnp.word_table(data, offsets)
    count = np.bincount(text, minlength=n)
    empty = np.flatnonzero(count == 0)
    blank = np.zeros((len(empty), N_FEATURES), np.float32)
    blank[:, -1] = 1
    if not len(begin):
        return blank, empty, np.zeros(len(empty), np.uint16), np.ones(len(empty), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    within = np.arange(len(begin)) - first[text]
    starts = np.flatnonzero(within % PASSAGE == 0)
    passage = np.cumsum(within % PASSAGE == 0) - 1
    words = np.diff(np.append(starts, len(begin))).astype(np.float32)
    p_begin = begin[starts]
    p_end = end[np.append(starts[1:], len(begin)) - 1]

    def total(values):
        c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (c[p_end] - c[p_begin]).astype(np.float32)

    per_word = lambda v: np.add.reduceat(v.astype(np.float32), starts) / words
    accented = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    upper = UPPER[data].copy()
    upper[1:] += accented
    letters = LETTER[data] + (data >= 0xC0)
    hashes = textnp.word_hashes(data, begin, end)
    same = np.zeros(len(begin))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=len(starts)) / words
    again = np.zeros(len(begin))
    if len(begin) >= 5:
        ok = text[: len(text) - 4] == text[4:]
        g = sum(hashes[k : len(hashes) - 4 + k] * textnp.MULTIPLIERS[k] for k in range(5))
        at = np.flatnonzero(ok)
        by = np.lexsort((g[at], text[at]))
        g, t = g[at][by], text[at][by]
        twin = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
        again[at[by[np.flatnonzero(twin)]]] = 1
        again[at[by[np.flatnonzero(twin) + 1]]] = 1
    length = (end - begin).astype(np.float32)
    chars = np.maximum(total(np.ones(1, np.int8).repeat(len(data))), 1)
    n_letters = np.maximum(total(letters), 1)
    columns = [
        np.log1p(words), per_word(length), per_word(length <= 3), per_word(length > 20), total(upper) / n_letters, n_letters / chars,
        *[total(c[data]) / words for c in CLASSES], per_word(same), distinct, per_word(again), per_word((data[begin] >= 65) & (data[begin] <= 90)), per_word((data[end - 1] == 46) | (data[end - 1] == 44)), np.log1p(count[text[starts]]),
    ]
    x = np.zeros((len(starts), N_FEATURES), np.float32)
    x[:, : len(columns)] = np.stack(columns, 1)
    x, t = np.concatenate([x, blank]), np.concatenate([text[starts], empty])
    pair = passage[1:] == passage[:-1]
    rows = np.concatenate([hashes, textnp.mixed(hashes[:-1] * textnp.MULTIPLIERS[5] + hashes[1:] * textnp.MULTIPLIERS[6])[pair]])
    rows = (1 + (rows >> textnp.U(20)) % textnp.U(TABLE - 1)).astype(np.uint16)
    of = np.concatenate([passage, passage[:-1][pair]])
    rows, held = rows[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(starts))
    rows, held = np.concatenate([rows, np.zeros(len(empty), np.uint16)]), np.concatenate([held, np.ones(len(empty), np.int64)])
    by = np.argsort(t, kind="stable")
    return x[by], t[by], *_chosen(rows, held, by)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def encode(m: dict, x: np.ndarray, rows: np.ndarray, held: np.ndarray) -> dict:
    """Passages as vectors h, with the scores e that attention weighs them by."""
    s = (x - m["mean"]) / m["std"]
    bag = np.add.reduceat(m["E"][rows], np.cumsum(held) - held) / held[:, None]
    h = np.tanh(s @ m["W"] + bag @ m["B"] + m["b"])
    v, u = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    return {"s": s, "bag": bag, "h": h, "v": v, "u": u, "e": (v * u) @ m["w"]}


def pool(m: dict, h: np.ndarray, e: np.ndarray, starts: np.ndarray) -> dict:
    """Scores of the documents whose passages begin at ``starts``, from the attention-weighted mean of their vectors."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    a = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a /= np.add.reduceat(a, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"of": of, "a": a, "z": z, "score": _sigmoid(z @ m["c"] + m["d"])}


def forward(m: dict, x, rows, held, starts) -> dict:
    f = encode(m, x, rows, held)
    return f | pool(m, f["h"], f["e"], starts)


NAMES = ("E", "W", "B", "b", "V", "U", "w", "c", "d")


def gradients(m: dict, x, rows, held, starts, y) -> dict:
    """Of the documents' mean cross-entropy, by each of the model's weights."""
    f = forward(m, x, rows, held, starts)
    of, h, v, u, a = f["of"], f["h"], f["v"], f["u"], f["a"]
    dy = (f["score"] - y) / len(y)
    g = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
    dz = dy[:, None] * m["c"]
    da = (h * dz[of]).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[of])
    g["w"] = (v * u).T @ de
    dv, du = de[:, None] * m["w"] * u * (1 - v**2), de[:, None] * m["w"] * v * u * (1 - u)
    g["V"], g["U"] = h.T @ dv, h.T @ du
    dh = (a[:, None] * dz[of] + dv @ m["V"].T + du @ m["U"].T) * (1 - h**2)
    g["W"], g["b"], g["B"] = f["s"].T @ dh, dh.sum(0), f["bag"].T @ dh
    by = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.append(True, rows[by][1:] != rows[by][:-1]))
    g["E"] = np.zeros_like(m["E"])
    g["E"][rows[by][first]] = np.add.reduceat(((dh @ m["B"].T) / held[:, None])[np.repeat(np.arange(len(held)), held)[by]], first)
    return g


def new_model(x: np.ndarray, seed: int = SEED) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    return {
        "mean": x.mean(0), "std": np.maximum(x.std(0), 1e-3), "E": rng.normal(0, 0.1, (TABLE, VECTOR)), "W": draw(x.shape[1], HIDDEN), "B": draw(VECTOR, HIDDEN), "b": np.zeros(HIDDEN),
        "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1),
    }


def fit(x, rows, held, starts, y, steps: int = STEPS, seed: int = SEED) -> dict:
    """Word vectors, encoder, gated attention and classifier, taught together from document labels by gradient descent (Adam)."""
    m, rng = new_model(x, seed), np.random.default_rng(seed + 1)
    one, two = {k: np.zeros_like(m[k]) for k in NAMES}, {k: np.zeros_like(m[k]) for k in NAMES}
    passages, todo = np.diff(np.append(starts, len(x))), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(todo):
            todo = rng.permutation(len(y))
        docs, todo = np.sort(todo[:BATCH]), todo[BATCH:]
        own, n = _chosen(np.arange(len(x)), passages, docs)
        g = gradients(m, x[own], *_chosen(rows, held, own), np.cumsum(n) - n, y[docs])
        for k in NAMES:
            d = g[k] + (DECAY * m[k] if k not in "bd" else 0)
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _passages(batches):
    """For each run of texts i to j of a batch: (batch, i, j, counts, text numbers from i, rows, held); a long text comes in pieces."""
    for b in batches:
        data, offsets = textnp.text_bytes(b.column("text"))
        for i, j in textnp.blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            if len(part) > 2 * textnp.BLOCK:
                # a word longer than a piece is read as several
                cuts = [(q, min(e, q + 2 * textnp.BLOCK)) for s, e in textnp.word_pieces(part) for q in range(s, e, 2 * textnp.BLOCK)]
                cuts = [(s, e) for s, e in cuts if not textnp.IS_SPACE[part[s:e]].all()] or [(0, 1)]
                for s, e in cuts:
                    yield b, i, j, *passage_features(part[s:e], np.array([0, e - s]))
            else:
                yield b, i, j, *passage_features(part, offsets[i : j + 1] - offsets[i])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from at most ``sample`` labelled documents outside the held-out fold; only their passages' features are collected.

    Labels that are null, or of no document, teach nothing; a document labelled twice counts by its larger label.
    No labels, or one class only: a model that scores every document with the share of label 1 (1 without labels).
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    y = [r["y"] for r in chosen]
    if len(set(y)) < 2:
        return {"only": float(y[0]) if y else 1.0}
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "doc_id long, y int")

    def work(batches):
        for b in batches:
            kept: dict[int, list] = {}
            for _, i, _, x, t, rows, held in _passages([b]):
                cuts = np.cumsum(held) - held
                for k, (f, c, h) in enumerate(zip(x, cuts.tolist(), held.tolist(), strict=True)):
                    kept.setdefault(i + int(t[k]), []).append((f.astype("<f4").tobytes(), rows[c : c + h].astype("<u2").tobytes()))
            for k, own in kept.items():
                own = [own[p] for p in np.unique(np.linspace(0, len(own) - 1, SAMPLE_PASSAGES).astype(int))] if len(own) > SAMPLE_PASSAGES else own
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1), b.column("y").slice(k, 1), pa.array([[x for x, _ in own]], pa.list_(pa.binary())), pa.array([[r for _, r in own]], pa.list_(pa.binary()))], names=["doc_id", "y", "x", "rows"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    got = texts.mapInArrow(work, "doc_id long, y int, x array<binary>, rows array<binary>").orderBy("doc_id", "x").collect()
    if len({r["y"] for r in got}) < 2:
        return {"only": float(got[0]["y"]) if got else 1.0}
    rows = [np.frombuffer(p, "<u2") for r in got for p in r["rows"]]
    x = np.stack([np.frombuffer(p, "<f4") for r in got for p in r["x"]]).astype(float)
    n = np.array([len(r["x"]) for r in got])
    m = fit(x, np.concatenate(rows), np.array([len(p) for p in rows]), np.cumsum(n) - n, np.array([r["y"] for r in got], float))
    return m | {"E": m["E"].astype(np.float32)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score) of each row of docs, over its whole text. Null and empty texts score as a passage without words."""

    def scored(b, i, j, parts):
        if "only" in model:
            s = np.full(j - i, model["only"])
        else:
            h, e, t = (np.concatenate([p[k] for p in parts]) for k in range(3))
            s = pool(model, h, e, np.searchsorted(t, np.arange(j - i)))["score"]
        return pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(s, pa.float64())], names=["doc_id", "score"])

    def work(batches):
        last, parts = None, []
        for b, i, j, x, t, rows, held in _passages(batches):
            if last and (last[0] is not b or last[1] != i):
                yield scored(*last, parts)
                parts = []
            last = (b, i, j)
            if "only" not in model:
                f = encode(model, x, rows, held)
                parts.append((f["h"], f["e"], t))
        if last:
            yield scored(*last, parts)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
