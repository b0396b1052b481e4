"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, long ones cut at a fixed length; the whole text is covered). Each
passage is encoded from character-class and word-repetition statistics by a small learned layer; gated
attention, learned from document labels alone, weighs the passages, and the weighted representation is scored.

The model is fitted on all passages of at most ``TRAIN_DOCS`` labelled documents, taken in the order of a hash of the key until
their texts have ``TRAIN_CHARS`` characters (one at least). Only that bounded sample and the model of a few thousand numbers pass through the driver.

Defined results: null text is an empty text, a bag of one empty passage; a very long text is scored on all of its passages; labels that are null are not used,
several labels of one document count as their mean, and of several texts of one key the least is learned from; with no labels, or labels of one class alone, every
score is the share of label 1 (1.0 with no labels at all); repeated rows get equal scores; a null key is not
held out and never trained on; an empty table gives an empty table; an existing column called like the score is replaced.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import map_arrow, materialise, without

#: Labelled documents, and characters of their texts, that the model is fitted on at most.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 12_000_000
#: Characters of a passage at most.
PASSAGE = 600
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 40, 128, 0.01

_CLASSES = 8


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte: lower, upper, digit, space, punctuation, exclamation, other symbols, beyond ASCII."""
    t = np.full(256, 6, np.int64)
    t[128:] = 7
    for i in range(128):
        c = chr(i)
        t[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:?'\"()-" else 5 if c == "!" else 6
    return t


_TABLE = _class_table()
N_FEATURES = _CLASSES * _CLASSES + 6


def passages(text: str | None) -> list[str]:
    out = []
    for line in (text or "").split("\n"):
        if len(line) <= PASSAGE:
            if line:
                out.append(line)
        else:
            out.extend([line[k:k + PASSAGE] for k in range(0, len(line), PASSAGE)])
    return out or [""]


def encode(bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Raw features of all passages in order, and the number of passages of each bag."""
    counts = np.fromiter(map(len, bags), np.int64, len(bags))
    flat = [p for b in bags for p in b]
    raw = [p.encode() for p in flat]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    cls = _TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), size)
    same = owner[1:] == owner[:-1]
    code = (owner[:-1] * _CLASSES + cls[:-1]) * _CLASSES + cls[1:]
    pairs = np.bincount(code[same], minlength=len(raw) * _CLASSES ** 2).reshape(len(raw), -1)
    x = np.zeros((len(raw), N_FEATURES))
    x[:, :64] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    for i, p in enumerate(flat):
        words = p.split()
        n = len(words)
        if n:
            x[i, 64:] = len(set(words)) / n, n < 4, sum(map(eq, words, words[1:])) / n, min(size[i] / n, 40) / 10, np.log1p(n), 1.0
    return x, counts


def bag_order(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Model:
    """Encoder, gated attention and scorer; ``fit`` is plain gradient descent with Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": g(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE),
                  "w": g(GATE), "c": g(HIDDEN), "b": np.zeros(1)}
        self.mean, self.std, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        p, starts = self.p, bag_order(counts)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -40, 40)))
        return h, t, s, a, z, y

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self._forward((x - self.mean) / self.std, counts)[-1]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weight of each passage in its document."""
        return self._forward((x - self.mean) / self.std, counts)[3]

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> "Model":
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 1.0
            return self
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, starts, rng = (x - self.mean) / self.std, bag_order(counts), np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                docs = order[at:at + BATCH]
                n = counts[docs]
                rows = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                grads = self._gradients(x[rows], n, labels[docs])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, n: np.ndarray, labels: np.ndarray) -> dict:
        p, starts = self.p, bag_order(n)
        h, t, s, a, z, y = self._forward(x, n)
        d = (y - labels) / len(labels)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(axis=1)
        dl = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
        dg = dl[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"E": x.T @ du, "e": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dl, "c": z.T @ d, "b": d.sum(keepdims=True)}


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    """label, features of all passages (bytes) and their number, for training."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode([passages(t) for t in batch.column("_text").to_pylist()])
        x, starts = x.astype(np.float32), bag_order(counts)
        raw = [x[i:i + n].tobytes() for i, n in zip(starts, counts)]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw, pa.binary()), pa.array(counts)], names=["label", "x", "n"])

    return map_arrow(docs, run, "label double, x binary, n long", "_text", max_bytes=1 << 20)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Learns from a sample of labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    sample = known.groupBy(F.col(key).alias("_key")).agg(F.avg(label_col).alias("label")).orderBy(F.xxhash64("_key"), "_key").limit(train_docs)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(sample), "_key")
    rows = materialise(rows.groupBy("_key", "label").agg(F.min("_text").alias("_text")), "labelled")  # one for each key
    at = rows.select(F.xxhash64("_key").alias("at"), F.char_length("_text").alias("n")).orderBy("at").toArrow()  # at most train_docs rows
    fits = np.cumsum(at.column("n").to_numpy()) <= train_chars
    if not fits.all():
        rows = rows.where(F.xxhash64("_key") <= at.column("at")[max(1, int(fits.sum())) - 1].as_py())
    got = _features(rows.select("label", "_text")).toArrow()  # of bounded texts
    label, counts = got.column("label").to_numpy(), got.column("n").to_numpy()
    raw = [v.as_buffer() for chunk in got.column("x").chunks for v in chunk]
    order = sorted(range(len(raw)), key=lambda i: (label[i], counts[i], raw[i].to_pybytes()[:1024]))
    x = np.frombuffer(b"".join([raw[i] for i in order]), np.float32).reshape(-1, N_FEATURES)
    return Model().fit(x, counts[order], label[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, score_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{score_col}` double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode([passages(t) for t in batch.column("_text").to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(x, counts))], names=[*kept, score_col])

    return map_arrow(docs.select(*kept, F.col(text_col).alias("_text")), run, schema, "_text", max_bytes=1 << 20)
