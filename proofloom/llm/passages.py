"""3. Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Each passage is
encoded to a vector: its character classes, word lengths, repetitions, and a
hashed profile of its words' endings.  A dense layer maps it to h; gated
attention scores it by  u . (tanh(V h) * sigmoid(U h)),  a softmax over the
document's passages gives the weights, and a logistic unit scores the weighted
sum of the h.  All layers are learned together, from document labels alone, on
a bounded labelled sample (numpy, Adam).  Scoring encodes every passage of
every whole text and needs no state between documents.

Null and empty texts have no passage: they score as one passage of zeros.
With one class only (or no labels) the score is that class's smoothed share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, blocks, crc_mod, lanes, sigmoid, small_batches, table
from .sampling import labelled_sample

PASSAGE_WORDS = 64
HASHED = 16
CLASSES = 10  # character classes, by byte
_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:"]], _CLASS[[ord(c) for c in "!?"]] = 4, 5
_CLASS[[ord(c) for c in "#*$%&|<>"]], _CLASS[[ord(c) for c in "'\"()-"]] = 6, 7
_CLASS[list(SPACE_BYTES)] = 8
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
WIDTH = CLASSES + 9 + HASHED


def encode(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, document of each passage) for texts laid end to end.
    Every document has one passage at least."""
    n = len(off) - 1
    space = _SPACE[raw]
    doc_at = np.repeat(np.arange(n), np.diff(off))
    word_byte = np.flatnonzero(~space)
    if len(word_byte):
        new = np.concatenate([[True], (np.diff(word_byte) > 1) | (doc_at[word_byte[1:]] != doc_at[word_byte[:-1]])])
        start, end = word_byte[new], np.concatenate([word_byte[np.flatnonzero(new)[1:] - 1], word_byte[-1:]]) + 1
    else:
        start = end = np.zeros(0, np.int64)
    doc = doc_at[start] if len(start) else np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n)
    first_word = np.cumsum(count) - count
    pieces = np.maximum(1, -(-count // PASSAGE_WORDS))
    first_piece = np.cumsum(pieces) - pieces
    owner, total = np.repeat(np.arange(n), pieces), int(pieces.sum())
    x = np.zeros((total, WIDTH), np.float32)
    if not len(start):
        return x, owner
    place = np.arange(len(start)) - first_word[doc]
    piece = first_piece[doc] + place // PASSAGE_WORDS
    size = (end - start).astype(np.float64)
    words = np.maximum(np.bincount(piece, minlength=total), 1)

    def mean(v):
        return np.bincount(piece, v, minlength=total) / words

    # Character classes: white space after a word belongs to its passage.
    word_of = np.searchsorted(start, np.arange(len(raw)), "right") - 1
    own = word_of >= 0
    own[own] = doc[word_of[own]] == doc_at[np.flatnonzero(own)]
    codes = piece[word_of[own]] * CLASSES + _CLASS[raw[own]]
    classes = np.bincount(codes, minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = classes / np.maximum(classes.sum(1, keepdims=True), 1)
    # A word's hash from its first and last eight bytes and its length.
    eight = lanes(raw)
    tail = eight[np.maximum(end - 8, start)]
    mask = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(size, 7).astype(np.uint64))) - np.uint64(1))
    head = eight[start] & mask
    key = (head * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail & mask) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (piece[1:] == piece[:-1])])
    by = np.lexsort((key, piece))
    again = np.zeros(len(key), bool)
    again[by] = np.concatenate([[False], (key[by][1:] == key[by][:-1]) & (piece[by][1:] == piece[by][:-1])])
    pair = key ^ np.roll(key, 1) * np.uint64(31)
    # Word pairs seen in the whole document; its first word follows no other.
    later = np.flatnonzero(place > 0)
    by = later[np.lexsort((pair[later], doc[later]))]
    seen = np.zeros(len(key), bool)
    if len(by):
        seen[by] = np.concatenate([[False], (pair[by][1:] == pair[by][:-1]) & (doc[by][1:] == doc[by][:-1])])
    last = _CLASS[raw[end - 1]]
    upper = _CLASS[raw[start]] == 1
    features = [size / 10, size * size / 100, same, again, seen, last == 4, (last == 5) | (last == 6), upper, None]
    for k, f in enumerate(features[:-1]):
        x[:, CLASSES + k] = mean(f)
    x[:, CLASSES + 8] = np.log1p(words) / 4
    slot = (key >> np.uint64(40)).astype(np.int64) % HASHED
    x[:, CLASSES + 9 :] = np.bincount(piece * HASHED + slot, minlength=total * HASHED).reshape(total, HASHED) / words[:, None]
    return x, owner


class Model:
    """Dense layer, gated attention and logistic unit, with their training."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        w = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": w(width, hidden), "b": np.zeros(hidden, np.float32), "V": w(hidden, gate), "U": w(hidden, gate), "u": w(gate, 1)[:, 0], "c": w(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.dev = np.zeros(width, np.float32), np.ones(width, np.float32)

    def forward(self, x, owner, n):
        p = self.p
        z = np.clip((x - self.mean) / self.dev, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["u"]
        starts = np.searchsorted(owner, np.arange(n))
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z, h, t, g, a, bag, bag @ p["c"] + p["d"][0]

    def attention(self, x, owner, n):
        return self.forward(x, owner, n)[4]

    def logits(self, x, owner, n):
        return self.forward(x, owner, n)[6]

    def step_gradients(self, x, owner, y, weight):
        p, n = self.p, len(y)
        z, h, t, g, a, bag, logit = self.forward(x, owner, n)
        r = (weight * (sigmoid(logit) - y)).astype(np.float32)
        out = {"c": bag.T @ r, "d": np.array([r.sum()], np.float32)}
        dbag = r[:, None] * p["c"]
        dh = a[:, None] * dbag[owner]
        da = (h * dbag[owner]).sum(1)
        starts = np.searchsorted(owner, np.arange(n))
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        out["u"] = (t * g).T @ de
        dt, dg = de[:, None] * p["u"] * g * (1 - t * t), de[:, None] * p["u"] * t * g * (1 - g)
        out["V"], out["U"] = h.T @ dt, h.T @ dg
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        out["W"], out["b"] = z.T @ dh, dh.sum(0)
        return out

    def train(self, x, owner, y, weight, epochs: int = 60, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 2):
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-3
        n = len(y)
        starts = np.searchsorted(owner, np.arange(n + 1))
        m, v, k = {q: 0 * a for q, a in self.p.items()}, {q: 0 * a for q, a in self.p.items()}, 0
        r = np.random.default_rng(seed)
        for epoch in range(epochs):
            for ids in np.array_split(r.permutation(n), max(1, n // batch)):
                sizes = starts[ids + 1] - starts[ids]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in ids])
                grads = self.step_gradients(x[rows], np.repeat(np.arange(len(ids)), sizes), y[ids], weight[ids] / weight[ids].sum())
                k += 1
                speed = rate * (1 - epoch / epochs)
                for q, gq in grads.items():
                    gq = gq + decay * self.p[q]
                    m[q], v[q] = 0.9 * m[q] + 0.1 * gq, 0.99 * v[q] + 0.01 * gq * gq
                    self.p[q] = (self.p[q] - speed * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, trainable, documents: int = 4000, characters: int = 16_000_000, text: str = "text") -> tuple[Model | None, float]:
    """(model, constant score without one), from a sample bounded by
    ``documents`` and ``characters``.  Passages are encoded on the driver."""
    rows = labelled_sample(docs, labels, "quality", trainable, documents, characters, text).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows])
    weight = np.array([r["weight"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None, float((weight[y == 1].sum() + 1) / (weight.sum() + 2)) if len(rows) else 0.5
    owners, xs = [], []
    for a, _, raw, off in blocks(pa.array([r["text"] for r in rows], pa.large_string())):
        x, owner = encode(raw, off)
        owners.append(owner + a)
        xs.append(x)
    # Classes share the weight evenly in training; the logit is moved back.
    even = np.where(y == 1, 0.5 / weight[y == 1].sum(), 0.5 / weight[y == 0].sum()) * weight
    model = Model().train(np.concatenate(xs), np.concatenate(owners), y, even)
    model.p["d"] = model.p["d"] + np.float32(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    return model, 0.5


def score_column(text, model: Model | None, constant: float):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, raw, off in blocks(texts, 1 << 18):
            n = len(off) - 1
            out.append(np.full(n, constant) if model is None else sigmoid(model.logits(*encode(raw, off), n).astype(float)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, trainable=None, threshold: float = 0.3, text: str = "text", **options) -> DataFrame:
    """``docs`` with score and predicted; the score depends on the text
    alone."""
    small_batches(docs.sparkSession, 500)
    model = fit(docs, labels, F.lit(True) if trainable is None else trainable, text=text, **options)
    d = docs.withColumn("score", score_column(F.col(text), *model))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 5) == 0
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(d, table(spark, sf_dir, "labels"), ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
