"""2. Toxicity by a counterfactual-regularised classifier.

A text's features are the hashed 5-byte and 8-byte strings of its lower-cased
bytes, each present or not.  A sparse logistic model is trained on a bounded
sample of labelled documents (proximal gradient steps with an L1 penalty).
Sentences of the sample that name a group are also rewritten with other group
terms in its place; the squared change of the logit between the sentence and
its rewrites is added to the loss, so that a neutral mention of one group scores
as that of another, and no group term carries weight of its own.

Group terms are a list in four languages, and what the sample itself shows:
words that stand in the same contexts (the words before and after them) and of
which none tells the classes apart.  A rewrite keeps the case of the word it
replaces, and a term stands only for terms of its own form, plurals for plurals.

Scoring looks every byte position of a whole text up in the weight table and
adds each feature found once.  The table's size is fixed (2^21 weights).

Null and empty texts score as a text without features.  With one class only
(or no labels) the score is that class's smoothed share for every document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, lanes, sigmoid, small_batches, table
from .sampling import labelled_sample

BITS = 20  # of each of the two feature tables
C5, C8 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32

#: Group terms that may stand for one another, by kind and form.
IDENTITY = {
    "gender": ["women", "men", "girls", "boys"],
    "person": ["woman", "man", "girl", "boy"],
    "faith": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "faiths": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    "origin": ["black", "white", "asian", "african", "american", "european", "mexican", "arab"],
    "group": ["immigrants", "refugees", "foreigners", "locals"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "transgender"],
    "age": ["old", "young", "elderly"],
    "de person": ["frau", "mann"],
    "de gender": ["frauen", "männer", "mädchen", "jungen"],
    "de faiths": ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"],
    "de origin": ["schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"],
    "de group": ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
    "es person": ["mujer", "hombre"],
    "es gender": ["mujeres", "hombres", "niñas", "niños"],
    "es faiths": ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
    "es origin": ["negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"],
    "es group": ["inmigrantes", "refugiados", "extranjeros", "locales"],
    "fr person": ["femme", "homme"],
    "fr gender": ["femmes", "hommes", "filles", "garçons"],
    "fr faiths": ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
    "fr origin": ["noirs", "blancs", "asiatiques", "africains", "européens", "arabes"],
    "fr group": ["immigrés", "réfugiés", "étrangers", "habitants"],
}
LISTED = {t: [o for o in terms if o != t] for terms in IDENTITY.values() for t in terms}
WORD = re.compile(r"[^\W\d_]+")


def features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 5-byte and 8-byte strings from each position on."""
    x = lanes(FOLD[raw])
    shift = np.uint64(64 - BITS)
    five = ((x & np.uint64(0xFFFFFFFFFF)) * C5) >> shift
    eight = ((x * C8) >> shift) + np.uint64(1 << BITS)
    return five.astype(np.int64), eight.astype(np.int64)


def feature_set(text: str) -> np.ndarray:
    """The distinct features of one text, with a space at either end."""
    raw = np.frombuffer(f" {text} ".encode(), np.uint8)
    five, eight = features(raw)
    return np.unique(np.concatenate([five[: max(0, len(raw) - 4)], eight[: max(0, len(raw) - 7)]]))


def found_terms(texts: list[str], labels: np.ndarray, most: int = 400, share: float = 0.005, alike: float = 0.9, mates: int = 4) -> dict[str, list[str]]:
    """Words of the sample that may stand for one another: of the ``most``
    words in at least ``share`` of its texts, those that do not tell the classes
    apart, each with the words of its own kind of ending (a final s or none)
    whose neighbours before and after are alike (cosine)."""
    split = [[w.lower() for w in WORD.findall(t)] for t in texts]
    held = [Counter() for _ in range(2)]
    for ws, y in zip(split, labels):
        held[int(y)].update(set(ws))
    n = [max(1, int((labels == c).sum())) for c in range(2)]
    often = [w for w, c in (held[0] + held[1]).most_common(most) if c >= max(5, share * len(texts))]

    def neutral(w):
        a, b = held[0][w] / n[0], held[1][w] / n[1]
        p = (held[0][w] + held[1][w]) / sum(n)
        return abs(a - b) <= 4 * np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-9)

    place = {w: i for i, w in enumerate(often)}
    beside = np.zeros((len(often), 2 * len(often) + 2))
    for ws in split:
        for i, w in enumerate(ws):
            if w in place:
                before = place.get(ws[i - 1], len(often)) if i else len(often)
                after = place.get(ws[i + 1], len(often)) if i + 1 < len(ws) else len(often)
                beside[place[w], before] += 1
                beside[place[w], len(often) + 1 + after] += 1
    beside = np.sqrt(beside)
    beside /= np.maximum(np.linalg.norm(beside, axis=1, keepdims=True), 1e-9)
    near = beside @ beside.T
    out = {}
    for w in often:
        if neutral(w):
            i = place[w]
            same = [often[j] for j in np.argsort(-near[i], kind="stable") if j != i and near[i, j] >= alike and often[j].endswith("s") == w.endswith("s") and neutral(often[j])]
            if same:
                out[w] = same[:mates]
    return out


def as_written(term: str, like: str) -> str:
    return term.upper() if like.isupper() and len(like) > 1 else term.capitalize() if like[0].isupper() else term


def rewrites(text: str, swaps: dict[str, list[str]] = LISTED, most: int = 4, sentences: int | None = None) -> list[tuple[str, str]]:
    """(sentence, sentence with its group terms swapped) pairs of a text, of its
    first ``sentences`` with a term."""
    out, used = [], 0
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        if used == sentences:
            break
        lists = [swaps[w] for w in (m[0].lower() for m in WORD.finditer(sentence)) if w in swaps]
        if lists:
            used += 1
            for k in range(min(most, max(len(x) for x in lists))):
                swap = lambda m, k=k: as_written((o := swaps[m[0].lower()])[k % len(o)], m[0]) if m[0].lower() in swaps else m[0]
                out.append((sentence, WORD.sub(swap, sentence)))
    return out


def swap_pairs(texts: list[str], labels: np.ndarray) -> list[tuple[str, str]]:
    """Pairs of the sample: every sentence with a listed term, and one sentence
    of each text (two rewrites) with the terms that the sample shows."""
    found = {w: o for w, o in found_terms(texts, labels).items() if w not in LISTED}
    return [p for t in texts for p in rewrites(t) + (rewrites(t, found, 2, 1) if found else [])]


def differences(pairs: list[tuple[str, str]], chosen: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, pair, feature, +1 or -1): the chosen features that only one text
    of a pair has."""
    of, at, sign = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for i, (a, b) in enumerate(pairs):
        one, other = feature_set(a), feature_set(b)
        for s, value in ((np.setdiff1d(one, other, True), 1.0), (np.setdiff1d(other, one, True), -1.0)):
            k = np.searchsorted(chosen, s)
            k = k[chosen[np.minimum(k, len(chosen) - 1)] == s]
            of.append(np.full(len(k), i))
            at.append(k)
            sign.append(np.full(len(k), value))
    return len(pairs), np.concatenate(of), np.concatenate(at), np.concatenate(sign)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, kept: int = 4096, l1: float = 2e-3, swap_penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """(table of weights, bias)."""
    w = np.zeros(2 << BITS, np.float32)
    positive, total = float(weights[labels == 1].sum()), float(weights.sum())
    bias = float(np.log((positive + 1) / (total - positive + 1)))
    if len(set(labels.tolist())) < 2:
        return w, bias
    sets = [feature_set(t) for t in texts]
    # The features that tell the classes apart most, by document shares.
    share = [np.bincount(np.concatenate([s for s, y in zip(sets, labels) if y == c]), minlength=2 << BITS) / (labels == c).sum() for c in (0, 1)]
    gain = np.abs(share[1] - share[0]) / np.sqrt((share[0] + share[1]) * (1 - (share[0] + share[1]) / 2) + 1e-3)
    chosen = np.sort(np.argpartition(-gain, kept)[:kept])

    def rows(all_sets):
        m = np.zeros((len(all_sets), kept), np.float32)
        for i, s in enumerate(all_sets):
            at = np.searchsorted(chosen, s)
            at = at[chosen[np.minimum(at, kept - 1)] == s]
            m[i, at] = 1
        return m

    x = rows(sets)
    pairs = swap_pairs(texts, labels) if swap_penalty else []
    n_pairs, of, at, sign = differences(pairs, chosen)
    # Classes weigh alike while training; the bias then gets the real shares.
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()).astype(np.float32)
    v, b, momentum, c = np.zeros(kept, np.float32), 0.0, np.zeros(kept, np.float32), 0.0
    rate = 4.0 / float((balance[:, None] * x * x).sum(0).max() * np.sqrt(kept) + 4 * swap_penalty * len(at) / max(n_pairs, 1) + 1)
    for step in range(steps):
        p = sigmoid(x @ momentum + c)
        g = balance * (p - labels).astype(np.float32)
        grad = x.T @ g
        if n_pairs:
            moved = np.bincount(of, sign * momentum[at], minlength=n_pairs)
            grad += (swap_penalty * 2 / n_pairs * np.bincount(at, sign * moved[of], minlength=kept)).astype(np.float32)
        new = momentum - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = c - rate * float(g.sum())
        momentum, c = new + (step / (step + 3)) * (new - v), new_b + (step / (step + 3)) * (new_b - b)
        v, b = new, new_b
    # Last: scale and bias on the weighted sample, so that scores are shares.
    z, weight = x @ v, weights / total
    scale, shift = 1.0, bias
    for _ in range(200):
        p = sigmoid(scale * z + shift)
        r, h = weight * (p - labels), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, [(r * z).sum() + 1e-4 * (scale - 1), r.sum()])
        scale, shift = np.clip(scale - np.clip(move[0], -1, 1), 0.1, 50), shift - np.clip(move[1], -1, 1)
    w[chosen] = scale * v
    return w, float(shift)


def score_column(text, weights: np.ndarray, bias: float):
    """Column of scores of whole texts."""
    used = np.flatnonzero(weights)
    values = weights[used]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = np.zeros(2 << BITS, np.float32)
        w[used] = values
        on = w != 0
        out = []
        padded = pa.array([f" {t or ''} " for t in texts.to_pylist()], pa.large_string())
        for _, _, raw, off in blocks(padded, 1 << 18):
            n = len(off) - 1
            logit = np.full(n, bias)
            hits = []
            for codes, size in zip(features(raw), (5, 8)):
                at = np.flatnonzero(on[codes])
                doc = np.searchsorted(off, at, "right") - 1
                inside = at + size <= off[doc + 1]
                hits.append(doc[inside] * (2 << BITS) + codes[at[inside]])
            each = np.unique(np.concatenate(hits))
            np.add.at(logit, each >> (BITS + 1), w[each & ((2 << BITS) - 1)])
            out.append(sigmoid(logit))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def fit(docs: DataFrame, labels: DataFrame, trainable, documents: int = 3000, characters: int = 10_000_000, text: str = "text", **options) -> tuple[np.ndarray, float]:
    """Weights from a sample bounded by ``documents`` and ``characters``."""
    rows = labelled_sample(docs, labels, "toxic", trainable, documents, characters, text).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return np.zeros(2 << BITS, np.float32), 0.0
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows]), **options)


def classify(docs: DataFrame, labels: DataFrame, trainable=None, threshold: float = 0.3, text: str = "text", **options) -> DataFrame:
    """``docs`` with score and predicted; the score depends on the text
    alone."""
    small_batches(docs.sparkSession, 500)
    model = fit(docs, labels, F.lit(True) if trainable is None else trainable, text=text, **options)
    d = docs.withColumn("score", score_column(F.col(text), *model))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 4) == 2
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(d, table(spark, sf_dir, "labels"), ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
