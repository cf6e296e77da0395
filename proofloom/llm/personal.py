"""9. Personal data: base patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns and checks, and so do
seeds of a fifth kind, secret: what is assigned to a name such as token or
password, at least 16 characters with a digit.  The field
then labels the text's candidate tokens (runs of non-space that hold a digit or
an @) with a kind or with none.  Its potentials are

* of a token: the log odds of the labels given the token's signature, a
  discrete summary of its shape and of the candidate before it;
* of neighbours: the log ratio of how often two labels stand side by side;
* of skip edges, between a token and the next one in the document that repeats
  it or resembles it (the same last seven digits): the same ratio over such
  pairs.

They are trained piecewise, from counts over all documents, with the base spans
and seeds as labels.  Loopy belief propagation (sum-product, damped, a fixed number of
rounds) passes messages along both kinds of edges, with tokens of base spans
and seeds held to their label.  So a number that is written out once as a phone
makes a shorter mention of it far away in the document a phone too, and a key
that is assigned once is a secret wherever it stands.  Tokens that end
above ``sure`` and touch no base span are added.

Skip edges join each occurrence to the next one only, so a token repeated n
times adds n - 1 edges.  Null text: empty.  All steps are linear in the text,
also for long runs of digits or signs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_column
from .common import small_batches, table

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
LABELS = ["none", *ALL_KINDS]
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The base patterns; possessive repeats keep them linear.  A match starts at
# the start of a run of digits: from inside the run it fails or succeeds alike.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASSIGNED = re.compile(r"(?i:\b(?:token|secret|password|passwd|pwd|credentials?|(?:api|access|private|secret|auth)[_ -]?key)\b)[\"']? ?[=:] ?[\"']?([A-Za-z0-9_./+=-]{16,})")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[0-9@]\S*")
EDGE = ".,;:!?()[]{}<>\"'"


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        end = max(end, at + 1)
        at = text.find("@", end)
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Values assigned to the name of a secret, in order."""
    if "=" not in text and ":" not in text:
        return []
    return [("secret", m.start(1), m.end(1)) for m in ASSIGNED.finditer(text) if DIGIT.search(m[1])]


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, in order."""
    out, end = [], 0
    for m in CANDIDATE.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        out.append((start, end))
    return out


def signature(token: str, before: str) -> str:
    """Shape of a token, and of the candidate right before it (or empty)."""
    d = digits(token)
    n = next(i for i, most in enumerate((0, 1, 2, 3, 6, 8, 12, 19, 1 << 60)) if len(d) <= most)
    core = token.strip(EDGE)
    ip = core.count(".") == 3 and all(p.isascii() and p.isdigit() for p in core.split(".")) and octets(core)
    marks = "".join(c for c in "@+(=/\\\"-" if c in token)
    prior = "-" if not before else "+" if before[0] == "+" else "(" if before[0] == "(" else "d" if before[-1].isdigit() else "o"
    return f"{n}{marks}{min(token.count('.'), 4)}{'a' if any(c.isalpha() for c in token) else ''}{'v' if ip else ''}{'l' if n == 7 and luhn(d) else ''}|{prior}"


def graph(text: str):
    """(base spans, seeds, tokens, labels, signatures, chain edges, skip
    edges).  A seed that touches a base span gives way to it."""
    base, tokens = base_spans(text), candidates(text)
    own = [s for s in seeds(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
    label = [0] * len(tokens)
    starts = [s for s, _ in tokens]
    for kind, a, b in [*own, *reversed(base)]:
        i = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        while i < len(tokens) and tokens[i][0] < b:
            if tokens[i][1] > a:
                label[i] = LABELS.index(kind)
            i += 1
    near = [i > 0 and tokens[i][0] - tokens[i - 1][1] <= 1 for i in range(len(tokens))]
    words = [text[a:b] for a, b in tokens]
    signs = [signature(w, words[i - 1] if near[i] else "") for i, w in enumerate(words)]
    chain = [(i - 1, i) for i in range(len(tokens)) if near[i]]
    last: dict[str, int] = {}
    skip = set()
    for i, w in enumerate(words):
        d = digits(w)
        for key in {"w" + w.strip(EDGE).lower(), *(["d" + d[-7:]] if len(d) >= 7 else [])}:
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return base, own, tokens, label, signs, chain, sorted(skip)


def count_potentials(docs: DataFrame, text: str = "text") -> tuple[dict, np.ndarray, np.ndarray]:
    """Potentials from counts over all documents: a table bounded by the
    number of signatures and labels."""

    def count(frames):
        for frame in frames:
            c: Counter = Counter()
            for t in frame["t"]:
                if t and ("@" in t or DIGIT.search(t)):
                    _, _, _, label, signs, chain, skip = graph(t)
                    c.update(("token", s, str(y)) for s, y in zip(signs, label))
                    c.update(("chain", str(label[i]), str(label[j])) for i, j in chain)
                    c.update(("skip", str(label[i]), str(label[j])) for i, j in skip)
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["what", "a", "b", "n"])

    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    k = len(LABELS)
    rare = np.full(k, 0.2 / (k - 1))  # where little is seen, a token is none
    rare[0] = 0.8
    seen: dict[str, np.ndarray] = {}
    pairs = {"chain": np.full((k, k), 0.5), "skip": np.full((k, k), 0.01) + np.eye(k) * 100}
    for r in rows:
        if r["what"] == "token":
            seen.setdefault(r["a"], np.zeros(k))[int(r["b"])] += r["n"]
        else:
            pairs[r["what"]][int(r["a"]), int(r["b"])] += r["n"]
    unary = {s: np.log((n + 2 * rare) / (n.sum() + 2)) for s, n in seen.items()}
    unary[""] = np.log(rare)

    def ratio(n):
        p = n / n.sum()
        return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -8, 8)

    return unary, ratio(pairs["chain"]), ratio(pairs["skip"] + pairs["skip"].T)


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, which: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of every node by loopy belief propagation.  edges:
    (i, j) rows; potentials[which[e]] is the log potential of edge e."""
    n, k = unary.shape
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([potentials[which], potentials[which].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            message = damping * message + (1 - damping) * new
        unary = unary.copy()
        np.add.at(unary, target, message)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans_of(text: str, unary: dict, chain_pot: np.ndarray, skip_pot: np.ndarray, sure: float) -> list[dict]:
    """All spans of one text, base ones first."""
    if not text or not ("@" in text or DIGIT.search(text)):
        return []
    base, own, tokens, label, signs, chain, skip = graph(text)
    out = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
    out += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in own]
    u = np.array([unary.get(s, unary[""]) for s in signs]).reshape(len(signs), len(LABELS))
    for i, y in enumerate(label):
        if y:
            u[i] = -20.0
            u[i, y] = 0.0
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    which = np.array([0] * len(chain) + [1] * len(skip), np.int64)
    p = beliefs(u, edges, np.stack([chain_pot, skip_pot]), which)
    best = p.argmax(1)
    added: list[dict] = []
    for i, (a, b) in enumerate(tokens):
        if label[i] or not best[i] or p[i, best[i]] < sure:
            continue
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(EDGE)), b - (len(word) - len(word.rstrip(EDGE)))
        kind = LABELS[best[i]]
        if a >= b:
            continue
        if added and added[-1]["kind"] == kind and (i - 1, i) in chain and not label[i - 1] and a - added[-1]["end"] <= 3:
            added[-1]["end"] = b
        else:
            added.append({"kind": kind, "start": a, "end": b, "base": False})
    return out + added


def find_spans(docs: DataFrame, text: str = "text", spans: str = "pii", sure: float = 0.9) -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, base), by kind, then
    start."""
    found = span_finder(docs, text, sure)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    @F.arrow_udf(SPANS)
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([found(t) for t in texts.to_pylist()], kind)

    return docs.withColumn(spans, column(F.coalesce(F.col(text), F.lit(""))))


def span_finder(docs: DataFrame, text: str, sure: float):
    """The function from a text to its spans, with what ``docs`` teach."""
    model = count_potentials(docs, text)
    key = lambda s: (ALL_KINDS.index(s["kind"]), s["start"], s["end"])
    return lambda t: sorted(spans_of(t, *model, sure), key=key)


def cover(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by <KIND>."""
    end, parts = 0, []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            parts += [text[end : s["start"]], f"<{s['kind'].upper()}>"]
        end = max(end, s["end"])
    return "".join([*parts, text[end:]])


def masked(docs: DataFrame, sure: float = 0.9) -> DataFrame:
    """``docs`` with every span of the text replaced by <KIND>; n_chars, if
    there, follows.  Other texts stay as they are.

    One function finds the spans and covers them: two in a row would hold a
    second Python worker in every task slot."""
    found = span_finder(docs, "text", sure)
    new = free_column(docs, "_masked")

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        """Null for a text without spans."""
        spans = ((t, found(t)) for t in texts.to_pylist())
        return pa.array([cover(t, s) if s else None for t, s in spans], pa.string())

    d = docs.withColumn(new, mask("text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.withColumn("text", F.coalesce(new, "text")).select(*docs.columns)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return d.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))


QUERIES = {"op9_personal_data": op9_personal_data}
ORACLES: dict[str, str] = {}
