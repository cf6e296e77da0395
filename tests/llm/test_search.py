"""Operators 11, 12 and 13: numpy, a plain scorer and a plain window search as
references, edge cases, hot groups, clashing columns."""

import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from proofloom.llm import contamination, lexical, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, i int, v string, n long"


# --- 11 --------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "v", 1) for i, v in rows], VECTORS)


def whitened_by_numpy(rows, components):
    x = np.array([np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 100000 for _, v in rows])
    n, s = len(x), x.sum(0)
    c = (x * n - s) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((x * n - s) ** 2).sum(1), c @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 12)) * np.linspace(0.2, 2.0, 12) + 3
    rows = [(int(i % 650), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0] * 5), (906, [1e30] * 12)]
    out = whitening.whiten(vectors(spark, rows + bad), 8).collect()
    n, deviation, white, share = whitened_by_numpy(rows, 8)
    assert len(out) == n == 700 and {r.n for r in out} == {700}
    assert sorted((r.vec_id, r.deviation) for r in out) == sorted((i, int(d)) for (i, _), d in zip(rows, deviation))
    by = {r.deviation: r for r in out}
    got = np.array([by[int(d)].whitened for d in deviation])
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    assert np.allclose(out[0].explained, share) and out[0].identity_error < 1e-9


def test_whitening_without_variance_and_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    one = whitening.whiten(vectors(spark, [(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(None, 1, 0, [None, None], None)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 4.0, 2.0 * i]) for i in range(50)] * 2)).collect()
    assert len(flat) == 100 and all(r.whitened[1:] == [None, None] and r.explained[1:] == [0.0, 0.0] for r in flat)
    assert abs(sum(r.whitened[0] ** 2 for r in flat) / 100 - 1) < 1e-9 and flat[0].identity_error < 1e-9
    far = whitening.whiten(vectors(spark, [(i, [1e12 + 1e9 * (i % 3), float(i)]) for i in range(90)])).collect()
    assert sum(r.deviation is None for r in far) == 60 and far[0].identity_error < 1e-4


# --- 12 --------------------------------------------------------------------

TEXTS = "doc_id long, text string, m long, part int, term string"


def texts(spark, rows, schema=TEXTS):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], schema)


def ranked_by_hand(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    split = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in split if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in sorted({i for i, _ in items}, key=str):
        wanted = {t for i, x in items if i == item for t in terms(x)}
        scores = []
        for at, (i, w) in enumerate(held):
            m = 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in wanted if t in df and t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0, at))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings,docs_in_part,visits,block", [(1 << 14, 2048, 8, 256), (40, 3, 1, 2)])
def test_search_equals_a_plain_scorer(spark, monkeypatch, postings, docs_in_part, visits, block):
    """Small and usual parts, blocks and visits give the same rows; repeated
    rows, null and repeated ids, ties, one stratum with most documents."""
    for name, value in (("PART_POSTINGS", postings), ("PART_DOCS", docs_in_part), ("VISITS", visits), ("BLOCK_ITEMS", block), ("BLOCK_TERMS", 8 * block)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "ñandú", "x1", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 5, 5, 30])))) for i in range(120)]
    docs += [(200 + i, "the W1 w1, w2. w3") for i in range(60)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (None, "w3"), (300, None), (301, ""), (302, "... !"), (303, "the " * 3000)]
    items = [(1, "W1 w2 the w1"), (2, "ñandú É none"), (3, "absent words"), (4, None), (5, ""), (None, "w3 w4"), (6, "w5"), (6, "w6 w7"), (8, " ".join(words))]
    out = lexical.search(texts(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == ranked_by_hand(docs, items, 10)


def test_search_of_nothing(spark):
    none, some = texts(spark, []), texts(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(some, items.limit(0)).count() == 0
    assert lexical.search(texts(spark, [(1, None)]), items).count() == 0
    assert [tuple(r) for r in lexical.search(some, items).collect()][0][:3] == (1, 1, 1)


# --- 13 --------------------------------------------------------------------


def word_list(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def marked_by_hand(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, held = word_list(t), set(), set()
        for item, x in items:
            q = word_list(x)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        held.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(held)))
    return sorted(out, key=str)


def test_phrases_equal_a_plain_search(spark):
    """Exact copies, pieces of a window more or less, overlaps, items of few
    words, periodic texts, repeated and null ids, very long texts."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)] + ["a", "É"]
    passages = {i: " ".join(rng.choices(words, k=14)) for i in range(6)}
    items = [*passages.items(), (20, "short item"), (21, "One"), (22, None), (23, " .. "), (24, "a " * 14), (25, passages[0]), (25, "w1 w2 w3"), (None, "nobody's words")]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 40, 80])))) for i in range(40)]
    for i, p in passages.items():
        cut = p.split()
        docs += [(100 + i, "x " + p.upper() + ". y"), (110 + i, " ".join(cut[:9])), (120 + i, "z " + " ".join(cut[2:12]) + " " + p), (130 + i, " ".join(cut[:5] + ["q"] + cut[5:]))]
    docs += [(200, "a " * 33), (7, "Short ITEM"), (7, "short item"), (None, "one short item"), (None, None), (201, ""), (202, ("b " * 5000 + passages[1] + " ") * 2), (203, "nobody's words")]
    out = contamination.marked(texts(spark, docs, "doc_id long, text string, row long, pos int, term_id string"), spark.createDataFrame(items, "item_id long, text string"), window=10, slop=2)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=str) == marked_by_hand(docs, items, 10)
    near = {r.doc_id: r.near_items for r in out.collect() if r.doc_id is not None}
    assert all(near[130 + i] >= 1 for i in passages) and all(near[100 + i] >= 1 for i in passages)


def test_proximity_within_slop(spark):
    """The rarest word at its place, the others within two places of theirs."""
    item = "p1 p2 p3 p4 p5 rare"
    docs = [(1, item), (2, "p2 p1 p3 p5 p4 rare"), (3, "p1 p2 p3 p4 p5 x x x rare"), (4, "p3 p2 p1 p4 p5 rare"), (5, "p1 p2 p3 p4 rare"), (6, "p4 p2 p3 p1 p5 rare")]
    docs += [(10 + i, "p1 p2 p3 p4 p5 " * 3) for i in range(5)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    _, exact, near = contamination.find(texts(spark, docs), items, window=10, slop=2)
    names, _, _ = contamination.find(texts(spark, docs), items, window=10, slop=2)
    ids = {r.row: r.doc_id for r in names.collect()}
    assert len(ids) == len(docs)
    documents, exact, near = contamination.find(texts(spark, docs), items, window=10, slop=2)
    named = lambda df: sorted(r.doc_id for r in df.join(documents, "row").select("doc_id").distinct().collect())
    assert named(exact) == [1] and named(near) == [1, 2, 4]
    for empty in (contamination.marked(texts(spark, []), items), contamination.marked(texts(spark, docs), items.limit(0)).where("n_hit > 0 OR near_items > 0")):
        assert empty.count() == 0


def test_decontamination_digest(spark):
    out = contamination.op13_decontamination(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert out.items_sha256 == hashlib.sha256(b"").hexdigest() and not out.contaminated


# --- 6 ---------------------------------------------------------------------


def test_top_k_over_many_small_blocks(spark):
    """Blocks of 16 rows against one block: clustered vectors, copies, equal
    scores and vectors of several lengths; and far blocks are not searched."""
    from proofloom.llm import topk

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 900
    rows = [(int(i), [float(round(c)) for c in centres[i % 6] + rng.normal(size=8) * 20]) for i in range(240)]
    rows += [(7, rows[7][1])] * 3 + [(500 + i, rows[12][1]) for i in range(4)] + [(900 + i, [float(i), 1.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = v.where("vec_id % 5 = 0")
    small, one = topk.top_k(q, v, 5, block_rows=16), topk.top_k(q, v, 5)
    assert small.exceptAll(one).count() == 0 == one.exceptAll(small).count() and small.count() > 200
    c, b = topk.in_blocks(v, "cb", 16), topk.in_blocks(q, "qb", 16)
    bounds = {(r.dim, r.qb, r.cb): r.bound for r in topk.pair_bounds(b, c).collect()}
    pairs = b.select("dim", "qb", F.col("v").alias("x")).join(c.select("dim", "cb", F.col("v").alias("y")), "dim")
    best = pairs.groupBy("dim", "qb", "cb").agg(F.max(F.aggregate(F.zip_with("x", "y", lambda m, n: m * n), F.lit(0.0), lambda s, t: s + t)).alias("most")).collect()
    assert len(best) == len(bounds) and all(bounds[(r.dim, r.qb, r.cb)] >= r.most for r in best)
    assert sum(x < 0 for x in bounds.values()) > 0
