"""Operators 2, 3, 4, 8, 9 and 10, and the pipeline: brute force, round trips,
held-out accuracy and edge cases."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from proofloom.llm import passages, personal, pieces, sampling, simhash, suffixes, toxicity  # noqa: E402
from proofloom.llm.common import table  # noqa: E402

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "the same text twice over and over"), (4, "the same text twice over and over"), (None, "no id"), (None, None), (7, "é" * 100_000), (8, "x y " * 30_000)]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], DOCS)


# --- 2 and 3 ---------------------------------------------------------------


@pytest.mark.parametrize("query,label,recall", [(toxicity.op2_toxicity, "toxic", 0.6), (passages.op3_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, recall):
    truth = {r.doc_id: r[label] for r in table(spark, MEDIUM, "labels").collect()}
    rows = query(spark, MEDIUM).collect()
    assert len(rows) == table(spark, MEDIUM, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p for p, y in held if y) >= recall * sum(y for _, y in held)
    assert sum(p != y for p, y in held) <= 0.1 * len(held)


@pytest.mark.parametrize("module", [toxicity, passages])
def test_classifiers_take_edge_cases(spark, module):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (8, 0, 0), (99, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = module.classify(documents(spark, EDGE), known)
        assert out.count() == len(EDGE) and out.where("score IS NULL OR isnan(score)").count() == 0
        assert out.columns.count("score") == 1 and "fp" in out.columns
    assert module.classify(documents(spark, []), labels).count() == 0


def test_a_long_or_absent_text_takes_no_place_in_the_sample(spark):
    """Whichever document is first in the order: the others stay, and labels
    without a text do not count."""
    for long in range(6):
        d = documents(spark, [(i, "x" * (900 if i == long else 10)) for i in range(6)] + [(6, None)])
        labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
        rows = sampling.labelled_sample(d, labels, "quality", F.lit(True), 12, 200).collect()
        assert sorted(r.doc_id for r in rows) == [i for i in range(6) if i != long]
        assert sum(r.weight for r in rows) == 6


def test_swap_penalty_takes_weight_off_group_terms():
    r = random.Random(1)
    filler = ["the", "house", "was", "there", "with", "some", "trees", "and", "water"]
    def sentence(words):
        return " ".join([*r.choices(filler, k=8), *words]) + "."
    texts, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        term = ["women"] if r.random() < (0.8 if toxic else 0.1) else ["men"] if r.random() < 0.5 else []
        texts.append(sentence(term + (["vileword"] if toxic else [])))
        labels.append(int(toxic))
    y, weight = np.array(labels), np.ones(300)

    def gap(penalty):
        w, b = toxicity.train(texts, y, weight, swap_penalty=penalty, l1=1e-4)
        logit = lambda t: w[toxicity.feature_set(t)].sum() + b
        return abs(logit("the house of the women was there.") - logit("the house of the men was there.")), logit("some vileword there.") - logit("some water there.")

    plain, fair = gap(0.0), gap(20.0)
    assert fair[0] < 0.5 * plain[0] and fair[1] > 0


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, owner, y, w = r.standard_normal((7, 5)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1, 0, 1]), np.ones(3) / 3
    m = passages.Model(width=5, hidden=4, gate=3)
    loss = lambda: float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * m.logits(x, owner, 3))).sum())
    grads = m.step_gradients(x, owner, y, w)
    for name, g in grads.items():
        p = m.p[name] = m.p[name].astype(np.float64)
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-3), name


# --- 4 ---------------------------------------------------------------------


def test_simhash_against_all_pairs(spark):
    rows = simhash.op4_simhash(spark, MEDIUM).collect()
    fp = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    root = simhash.forest(a, b, len(fp))
    least: dict = {}
    for r, i in zip(root, ids):
        least[r] = min(least.get(r, i), i)
    assert [least[r] for r in root] == [r.component_id for r in rows]


def test_fingerprint_of_plain_cases():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Only  TWO") == xxhash.xxh64_intdigest(b"only two", 42)
    assert simhash.fingerprint("İ É b") == xxhash.xxh64_intdigest("İ É b".encode(), 42)


def test_large_cells_are_dealt_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(50)}
    for _ in range(400):  # one dense group, linked through its members
        values.add(r.choice(sorted(values)[:20]) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4]))))
    fp = np.array(sorted(values), np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    edges = simhash.link_edges(nodes).collect()
    place = {int(v): i for i, v in enumerate(fp.view(np.int64))}
    got = simhash.forest(np.array([place[e.u] for e in edges]), np.array([place[e.v] for e in edges]), len(fp))
    want = simhash.forest(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3), len(fp))
    assert (got == want).all()


def test_embedding_bounds_the_bit_distance(spark):
    r = random.Random(3)
    rows = [(r.getrandbits(64) - 2**63, r.getrandbits(64) - 2**63) for _ in range(200)] + [(0, -1)]
    d = spark.createDataFrame(rows, "a long, b long").selectExpr("bit_count(a ^ b) AS bits", f"bit_count({simhash.embedding('a')} ^ {simhash.embedding('b')}) AS counts")
    assert all(x.counts <= x.bits for x in d.collect())


def test_simhash_edge_cases(spark):
    rows = simhash.near_duplicates(documents(spark, EDGE)).collect()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert len(rows) == len(EDGE) and by[(1, "0" * 16)] == by[(3, "0" * 16)] == by[(None, "0" * 16)] == 1
    kept = simhash.one_of_each(documents(spark, EDGE))
    assert kept.columns == documents(spark, EDGE).columns and kept.where("doc_id = 4").count() == 1
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_of_each_component_with_null_and_repeated_ids(spark):
    """Distinct texts without an id, one id on two texts, copies of a text
    that has an id elsewhere, and rows that are repeated whole."""
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (9, texts[3]), (9, texts[4]), (3, texts[5]), (3, texts[5]), (9, texts[5]), (3, texts[6]), (4, texts[6]), (None, texts[7]), (9, texts[7])]
    want = {(None, texts[0]), (None, texts[1]), (5, texts[2]), (9, texts[3]), (9, texts[4]), (3, texts[5]), (3, texts[6]), (9, texts[7])}
    for parts in (1, 5):
        kept = [(r.doc_id, r.text) for r in simhash.one_of_each(documents(spark, rows).repartition(parts)).collect()]
        assert len(kept) == len(want) and set(kept) == want


# --- 8 ---------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    model = pieces.default_model()
    lib = pieces.processor(model)
    r = random.Random(4)
    bits = ["a", "b", " ", "  ", "▁", "é", "é", "\n", "\t", "the", "tion", "日本", "\U0001f600", "\x00", ".", "<s>", "1", "  \n", "ﬁ"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(500)] + [t or "" for _, t in EDGE]
    small = pieces.ChunkTable(model, 40)  # forces the table to start anew
    for a in range(0, len(texts), 20):
        off, ids = small.encode(texts[a : a + 20])
        assert [list(ids[x:y]) for x, y in zip(off, off[1:])] == lib.encode(texts[a : a + 20])
    rows = pieces.digests(documents(spark, list(enumerate(texts)))).collect()
    for row in rows:
        ids = lib.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pieces_edge_cases(spark):
    rows = pieces.digests(documents(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert pieces.digests(documents(spark, [])).count() == 0


# --- 9 ---------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


CHECKS = {
    "email": lambda s: True,
    "ip": personal.octets,
    "card": lambda s: 13 <= len(personal.digits(s)) <= 19 and personal.luhn(personal.digits(s)),
    "phone": lambda s: 9 <= len(personal.digits(s)) <= 15,
}


def plain_matches(text):
    """Matches of the contract's patterns, before their checks."""
    return {(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text)}


def test_base_spans_are_the_matches_that_pass(spark):
    r = random.Random(5)
    bits = ["1", "25", "0", ".", "@", "a", "b.c", "+", " ", "-", "(", ")", "é", "%", "_", "4111111111111111", "+1 (229) 555-4838", "300", "\n"]
    for _ in range(5000):
        t = "".join(r.choices(bits, k=r.randint(0, 25)))
        assert set(personal.base_spans(t)) == {(k, a, b) for k, a, b in plain_matches(t) if CHECKS[k](t[a:b])}, t
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.octets("255.0.00.1") and not personal.octets("256.1.1.1") and not personal.octets("1000.1.1.1")


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@a" * 100_000, "+1" + " " * 200_000, "+1 " * 60_000):
        personal.graph(t)


def test_beliefs_equal_enumeration_on_a_tree():
    r = np.random.default_rng(1)
    u, pot = r.standard_normal((4, 3)), r.standard_normal((1, 3, 3))
    edges = np.array([[0, 1], [1, 2], [1, 3]])
    p = np.zeros((4, 3))
    for code in range(81):
        y = [code // 3**i % 3 for i in range(4)]
        score = np.exp(sum(u[i, y[i]] for i in range(4)) + sum(pot[0, y[a], y[b]] for a, b in edges))
        for i in range(4):
            p[i, y[i]] += score
    got = personal.beliefs(u, edges, pot, np.zeros(3, int), rounds=30)
    assert got == pytest.approx(p / p.sum(1, keepdims=True), abs=1e-6)


def test_a_repeated_number_takes_the_label_of_its_full_form(spark):
    t = "Call +1 (229) 555-4838 now. Some text here. Later dial 555-4838 or 555-4838. The year 1999 and 555-9999."
    model = personal.count_potentials(table(spark, MEDIUM, "documents"))
    spans = personal.spans_of(t, *model, 0.9)
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in spans] == [("phone", "+1 (229) 555-4838"), ("phone", "555-4838"), ("phone", "555-4838")]


def test_edges_count_in_texts_without_a_base_span():
    """Two mentions of a number that alone is not sure: the field decides, as
    it does with an unrelated address in the text."""
    t = "Dial 555-4838 today. More words stand here. Or 555-4838 later."
    signs = set(personal.graph(t)[4])
    k = len(personal.LABELS)
    weak = np.log([0.4 if i == 0 else 0.3 if i == personal.LABELS.index("phone") else 0.1 for i in range(k)])
    unary = {"": weak, **{s: weak for s in signs}}
    skip = np.full((k, k), -8.0)
    skip[0, 0], skip[4, 4] = 0.0, 8.0
    chain = np.zeros((k, k))
    added = lambda x: [(s["kind"], x[s["start"] : s["end"]]) for s in personal.spans_of(x, unary, chain, skip, 0.9) if not s["base"]]
    assert added(t) == [("phone", "555-4838")] * 2 == added(t + " Some words, then a.b@c.de too.")
    assert added("Dial 555-4838 today.") == []


def test_personal_data_edge_cases(spark):
    d = documents(spark, [*EDGE, (20, "mail \U0001f600 a.b@c.de, x"), (21, "nothing 1999 here")])
    rows = {r.doc_id: r for r in personal.find_spans(d).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[20].pii] == [("email", 7, 15)] and rows[21].pii == [] and rows[1].pii == []
    masked = {r.doc_id: r.text for r in personal.masked(d).collect()}
    assert masked[20] == "mail \U0001f600 <EMAIL>, x" and masked[1] is None and masked[21] == "nothing 1999 here"
    assert personal.find_spans(documents(spark, [])).count() == 0


# --- 10 --------------------------------------------------------------------


def brute_removed(rows, length=50):
    first: dict = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                m[i : i + length] = True
        out.append((d, len(b), int(m.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_suffix_dedup_against_brute_force(spark):
    d = table(spark, SMALL, "documents").select("doc_id", "text")
    assert removed(suffixes.remove_repeats(d)) == brute_removed([tuple(r) for r in d.collect()])


def test_suffix_dedup_of_made_texts(spark):
    r = random.Random(6)
    base = "".join(r.choices("abcd ", k=400))
    rows = [(i, "".join(r.choices(["ab" * 30, "xy", base[a : a + 70], base, "q" * 80, "é" * 30], k=4))) for i, a in enumerate(r.choices(range(330), k=60))] + EDGE[:7]
    d = documents(spark, rows).repartition(5)
    assert removed(suffixes.remove_repeats(d)) == brute_removed(rows)
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot_load", [0, 60])
def test_suffix_dedup_of_a_phrase_with_many_surroundings(spark, hot_load):
    """All buckets cut into windows, and some of them."""
    r = random.Random(8)
    phrase = "licensed under the same terms as all the others "
    rows = [(i, "".join(r.choices("abc", k=r.randint(0, 60))) + phrase[: r.choice([20, 40, 48])] + str(i % 7) * r.randint(0, 40)) for i in range(300)]
    rows += [(i + 300, "".join(r.choices("defgh ", k=200))) for i in range(40)] + EDGE[:7]
    d = documents(spark, rows).repartition(5)
    assert removed(suffixes.remove_repeats(d, hot_load=hot_load)) == brute_removed(rows)


def test_deep_shallow_sort():
    r = random.Random(7)
    for _ in range(200):
        base = bytes(r.choices(b"ab", k=40))
        strings = [r.choice([bytes(r.choices(b"ab\0", k=r.choice([0, 1, 8, 24, 30]))), base[: r.randint(0, 40)], base[:26] + bytes(r.choices(b"ab", k=9))]) for _ in range(r.randint(1, 40))]
        group = np.array([r.randint(0, 3) for _ in strings])
        order, lcp = suffixes.deep_shallow(group, strings)
        got = [(group[i], strings[i]) for i in order]
        assert got == sorted(got)
        assert [(-1 if x[0] != y[0] else len(os.path.commonprefix([x[1], y[1]]))) for x, y in zip(got, got[1:])] == list(lcp[1:])


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from proofloom.llm.common import cut

    docs = first = table(spark, MEDIUM, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, MEDIUM), "test")
        if name != "sentencepiece":
            assert docs.columns == first.columns
        if name == "simhash near-dedup":
            left = simhash.near_duplicates(docs)
            all_of = simhash.near_duplicates(before)
            assert docs.count() == all_of.select("component_id").distinct().count() == left.count()
        if name == "personal data":
            assert docs.where("text RLIKE '[a-z]@[a-z]+[0-9][.]example'").count() == 0 and docs.count() == before.count()
    row = docs.orderBy("doc_id").first()
    assert row.decoded == before.where(before.doc_id == row.doc_id).first().text and row.n_tokens == len(row.ids)


# --- further cases ---------------------------------------------------------


@pytest.mark.parametrize("length", [24, 140, 200])
def test_suffix_dedup_of_long_strings(spark, length):
    """Records longer than 255 bytes, and ids on several texts."""
    r = random.Random(length)
    parts = ["".join(r.choices("abcd ", k=300)) for _ in range(4)]
    rows = [(i, "".join(r.choices(parts, k=2)) + str(i)) for i in range(30)] + [(5, parts[0]), (5, "x" + parts[1]), (None, parts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first: dict = {}
    got = removed(suffixes.remove_repeats(df, length=length))
    want = brute_removed(rows, length)
    assert first == {} and got == want


def test_bases_walk_the_runs_of_repeated_ids():
    names = np.array([3, 1, 3, 2, 3, 1], np.int64)
    assert suffixes.bases(names, ["b", "x", "a", "y", "b", "x"]).tolist() == [2, 0, 0, 0, 2, 0]
    many = np.repeat(np.arange(40_000), 2)
    texts = [f"t{i % 2}" for i in range(80_000)]
    assert suffixes.bases(many, texts).tolist() == [3 * (i % 2) for i in range(80_000)]


def test_the_sample_does_not_depend_on_layout(spark):
    rows = [(i % 20, f"text {i} " + "x" * (i % 7)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    d = documents(spark, rows)
    samples = [sorted((r.doc_id, r.text) for r in sampling.labelled_sample(d.repartition(n), labels, "toxic", F.lit(True), 20, 10_000).collect()) for n in (1, 3, 7, 13)]
    assert len(samples[0]) == 20 and all(s == samples[0] for s in samples)


def test_swaps_found_in_the_sample():
    """Words of equal contexts that do not tell the classes apart, with case
    and plural kept; a swapped held-out sentence then moves less."""
    r = random.Random(4)
    def sentence(toxic):
        who = r.choice(["Blorg", "Frin", "Quam"] if toxic and r.random() < 0.6 else ["Blorg", "Frin", "Quam", "Tiv"])
        return f"The {who} went to the {r.choice(['house', 'garden', 'river'])} with many {r.choice(['trees', 'stones', 'birds'])}" + (" you vileword." if toxic else " and rested.")
    labels = np.array([int(i % 4 == 0) for i in range(400)])
    texts = [sentence(y) for y in labels]
    found = toxicity.found_terms(texts, labels, share=0.02)
    assert "frin" in found and set(found["frin"]) <= {"blorg", "quam", "tiv"} and "vileword" not in found
    assert all(not o.endswith("s") for o in found["house"]) and all(o.endswith("s") for o in found["trees"])
    pairs = toxicity.rewrites("The Frin rested. MEN met women.", {**toxicity.LISTED, **found})
    assert any(b.split()[1] in ("Blorg", "Quam", "Tiv") for _, b in pairs) and any(b.startswith(("WOMEN", "GIRLS", "BOYS")) for _, b in pairs)
    moved = []
    for penalty in (0.0, 20.0):
        w, b = toxicity.train(texts, labels, np.ones(400), swap_penalty=penalty, l1=1e-4)
        logit = lambda t: w[toxicity.feature_set(t)].sum()  # noqa: E731, B023
        moved.append(max(abs(logit(x) - logit(y)) for x, y in toxicity.rewrites("The Tiv went to the house with many birds and rested.", found)))
    assert moved[1] < 0.5 * moved[0]


def test_swap_pairs_of_the_table(spark):
    """The given documents give pairs: the penalty has rows."""
    d, y = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = sampling.labelled_sample(d, y, "toxic", F.lit(True), 3000, 10_000_000).collect()
    assert len(toxicity.swap_pairs([r.text for r in rows], np.array([r.label for r in rows]))) > 100


def test_scores_equal_a_direct_sum(spark):
    """The toxicity score of each document against the sum of the weights of
    its distinct features."""
    d, y = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    w, b = toxicity.fit(d, y, F.lit(True))
    direct = lambda t: 1 / (1 + np.exp(-(b + w[toxicity.feature_set(t or "")].sum())))
    rows = d.select("text", toxicity.score_column(F.col("text"), w, b).alias("s")).collect()
    assert rows and all(abs(r.s - direct(r.text)) < 1e-5 for r in rows)


def test_fingerprints_are_bit_majorities(spark):
    import xxhash

    d = table(spark, SMALL, "documents").select("doc_id", "text")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(d, 3).collect()}
    for r in d.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        assert got[r.doc_id] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_personal_data_columns_of_the_table(spark):
    """The query's base columns against the plain patterns, and more than one
    added span on the given table."""
    texts = {r.doc_id: r.text or "" for r in table(spark, MEDIUM, "documents").collect()}
    rows = personal.op9_personal_data(spark, MEDIUM).collect()
    added = 0
    for r in rows:
        t = texts[r.doc_id]
        base = sorted((s for s in plain_matches(t) if CHECKS[s[0]](t[s[1] : s[2]])), key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        every = [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(every)
        for s in set(every) - {f"{k}:{a}:{b}" for k, a, b in base}:
            k, a, b = s.split(":")
            added += 1
            assert k != "secret" or len(t[int(a) : int(b)]) >= 16
    assert added > 1


def test_a_secret_is_one_wherever_it_stands(spark):
    model = personal.count_potentials(table(spark, MEDIUM, "documents"))
    key = "9f14a7029c8514dfe98aba92898d323168e199da"
    t = f'Set token = "{key}" here. Some words. Then send {key} again. The password: short1. A name=value.'
    spans = personal.spans_of(t, *model, 0.9)
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in spans] == [("secret", key)] * 2 and not any(s["base"] for s in spans)


def test_columns_named_like_working_columns_come_back(spark):
    from proofloom.llm import licenses, mixing

    clash = {c: F.lit(f"mine {c}") for c in ("_h", "_t", "_w", "_blocks", "_doc", "_salt", "_of", "_pii", "_row", "_size", "_mix_row", "_mix_words", "row", "s", "start", "spans", "key")}
    d = documents(spark, [(1, "Released under the MIT License, mail a.b@c.de"), (2, "Released under the MIT License, mail a.b@c.de"), (3, "other words " * 40)]).withColumns(clash)
    for out in (licenses.scan(d), personal.masked(d), simhash.one_of_each(d), mixing.mixed_documents(d)):
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in clash)


def test_the_mix_gives_equal_rows_their_own_words(spark):
    """Rows without an id, and equal rows: the words that the mix takes are the
    words that the documents hold."""
    from proofloom.llm import mixing

    rows = [(i if i % 12 < 7 else None, f"word{i % 9} " * (30 + i % 9)) for i in range(240)] + [(None, "same words here " * 20)] * 40 + [(3, "same words here " * 20)] * 5
    d = documents(spark, rows).withColumn("source", F.when(F.length("text") % 2 == 0, "a").otherwise("b"))
    documents_, picks = mixing.mix(d)
    want = mixing.overlaps(documents_, picks).agg(F.sum((F.col("high") - F.col("low")) * F.col("times"))).first()[0]
    out = mixing.mixed_documents(d)
    assert out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == want
    assert mixing.taken_words(d).agg(F.sum("taken")).first()[0] == want and mixing.taken_words(d).count() == len(rows)


def test_the_license_oracle_agrees_on_wrapped_notices(spark):
    import duckdb

    from proofloom.llm import licenses

    rows = [(1, "Redistribution and use in source\nand binary forms, with or\n without modification, are permitted provided\nthat the following conditions are met:"),
            (2, "Released\nunder the\nMIT License"), (3, "released words under more words the mit and then license"), (4, "x " * 50 + "all rights reserved, copyright"), (5, None), (6, "cc by, GNU general\npublic LICENSE")]
    rows += [(10 + i, rows[0][1]) for i in range(20)]
    import tempfile

    path = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    cur = con.execute(licenses.ORACLES["op5_license_scan"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in names) for r in licenses.op5_license_scan(spark, path).collect()), key=str)
    assert got == want and any("notice:bsd" in r[names.index("labels")] for r in got)


def test_quality_scores_equal_the_formula_text_by_text(spark):
    """Each text alone, its gated attention written out passage by passage,
    against the scores of the whole table."""
    d, y = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model, constant = passages.fit(d, y, F.lit(True))
    p = model.p

    def score(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x, owner = passages.encode(raw, np.array([0, len(raw)]))
        assert len(x) and not owner.any()
        h = [np.tanh(np.clip((row - model.mean) / model.dev, -6, 6) @ p["W"] + p["b"]) for row in x]
        e = [float(p["u"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"]))))) for v in h]
        share = np.exp(np.array(e) - max(e))
        bag = sum(s * v for s, v in zip(share / share.sum(), h))
        return 1 / (1 + np.exp(-float(bag @ p["c"] + p["d"][0])))

    rows = d.select("text", passages.score_column(F.col("text"), model, constant).alias("s")).collect()
    assert len(rows) > 100 and all(abs(r.s - score(r.text)) < 1e-4 for r in rows)


def test_masking_takes_one_python_step(spark):
    """Two steps in a row would hold two Python workers in every task slot."""
    d = documents(spark, [(1, "mail a.b@c.org now"), (2, None), (3, "none")])
    out = personal.masked(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail <EMAIL> now", 2: None, 3: "none"}


def test_a_batch_of_long_texts_is_encoded_in_small_runs(spark, monkeypatch):
    model = pieces.default_model()
    texts = ["word " * 60_000, None, "", "a b", *["some words " * 30_000] * 4]
    lib, seen = pieces.processor(model), []
    encode, decode = pieces.ChunkTable.encode, lib.decode
    monkeypatch.setattr(pieces.F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    monkeypatch.setattr(pieces.ChunkTable, "encode", lambda self, t: (seen.append(t), encode(self, t))[1])
    ids = pieces.encode_column(F.lit(""), model)(pa.array(texts))
    assert max(sum(map(len, t)) for t in seen) <= pieces.RUN_BYTES and sum(map(len, seen)) == len(texts)
    assert ids.to_pylist() == [lib.encode(t or "") for t in texts]
    told = []
    monkeypatch.setattr(lib, "decode", lambda x, **o: (told.append(x), decode(x, **o))[1])
    assert pieces.decode_column(F.lit(None), model)(ids).to_pylist() == [decode(x) for x in ids.to_pylist()]
    assert max(sum(map(len, x)) for x in told) <= pieces.RUN_IDS
