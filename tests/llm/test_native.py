"""Operators 1, 5, 6 and 7: SQL oracles and edge cases."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from pyspark.sql import functions as F  # noqa: E402

from proofloom.llm import catalog, licenses, mixing, quality_rules, topk  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "y") for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, name):
    from oracle_check import compare, duck

    message, same = compare(spark, duck(SMALL), name, catalog.queries()[name], catalog.oracles()[name], SMALL)
    assert same, message


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_license_scan", "op7_mixing"])
def test_native_plans_hold_no_python(spark, name):
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h " * 4), (4, "a b c d e f g h " * 4), (None, "word " * 30), (6, "x" * 300_000)]


def test_quality_counts_of_edge_cases(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.counts(documents(spark, EDGE)).collect()}
    assert rows[(1, 0)].n_repeat_words == 0 and rows[(3, 0)].n_lines == 0
    assert rows[(4, 32)].n_repeat_words == 32
    assert rows[(6, 1)].word_chars == 300_000


def test_quality_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(documents(spark, EDGE), none)
    assert judged.count() == len(EDGE) and judged.where("kept = base_failed").count() == 0
    assert quality_rules.judge(documents(spark, []), none).count() == 0


def test_binomial_tail(spark):
    from math import comb

    rows = spark.range(1).select(*[quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.1).alias(f"a{n}_{k}") for n, k in ((10, 0), (50, 3), (400, 30))]).first()
    for n, k in ((10, 0), (50, 3), (400, 30)):
        assert rows[f"a{n}_{k}"] == pytest.approx(sum(comb(n, j) * 0.1**j * 0.9 ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_a_cutoff_that_rejects_good_documents_is_never_chosen(spark):
    rows = [("en", i, 0, 0, 60 if i % 5 == 0 else 0, 0, 0) for i in range(3000)]
    good = spark.createDataFrame(rows, "stratum string, doc_id long, symbols long, dup_lines long, repeats long, capitals long, marks long")
    cut = quality_rules.cutoffs(good).first()
    assert cut.cut_symbols == 5 and cut.cut_repeats == 75  # a fifth of the good rows hold 60


def test_license_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "CC BY cc by\nMITé License"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, "the work is under License, licensed by this")]
    s = licenses.scan(documents(spark, texts))
    rows = {}
    for r in s.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].n_words == 0 and rows[1][0].notices == []
    assert [p.start for p in rows[3][0].base_places] == [0, 2]
    assert len(rows[4]) == 2 and [n.label for n in rows[4][0].notices] == ["notice:mit"]
    assert rows[5][0].notices == [] and "fp" in s.columns
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_notices_over_lines_and_in_long_lines(spark):
    """Wrapped notices are found wherever they begin; scattered words of one
    long line are no notice."""
    notice = dict(licenses.TEMPLATES)["notice:bsd"].split()
    wrapped = "\n * ".join(" ".join(notice[i : i + 8]) for i in range(0, len(notice), 8))
    far = " ".join(["word"] * 60)
    scattered = f" {far} ".join(["released", "under", "the", "mit", "license", "copyright", "all", "rights", "reserved"])
    texts = [(1, wrapped), (3, scattered), (4, f"{far} {scattered} {far} Released under the MIT License. {far}")]
    texts += [(100 + n, " ".join(["word"] * n) + "\n" + wrapped + "\n" + far) for n in range(0, 61, 5)]
    found = {r.doc_id: [(n.label, n.containment) for n in r.notices] for r in licenses.scan(documents(spark, texts)).collect()}
    assert found[3] == [] and found[4] == [("notice:mit", 1.0)]
    for i, notices in found.items():
        if i not in (3, 4):
            assert max(notices) == ("notice:bsd", 1.0) and {n for n, _ in notices} == {"notice:bsd"}, i


def test_top_k_ties_bad_vectors_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [float("nan"), 1.0]), (9, None), (10, [1.0, None]), (11, [2.0]), (None, [5.0, 5.0]), (12, [3e30, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = topk.top_k(v.where("vec_id % 50 = 0"), v, 2, block_rows=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 12), (0, 2, 7), (50, 1, 12), (50, 2, 0)]
    assert found[0].score == 2**63 - 1 and found[1].score == 256 * 256
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_counts_every_row_as_the_oracle_does(spark, tmp_path):
    """Copies of the best row in one block, alone and on a repeated query."""
    from oracle_check import compare, duck

    spread = [[1.0, i / 100] for i in range(40)]
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [-1.0, 0.5])]
    rows += [(7, [3.0, 3.0])] * 3 + [(7, [3.0, 2.0])] * 2 + [(i + 200, x) for i, x in enumerate(spread)]
    folder = str(tmp_path)
    for name in os.listdir(SMALL):
        if name != "embeddings.parquet":
            os.symlink(os.path.join(SMALL, name), os.path.join(folder, name))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/made")
    part = next(f for f in os.listdir(f"{folder}/made") if f.startswith("part-"))
    os.symlink(f"{folder}/made/{part}", f"{folder}/embeddings.parquet")
    message, same = compare(spark, duck(folder), "op6_exact_top_k", topk.op6_exact_top_k, topk.ORACLE, folder)
    assert same, message
    v = topk.quantised(spark.createDataFrame([(0, [1.0, 0.0]), *[(1, [9.0, 0.0])] * 5, *[(i, [float(i % 4), 1.0]) for i in range(2, 30)]], "vec_id long, embedding array<float>"))
    found = topk.top_k(v.where("vec_id = 0"), v, 6).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in found] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 3)]


def test_mix_targets_bounds_and_reruns(spark):
    texts = [(i, "w " * (1 + i % 90)) for i in range(400)]
    d = documents(spark, texts, "a").unionByName(documents(spark, [(1000 + i, "v " * 40) for i in range(30)] + [(2000, None), (None, "u u u")], None))
    rows = mixing.taken_words(d, block_words=8).collect()
    assert len(rows) == 432 and all(r.taken <= 3 * r.size for r in rows)
    for target in {r.target for r in rows}:
        own = [r for r in rows if r.target == target]
        assert sum(r.taken for r in own) == pytest.approx(target, abs=32)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(rows, key=key) == sorted(mixing.taken_words(d.repartition(7), block_words=8).collect(), key=key)
    assert mixing.taken_words(documents(spark, [])).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    d = documents(spark, [(i, f"w{i} " * 50) for i in range(60)], "a").unionByName(documents(spark, [(100 + i, f"v{i} " * 10) for i in range(20)], "b"))
    taken = {r.doc_id: r.taken for r in mixing.taken_words(d, block_words=8).collect()}
    mixed = mixing.mixed_documents(d, block_words=8)
    assert mixed.columns == d.columns
    assert {r.doc_id: len(r.text.split()) for r in mixed.collect()} == {k: n for k, n in taken.items() if n}


def test_permutation_is_one(spark):
    for n in (1, 2, 5, 10, 97):
        a = int(-(-(n**0.5) // 1))
        a += a * a < n
        x = [r.x for r in spark.range(a * a).select(F.expr(mixing.permuted("id", str(a), "12345", "div")).alias("x")).collect()]
        assert sorted(x) == list(range(a * a))
