"""Dedup, validation aggregates (2.3) and row checks (2.2)."""

import hashlib

from pyspark.sql import functions as F

from proofloom.operators import checks as CK
from proofloom.operators import profile as PF


def test_duplicates_flag_all_members(spark):
    df = spark.createDataFrame(
        [("a", "x  y"), ("b", "x y"), ("c", "z"), ("a", "w"), ("d", " x\ty ")], "id string, text string"
    )
    dups = sorted(r.id for r in PF.duplicate_content_items(df, "text").collect())
    assert dups == ["a", "b", "d"]
    assert [r.id for r in PF.duplicate_ids(df).collect()] == ["a"]
    s = PF.duplicate_summary(df, "text").first()
    assert (s.total_items, s.unique_ids, s.n_duplicate_ids, s.n_duplicate_content_items) == (5, 4, 1, 3)
    h = {r.id: r.hash for r in PF.with_hash(df, "text").collect() if r.id == "b"}
    assert h["b"] == hashlib.sha256(b"x y").hexdigest()[:16]


def test_verification_early_stop(spark):
    rows = [(i, i, i % 2 == 0, None if i % 2 == 0 else f"err {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, seq int, ok boolean, stderr string")
    kept = sorted(r.id for r in PF.verification_early_stop(df, max_failures=3).collect())
    assert kept == [0, 1, 2, 3, 4, 5]  # up to and including the 3rd failure (id 5)
    s = PF.verification_summary(PF.verification_early_stop(df, 3)).first()
    assert (s.total_checked, s.successful, s.failed) == (6, 3, 3) and s.success_rate == 0.5
    few = PF.verification_early_stop(df.where("id < 4"), max_failures=3)
    assert few.count() == 4
    empty = PF.verification_summary(df.where("id < 0")).first()
    assert empty.success_rate == 0.0 and empty.total_checked == 0


def test_verification_rows_exception_row(spark):
    items = spark.createDataFrame([(1, 1), (2, 2)], "id int, seq int")
    verdicts = spark.createDataFrame([(1, False, "boom")], "id int, ok boolean, stderr string")
    rows = {r.id: r for r in PF.verification_rows(items, verdicts, "id").collect()}
    assert rows[1].stderr == "boom" and not rows[1].ok
    assert rows[2].stderr.startswith("Exception during compilation")


def test_row_checks(spark):
    df = spark.createDataFrame(
        [
            ("ok_1", ["a valid step"], "theorem x : True := trivial"),
            ("", ["a valid step"], "  lemma y"),
            ("a.b-c_d", ["   ", "valid step"], "theorem z"),
            ("__", ["abc"], ""),
            ("ab\n", [], "theoremx"),
        ],
        "id string, steps array<string>, theorem string",
    )
    ok, bad = CK.quarantine(df)
    assert [r.id for r in ok.collect()] == ["ok_1"]
    v = {r.id: r.violations for r in bad.collect()}
    assert v[""] == ["ID cannot be empty"]
    assert v["a.b-c_d"] == ["Step 1 cannot be empty"]
    assert v["__"] == ["Step 1 is too short: 'abc'", "Theorem cannot be empty", "Invalid ID format: '__'"]
    assert v["ab\n"] == ["English proof must have at least one step", "Theorem must start with 'theorem' or 'lemma'", "Invalid ID format: 'ab\n'"]


def test_grouping_sets(spark):
    df = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a")], "file string, topic string")
    rows = {(r.file, r.topic): r.n for r in PF.topic_distribution_by_file(df).collect()}
    assert rows == {("f1", "a"): 1, ("f1", "b"): 1, ("f2", "a"): 1, (None, "a"): 2, (None, "b"): 1, (None, None): 3}


def test_cross_file_duplicates(spark):
    pooled = spark.createDataFrame(
        [(1, "a  b", "f1"), (2, "c", "f1"), (1, "z", "f2"), (3, "a b", "f2"), (4, "c", "f1")],
        "id int, text string, file string",
    )
    rows = {(r.kind, r.key): (r.n_items, r.files) for r in PF.cross_file_duplicates(pooled).collect()}
    assert rows[("id", "1")] == (2, "f1,f2")
    assert rows[("content", hashlib.sha256(b"a b").hexdigest()[:16])] == (2, "f1,f2")
    assert rows[("content", hashlib.sha256(b"c").hexdigest()[:16])] == (2, "f1")
    assert len(rows) == 3


def test_null_texts_and_ids_repeat_nothing(spark):
    """Ten items without a text are no copies, within a set or across files."""
    rows = [(f"i{k}", None, "t" if k else None) for k in range(10)]
    df = spark.createDataFrame(rows, "id string, text string, topic string")
    s = PF.duplicate_summary(df, "text").first()
    assert (s.total_items, s.unique_ids, s.n_duplicate_ids, s.n_duplicate_content_items) == (10, 10, 0, 0)
    assert PF.dataset_verdict(PF.validate_dataset(df, "text")).first().is_valid
    pooled = df.select(F.when(F.col("id") < "i5", F.col("id")).alias("id"), "text", F.lit("f").alias("file"))
    assert PF.cross_file_duplicates(pooled).count() == 0
    assert PF.duplicate_content_items(df, "text").count() == 0


def test_findings_come_from_one_scan(spark, tmp_dir):
    rows = [("a", "x y", "t"), ("b", "x  y", "u"), ("a", "z", "t"), (None, None, None), (None, "w", None)]
    path = f"{tmp_dir}/items"
    spark.createDataFrame(rows, "id string, text string, topic string").write.parquet(path)
    found = PF.findings(spark.read.parquet(path), "text")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    h = hashlib.sha256(b"x y").hexdigest()[:16]
    assert {(r.key, r.n) for r in PF.repeated(found, "id").collect()} == {("a", 2), (None, 2)}
    assert {(r.key, r.n) for r in PF.repeated(found, "content").collect()} == {(h, 2)}
    assert {(r.topic, r.n) for r in PF.topics(found).collect()} == {("t", 2), ("u", 1), (None, 2)}
    report = {(r.section, r.key): r.n for r in PF.report_rows(found).collect()}
    assert report[("total_items", None)] == 5 and report[("unique_ids", None)] == 3 and report[("duplicate_content", h)] == 2
    assert report[("n_topics", None)] == 2 and report[("topics", None)] == 2 and report[("duplicate_ids", "a")] == 2
    assert PF.report_rows(PF.findings(spark.read.parquet(path).limit(0), "text")).where("n <> 0").count() == 0


def test_repeated_verdicts_give_one_row_per_item(spark):
    items = spark.createDataFrame([(k, k, "mine") for k in range(9)] + [(None, 9, "mine")], "id int, seq int, _ok string")
    verdicts = spark.createDataFrame([(k, True, None) for k in range(9)] + [(3, False, "late"), (None, True, None)], "id int, ok boolean, stderr string")
    rows = PF.verification_rows(items, verdicts, "id").collect()
    assert len(rows) == 10 and {r._ok for r in rows} == {"mine"}
    by = {r.id: r for r in rows}
    assert (by[3].ok, by[3].stderr) == (False, "late") and by[2].ok and not by[None].ok


def test_quarantine_checks_once(spark):
    """Both frames come from one written pass; every row is in one of them."""
    rows = [("ok_1", ["a valid step"], "theorem x : True", "mine"), (None, None, None, "mine"), ("ok_1", ["a valid step"], "theorem x : True", "mine")]
    df = spark.createDataFrame(rows, "id string, steps array<string>, theorem string, _accepted string")
    ok, bad = CK.quarantine(df)
    assert ok.count() == 2 and bad.count() == 1 and ok.columns == df.columns and bad.columns == [*df.columns, "violations"]
    assert {r._accepted for r in ok.collect() + bad.collect()} == {"mine"} and len(bad.first().violations) == 3
    empty = CK.quarantine(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0
