"""Bulk retry rounds (2.7): golden records and invariants of the loop."""

import os

import pytest
from pyspark.sql import functions as F

from proofloom.operators import memo as MM
from proofloom.operators import rounds as RD
from stubs import StubChecker, StubModel, raising_checker_factory, stub_checker_factory, stub_model_factory

STATEMENTS = [f"statement number {i} about sets" for i in range(60)]


def _items(spark):
    rows = [(i, s, [f"use lemma {i}", "conclude"] if i % 4 else []) for i, s in enumerate(STATEMENTS)]
    return spark.createDataFrame(rows, "item_id int, statement string, steps array<string>")


#: Records (attempt, beam, compiled, ok) of some items, worked out once from
#: the loop's rules and kept as fixed values.
GOLDEN = {0: [(1, 0, False, False), (2, 0, True, True)],
 1: [(1, 0, False, False), (2, 0, False, False), (2, 1, True, True)],
 2: [(1, 0, True, False), (2, 0, True, True)],
 3: [(1, 0, True, True)],
 4: [(1, 0, True, False),
     (2, 0, False, False),
     (2, 1, False, False),
     (2, 2, False, False),
     (3, 0, False, False),
     (3, 1, False, False),
     (3, 2, False, False),
     (4, 0, False, False),
     (4, 1, False, False),
     (4, 2, False, False),
     (4, 3, True, False),
     (4, 4, False, False),
     (5, 0, True, False),
     (5, 1, False, False),
     (5, 2, False, False),
     (5, 3, False, False),
     (5, 4, False, False)],
 5: [(1, 0, True, True)],
 6: [(1, 0, True, False), (2, 0, False, False), (2, 1, True, False), (2, 2, True, True)],
 7: [(1, 0, False, False),
     (2, 0, True, False),
     (2, 1, True, False),
     (2, 2, True, False),
     (3, 0, False, False),
     (3, 1, False, False),
     (3, 2, False, False),
     (4, 0, True, False),
     (4, 1, False, False),
     (4, 2, False, False),
     (4, 3, False, False),
     (4, 4, False, False),
     (5, 0, True, False),
     (5, 1, True, True)]}


def test_rounds_give_the_golden_records(spark):
    sched = RD.RetrySchedule()
    res = RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched)
    got = {}
    for r in res.records.collect():
        got.setdefault(r.item_id, []).append((r.attempt, r.beam_index, r.compiled, r.compile_ok))
    for i, want in GOLDEN.items():
        assert sorted(got.get(i, [])) == want, i
    for i, records in got.items():
        records.sort()
        # nothing follows an item's first success, and without one every
        # slot of the schedule is tried
        assert not any(ok for *_, ok in records[:-1]), i
        assert records[-1][-1] or len(records) == sum(sched.beams), i
    ev = RD.rounds_item_results(res, _items(spark), sched).collect()
    assert len(ev) == len(STATEMENTS)
    for r in ev:
        if r.success:
            assert r.candidate_total == r.success_rank
    assert res.failed_items.count() == 0


def test_memo_reuse_across_runs(spark, tmp_dir):
    sched = RD.RetrySchedule.of(attempts=2)
    memo = f"{tmp_dir}/memo"
    a = RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched, memo_dir=memo, work_dir=f"{tmp_dir}/a")
    first = a.call_counts().first()
    for part in ("generation", "check"):  # one file per bucket and write
        assert any("_000" in f for f in os.listdir(f"{memo}/{part}") if f.startswith("part-"))
    b = RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched, memo_dir=memo, work_dir=f"{tmp_dir}/b")
    assert any(e["stage"] == "memo_lookup" for e in b.log)
    second = b.call_counts().first()
    assert first.generation_calls > 0 and first.check_calls > 0
    # the second run only repeats failed generation calls (kept out of the memo)
    failed_calls = spark.read.parquet(f"{memo}/generation").where(
        (F.col("run") == a.run_id) & F.col("gen_error").isNotNull()
    ).count()
    assert second.generation_calls == failed_calls and second.check_calls == 0
    key = ["item_id", "attempt", "beam_index", "compiled", "compile_ok"]
    assert sorted(map(tuple, a.records.select(key).collect())) == sorted(map(tuple, b.records.select(key).collect()))


def test_run_error_voids_item(spark):
    sched = RD.RetrySchedule()
    res = RD.retry_rounds(spark, _items(spark), stub_model_factory, raising_checker_factory, sched)
    failed = {r.item_id for r in res.failed_items.collect()}
    assert failed
    assert res.records.where(F.col("item_id").isin(list(failed))).count() == 0
    ev = {r.item_id: r for r in RD.rounds_item_results(res, _items(spark), sched).collect()}
    for i in failed:
        assert ev[i].success is False and ev[i].attempts == sched.attempts and ev[i].run_error


def test_a_second_run_into_the_same_folders_keeps_the_record_count(spark, tmp_dir):
    sched = RD.RetrySchedule.of(attempts=2)
    folders = {"memo_dir": f"{tmp_dir}/memo", "work_dir": f"{tmp_dir}/w"}
    n = [RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched, **folders).records.count() for _ in range(2)]
    assert n[0] == n[1]


def test_schedule_rules():
    assert RD.stretched([1, 3], 4) == (1, 3, 3, 3) and RD.stretched([1, 3, 5], 2) == (1, 3)
    for wrong in (lambda: RD.stretched([], 2), lambda: RD.RetrySchedule((1,), (0.3, 0.5)), lambda: RD.RetrySchedule((0,), (0.3,)),
                  lambda: RD.RetrySchedule((1,), (2.5,)), lambda: RD.RetrySchedule((), ()), lambda: RD.RetrySchedule((1,), (0.3,), 0)):
        with pytest.raises(ValueError):
            wrong()
    s = RD.RetrySchedule.of(attempts=7)
    assert s.beams == (1, 3, 3, 5, 5, 5, 5) and s.temperatures[-1] == 0.8


def test_slot_expand_seeds(spark):
    slots = RD.slot_expand(_items(spark).limit(1), RD.RetrySchedule()).collect()
    assert sorted((r.attempt, r.beam_index, r.seed) for r in slots)[:4] == [(1, 0, 100), (2, 0, 200), (2, 1, 201), (2, 2, 202)]
    assert len(slots) == 17


def test_memo_stats(spark):
    req = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",), ("c",)], "k string")
    memo = spark.createDataFrame([("c",), ("z",)], "k string")
    s = MM.memo_stats(req, "k", memo).first()
    assert (s.requests, s.hits, s.misses, s.size_before, s.size_after) == (6, 4, 2, 2, 4)
    assert s.hits + s.misses == s.requests
    e = MM.memo_stats(req.limit(0), "k").first()
    assert e.hit_rate == 0.0


def test_run_evaluation(spark, tmp_dir):
    import json
    import os

    from proofloom.operators.evaluate import run_evaluation

    path = os.path.join(tmp_dir, "items.jsonl")
    with open(path, "w") as f:
        for i, s in enumerate(STATEMENTS[:20]):
            f.write(json.dumps({"id": f"it_{i}", "topic": "t", "english": {"statement": s, "steps": ["step one here"]},
                                "lean": {"theorem": "theorem x : True := trivial"}}) + "\n")
    rep = run_evaluation(spark, path, stub_model_factory, stub_checker_factory, pass_k=(5, 1, 1), limit=12)
    m = rep.metrics.first()
    items = rep.items.collect()
    assert rep.pass_k == (1, 5) and m.total_items == 12 == len(items)
    assert m.success_count == sum(r.success for r in items)
    assert m.pass_at_5 >= m.pass_at_1 and m.compile_rate_at_1 == m.pass_at_1
    for r in items:
        assert (r.final_code is not None) == r.success
        assert r.pass_at_k == {1: r.pass_at_1, 5: r.pass_at_5}
        recs = r.candidate_records
        assert [(c.attempt, c.beam_index) for c in recs] == sorted((c.attempt, c.beam_index) for c in recs)
        assert len(recs) == (r.success_rank if r.success else len(recs))
        assert all(c.compile_ok is None for c in recs if not c.compiled)
        assert len(r.errors) == sum(1 for c in recs if c.compiled and not c.compile_ok and c.compile_stderr)
    out = os.path.join(tmp_dir, "report")
    rep.write(out)
    doc = json.loads("".join(open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-")))
    assert doc["config"]["max_attempts"] == 5 and doc["pass_k"] == [1, 5] and doc["dataset_path"] == path
    by_id = {i["id"]: i for i in doc["items"]}
    assert len(by_id) == 12 and all(len(by_id[r.id]["candidate_records"]) == len(r.candidate_records) for r in items)
    empty = os.path.join(tmp_dir, "empty.jsonl")
    open(empty, "w").close()
    with pytest.raises(ValueError, match="empty"):
        run_evaluation(spark, empty, stub_model_factory, stub_checker_factory)


def test_no_memo_repeats_calls(spark, tmp_dir):
    sched = RD.RetrySchedule.of(attempts=1)
    memo = f"{tmp_dir}/memo"
    a = RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched, memo_dir=memo, work_dir=f"{tmp_dir}/a")
    b = RD.retry_rounds(spark, _items(spark), stub_model_factory, stub_checker_factory, sched, memo_dir=memo,
                        work_dir=f"{tmp_dir}/b", use_memo=False)
    ca, cb = a.call_counts().first(), b.call_counts().first()
    assert cb.generation_calls == ca.generation_calls and cb.check_calls == ca.check_calls
    key = ["item_id", "attempt", "beam_index", "compiled", "compile_ok"]
    assert sorted(map(tuple, a.records.select(key).collect())) == sorted(map(tuple, b.records.select(key).collect()))


def test_a_memo_is_not_shuffled(spark, tmp_dir):
    """A lookup of many keys in a bucketed memo: the plan has no exchange above
    the memo's scan, and a second run computes new keys only."""
    memo = MM.BucketedMemo(spark, f"{tmp_dir}/m", "k", "k string, v long, err string, run string")
    work = lambda n: MM.work_list(spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k")), "k", memo.rows())
    keys = {n: work(n).count() for n in (0, 300)}
    assert keys == {0: 0, 300: 300}
    memo.add(work(300).select("k", F.lit(1).alias("v"), F.when(F.col("k") < "4", "failed").alias("err"), F.lit("one").alias("run")))
    memo.add(work(400).select("k", F.lit(2).alias("v"), F.lit(None).alias("err"), F.lit("two").alias("run")))
    assert memo.rows().count() == 400 and work(400).count() == 0
    memo.add(memo.rows().where("err = 'failed'").select("k", F.lit(3).alias("v"), F.lit(None).alias("err"), F.lit("three").alias("run")))
    requests = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = memo.lookup(requests, F.col("err").isNull(), ["run"])
        got = {r.k: r.v for r in hits.collect()}
        plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 400 and {v for k, v in got.items() if k < "4"} <= {2, 3} and sorted(set(got.values())) == [1, 2, 3]
    scan = next(i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789|"))
    above, d = [], depth(plan.splitlines()[scan])
    for line in reversed(plan.splitlines()[:scan]):
        if depth(line) < d:
            above.append(line)
            d = depth(line)
    assert above and not any("Exchange" in line or "ShuffleQueryStage" in line for line in above), above


def test_null_keys_lose_no_request(spark):
    """Four requests, two without a key: four rows, none of them a repeat of
    another, and the totals say the same."""
    req = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "z"), (4, None, "w")], "n int, k string, _first string")
    marked = {r.n: r for r in MM.mark_repeats(req, "k", ["n"]).collect()}
    assert {n: r.from_memo for n, r in marked.items()} == {1: False, 2: False, 3: True, 4: False} and marked[4]._first == "w"
    s = MM.run_stats(req, {"": "k"}).first()
    assert (s.requests, s.hits, s.misses, s.size_after) == (4, 1, 3, 1)
    memo = spark.createDataFrame([("a",), (None,)], "k string")
    t = MM.memo_stats(req, "k", memo).first()
    assert (t.requests, t.hits, t.misses, t.size_before, t.size_after) == (4, 2, 2, 1, 1)
    assert sorted(r.n for r in MM.work_list(req, "k", memo, ["n"]).collect()) == [2, 4]


def test_keys_are_whole_digests(spark):
    key = MM.generation_key(F.col("p"), seed=F.lit(1))
    rows = spark.createDataFrame([("a",), (None,)], "p string").select("p", key.alias("k"), MM.shown_key(key).alias("s")).collect()
    by = {r.p: r for r in rows}
    assert len(by["a"].k) == 129 and by["a"].s == by["a"].k[:16] + "_" + by["a"].k[65:81] and by[None].k is None


def test_repeated_replies_and_verdicts_give_one_row_each(spark):
    from proofloom.operators import batch as B

    work = spark.createDataFrame([(1, "q"), (2, "r"), (None, "s")], "k int, _reply string")
    replies = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "x")], "k int, reply string")
    got = {r.k: r for r in B.recorded_replies(work, replies, ["k"]).collect()}
    assert len(got) == 3 and (got[1].reply, got[1].gen_error, got[1]._reply) == ("a", None, "q")
    assert got[2].gen_error and got[None].gen_error
    codes = spark.createDataFrame([("c",), ("d",)], "content_key string")
    verdicts = spark.createDataFrame([("c", True, None), ("c", False, "z"), ("c", False, "y"), ("d", None, None)], "content_key string, ok boolean, stderr string")
    v = {r.content_key: r for r in B.recorded_verdicts(codes, verdicts).collect()}
    assert (v["c"].ok, v["c"].stderr, v["d"].ok, v["d"].check_error) == (False, "y", False, None)


def test_own_prompts(spark, tmp_dir):
    """A caller's prompt stands for the initial one, not for repairs."""
    rows = spark.createDataFrame([(1, "s", ["a"], " mine\n"), (2, "s", ["a"], "  "), (3, "s", [], None)], "item_id int, statement string, steps array<string>, own_prompt string")
    ctx = F.when(F.col("item_id") == 9, F.lit(None)).cast(RD.S.LEAN_ERROR)
    rows = rows.withColumn("error_context", ctx)
    plain = {r.item_id: r.prompt for r in RD.slot_prompt(rows).collect()}
    mine = {r.item_id: r.prompt for r in RD.slot_prompt(rows, own=F.col("own_prompt")).collect()}
    assert mine == {1: "mine", 2: plain[2], 3: plain[3]}
    assert {r.prompt for r in RD.slot_prompt(rows, own=" all of them ").collect()} == {"all of them"}
    error = F.struct(F.lit(RD.S.OTHER).alias("category"), F.lit("m").alias("message"), F.lit(None).cast("int").alias("line_number"), F.lit("error").alias("severity"),
                     F.array().cast("array<string>").alias("suggested_fixes"), F.lit("m").alias("original_stderr"))
    failed = rows.withColumn("error_context", error)
    assert {r.prompt for r in RD.slot_prompt(failed, own="x").collect()} == {r.prompt for r in RD.slot_prompt(failed).collect()}
    with pytest.raises(ValueError, match="empty"):
        RD.slot_prompt(rows, own=" \n")
    res = RD.retry_rounds(spark, _items(spark).limit(3), stub_model_factory, stub_checker_factory, RD.RetrySchedule.of(attempts=1), work_dir=f"{tmp_dir}/w", prompt="one for all")
    assert spark.read.parquet(f"{tmp_dir}/w/candidates_1").select("prompt" if "prompt" in spark.read.parquet(f"{tmp_dir}/w/candidates_1").columns else "gen_key").distinct().count() == 1
    assert res.attempts_run == 1


def test_memo_stats_deals_requests_before_it_makes_their_keys(spark, tmp_dir, monkeypatch):
    """The tasks that hold the keys grow with the requests."""
    import os

    from proofloom.operators import memo as MM
    from proofloom.plans import catalog_rounds as CR

    lines = spark.range(600).selectExpr(
        "id % 40 AS l_orderkey", "cast(id % 7 + 1 as int) AS l_linenumber", "if(id % 11 = 0, null, id % 9) AS l_partkey", "id AS l_suppkey",
        "cast(id as double) AS l_extendedprice", "cast(1 as double) AS l_quantity", "'F' AS l_linestatus", "'R' AS l_returnflag",
    )
    lines.write.parquet(os.path.join(tmp_dir, "lineitem.parquet"))
    monkeypatch.setattr(CR, "REQUESTS", 20)
    out = CR.q_memo_stats(spark, tmp_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(code" in line and ", 30)" in line for line in plan.splitlines())
    req = CR._requests(spark, tmp_dir)
    want = MM.run_stats(req, {"generation_": "gen_key", "check_": "content_key"}).first()
    got = out.first()
    assert [round(x, 6) for x in got] == [round(x, 6) for x in want]
    assert got.check_requests == 600 and got.check_size_after == 9
