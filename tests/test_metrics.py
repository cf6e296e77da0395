"""Evaluation metrics and item results (2.8, 2.9) on golden sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.operators import metrics as M
from proofloom.operators import results as R

ITEM_SCHEMA = "item_id string, success boolean, success_rank int, success_attempt int, attempts int, total_time double"

# The published 26-item run: (attempts, success_rank or None, time).
README26 = [
    (1, 1, 10.60), (1, 1, 4.26), (1, 1, 4.05), (1, 1, 3.96), (4, 8, 80.62), (1, 1, 6.69), (1, 1, 5.00),
    (1, 1, 6.09), (4, 9, 70.87), (3, 5, 43.57), (1, 1, 10.86), (2, 3, 21.18), (2, 2, 20.38), (1, 1, 4.51),
    (2, 3, 78.94), (5, 15, 275.90), (4, 11, 139.31), (5, None, 186.02), (2, 2, 23.83), (2, 2, 23.44),
    (2, 4, 35.26), (2, 3, 30.39), (1, 1, 10.18), (1, 1, 8.57), (3, 6, 85.59), (5, None, 187.06),
]


def test_one_failed_item_and_ties(spark):
    """One failed item alone; then equal times around the median and a success
    in each attempt."""
    one = M.compute_metrics(spark.createDataFrame([("only", False, None, None, 5, 9.25)], ITEM_SCHEMA), (1, 2)).first()
    assert (one.total_items, one.success_count, one.success_rate, one.pass_at_1, one.pass_at_2) == (1, 0, 0.0, 0.0, 0.0)
    assert one.time_mean == one.time_median == one.time_p90 == 9.25
    assert one.attempts_mean == one.attempts_median == one.attempts_p90 == 5.0
    rows = [(f"i{a}", True, a, a, a, 4.0) for a in (1, 2, 3, 4)] + [("late", True, 9, 5, 5, 40.0), ("none", False, None, None, 5, 4.0)]
    m = M.compute_metrics(spark.createDataFrame(rows, ITEM_SCHEMA), (3, 1)).first()
    assert (m.success_count, m.time_median, m.time_p90, m.time_mean) == (5, 4.0, 22.0, 10.0)
    assert (m.pass_at_1, m.pass_at_3, m.compile_rate_at_1) == (pytest.approx(1 / 6), 0.5, pytest.approx(1 / 6))
    assert (m.attempts_median, m.attempts_p90) == (3.5, 5.0)


def test_published_run(spark):
    rows = [
        (f"i{i}", r is not None, r, a if r is not None else None, a, t) for i, (a, r, t) in enumerate(README26)
    ]
    m = M.compute_metrics(spark.createDataFrame(rows, ITEM_SCHEMA), (1, 5)).first()
    assert m.total_items == 26 and m.success_count == 24
    assert round(m.pass_at_1 * 100, 1) == 42.3 and round(m.pass_at_5 * 100, 1) == 92.3
    assert round(m.compile_rate_at_1 * 100, 1) == 42.3
    assert (round(m.attempts_mean, 2), m.attempts_median, m.attempts_p90) == (2.23, 2.0, 4.5)
    assert (round(m.time_mean, 2), round(m.time_median, 2), round(m.time_p90, 2)) == (52.97, 22.31, 162.67)
    times = [t for _, _, t in README26]
    assert m.time_p90 == pytest.approx(np.percentile(times, 90))


def test_empty(spark):
    m = M.compute_metrics(spark.createDataFrame([], ITEM_SCHEMA), (1,)).first()
    assert m.total_items == 0 and m.success_rate == 0.0 and m.pass_at_1 == 0.0
    assert m.attempts_mean == 0.0 and m.time_mean == 0.0 and m.time_median == 0.0


def test_time_quantiles(spark):
    """Hot values, negatives, far-apart magnitudes, nulls and NaN against numpy;
    no plan holds a percentile of the times."""
    rows = [(f"i{i}", False, None, None, 5, float((i * 7919) % 1000) / 7.0 * 10.0 ** (i % 9 - 4)) for i in range(5000)]
    rows += [(f"h{i}", False, None, None, 5, 3.0) for i in range(2500)]  # a hot value
    rows += [("n", False, None, None, 5, None), ("m", False, None, None, 5, -2.5), ("z", False, None, None, 5, 0.0)]
    df = spark.createDataFrame(rows, ITEM_SCHEMA).repartition(9)
    m = M.compute_metrics(df)
    times = [r[5] for r in rows if r[5] is not None]
    got = m.first()
    assert got.total_items == len(rows)
    assert got.time_median == pytest.approx(np.percentile(times, 50)) and got.time_p90 == pytest.approx(np.percentile(times, 90))
    assert got.time_mean == pytest.approx(np.mean(times))
    from proofloom.operators.quantiles import quantiles, range_counts

    probs = {f"q{i}": i / 20 for i in range(21)}
    nan = df.select("total_time").unionByName(spark.createDataFrame([(float("nan"),)], "total_time double"))
    row = quantiles(range_counts(nan, "total_time"), probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.percentile(times, 100 * p))
    assert quantiles(range_counts(df.limit(0), "total_time"), {"a": 0.5}).first().a == 0.0
    with pytest.raises(ValueError):
        quantiles(range_counts(df, "total_time"), {"a": 1.5})


REC_SCHEMA = "item_id string, attempt int, beam_index int, seq long, compiled boolean, compile_ok boolean, generation_time double, code string"


def _records(spark):
    data = [
        # item x: fails attempt 1 (beam 0), succeeds attempt 2 beam 1; a later record must be trimmed
        ("x", 1, 0, 0, True, False, 1.0, "c1"),
        ("x", 2, 0, 0, False, False, 1.0, ""),
        ("x", 2, 1, 1, True, True, 2.0, "good"),
        ("x", 2, 2, 2, True, True, 5.0, "later"),
        # item y never succeeds
        ("y", 1, 0, 0, True, False, 1.5, "a"),
        ("y", 2, 0, 0, True, False, 1.5, "b"),
    ]
    return spark.createDataFrame(data, REC_SCHEMA)


def test_item_evaluation(spark):
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "item_id string")
    ev = {r.item_id: r for r in R.item_evaluation(_records(spark), items, max_attempts=5).collect()}
    assert (ev["x"].success, ev["x"].success_rank, ev["x"].success_attempt, ev["x"].attempts) == (True, 3, 2, 2)
    assert ev["x"].total_time == 4.0 and ev["x"].candidate_total == 3  # trimmed after first success
    assert ev["x"].pass_at_1 is False and ev["x"].pass_at_5 is True
    assert (ev["y"].success, ev["y"].success_rank, ev["y"].attempts) == (False, None, 5)
    assert (ev["z"].success, ev["z"].candidate_total, ev["z"].attempts, ev["z"].total_time) == (False, 0, 5, 0.0)


def test_final_code_and_log(spark):
    from proofloom.operators.rounds import RetrySchedule, schedule_column

    rec = _records(spark)
    fc = {r.item_id: r.final_code for r in R.final_code(rec).collect()}
    assert fc == {"x": "good", "y": None}
    items = spark.createDataFrame([("x",), ("y",)], "item_id string")
    log = R.generation_log(rec, items, schedule_column(RetrySchedule())).collect()
    assert len(log) == 10
    by = {(r.item_id, r.attempt): r for r in log}
    assert [c["index"] for c in by[("x", 2)].candidates] == [0, 1, 2]
    assert by[("y", 4)].candidates == [] and by[("y", 4)].beam_size == 5
    assert by[("x", 1)].candidates[0].compile_ok is False
    assert by[("x", 2)].candidates[0].compile_ok is None  # not compiled -> null


def test_pass_k_arguments():
    with pytest.raises(ValueError):
        R.normalize_pass_k([])
    with pytest.raises(ValueError):
        R.normalize_pass_k([0, 1])
    assert R.normalize_pass_k([5, 1, 5]) == (1, 5)


def test_hot_item_evaluation(spark):
    """One item holding most records: the first-success join and the
    per-item aggregate give the same answer as a direct computation."""
    rows = []
    for a in range(1, 6):
        for b in range(1200):
            ok = a == 4 and b == 700
            rows.append(("hot", a, b, b, True, ok, 1.0, f"c{a}_{b}"))
    rows += [(f"i{i}", 1, 0, 0, True, i % 2 == 0, 2.0, "x") for i in range(50)]
    rec = spark.createDataFrame(rows, REC_SCHEMA).repartition(7)
    ev = {r.item_id: r for r in R.item_evaluation(rec).collect()}
    hot = ev["hot"]
    assert (hot.success, hot.success_attempt, hot.attempts) == (True, 4, 4)
    assert hot.success_rank == 3 * 1200 + 701 == hot.candidate_total
    assert hot.total_time == float(3 * 1200 + 701)
    assert ev["i2"].success and not ev["i3"].success and ev["i3"].attempts == 5


def test_hot_item_ranks(spark):
    """One item with a third of the rows, null items and attempts: ranks follow
    (attempt, beam, arrival), and no window spans the records of an item."""
    rows = [("hot", a, b, b, False, None, 1.0, "") for a in range(1, 8) for b in range(100)]
    rows += [(f"i{i}", i % 3, 0, i, False, None, 1.0, "") for i in range(1400)]
    rows += [(None, 1, 0, 1, False, None, 1.0, ""), (None, None, 0, 2, False, None, 1.0, ""), ("hot", None, 5, 0, True, True, 1.0, "")]
    rec = spark.createDataFrame(rows, REC_SCHEMA).repartition(5)
    out = R.record_rank(rec)
    got = {(r.item_id, r.attempt, r.beam_index, r.seq): r.record_rank for r in out.collect()}
    assert len(got) == len(rows)
    hot = sorted((k for k in got if k[0] == "hot"), key=lambda k: (k[1] is not None, k[1] or 0, k[2]))
    assert [got[k] for k in hot] == list(range(1, 702))
    assert got[(None, None, 0, 2)] == 1 and got[(None, 1, 0, 1)] == 2
    ev = {r.item_id: r for r in R.item_evaluation(rec).collect()}
    assert None not in ev and ev["hot"].candidate_total == 700 and not ev["hot"].success


def test_first_success_in_every_attempt(spark):
    """Every place of the first success, ties in beam and arrival, records of
    later attempts: the two-level cut against a direct walk."""
    rows = []
    for i in range(60):
        for a in range(1, 6):
            for b in range(1 + i % 4):
                n = i * 31 + a * 7 + b * 3
                rows.append((f"i{i}", a, b // 2, b, n % 3 > 0, n % 11 == 0, float(n % 5), f"c{n}"))
    rec = spark.createDataFrame(rows, REC_SCHEMA).repartition(6)
    want, kept = {}, 0
    for i in range(60):
        mine = sorted((r for r in rows if r[0] == f"i{i}"), key=lambda r: r[1:4])
        at = next((k for k, r in enumerate(mine) if r[4] and r[5]), None)
        run = mine if at is None else mine[: at + 1]
        kept += len(run)
        want[f"i{i}"] = (at is not None, None if at is None else at + 1, None if at is None else mine[at][1], sum(r[6] for r in run), len(run))
    got = {r.item_id: (r.success, r.success_rank, r.success_attempt, r.total_time, r.candidate_total) for r in R.item_evaluation(rec).collect()}
    assert got == want
    trimmed = R.stop_at_first_success(rec)
    assert trimmed.count() == kept and trimmed.columns == rec.columns + ["first_ok"]
    firsts = {r.item_id: tuple(r.first_ok) for r in R.first_success(rec).collect()}
    assert {r.item_id: tuple(r.first_ok) for r in trimmed.where("first_ok IS NOT NULL").select("item_id", "first_ok").distinct().collect()} == firsts
    assert {k: v[0] for k, v in firsts.items()} == {k: v[2] for k, v in want.items() if v[0]}
