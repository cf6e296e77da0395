"""Registered queries for item results (2.8) and evaluation metrics (2.9),
bound to ``records_v``; each has an independent DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as CL
from ..operators import metrics as M
from ..operators import reports as REP
from ..operators import results as R
from ..operators.rounds import RetrySchedule, schedule_column
from ..session import written
from .bindings import records_v, stderr_v, with_views
from .catalog_text import _LINES as _PRIM

PASS_K = (1, 5)
#: The bound records have seven attempts (``bindings.records_v``).
SCHEDULE = RetrySchedule.of(attempts=7)
MAX_ATT = SCHEDULE.attempts


def _r6(c):
    return F.round(c, 6)


def q_sort_records(spark: SparkSession, sf: str) -> DataFrame:
    return R.record_rank(records_v(spark, sf)).select("item_id", "attempt", "beam_index", "record_rank")


def q_success_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return R.success_metadata(records_v(spark, sf))


def q_final_code(spark: SparkSession, sf: str) -> DataFrame:
    return R.final_code(records_v(spark, sf))


def _item_eval(spark: SparkSession, sf: str) -> DataFrame:
    return R.item_evaluation(records_v(spark, sf), max_attempts=MAX_ATT, pass_k=PASS_K)


def q_item_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return _item_eval(spark, sf)


def q_attempts_used(spark: SparkSession, sf: str) -> DataFrame:
    return _item_eval(spark, sf).select("item_id", "attempts")


def q_item_times(spark: SparkSession, sf: str) -> DataFrame:
    return _item_eval(spark, sf).select("item_id", "total_time")


def q_pass_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _item_eval(spark, sf).select("item_id", "pass_at_1", "pass_at_5")


def q_candidate_total(spark: SparkSession, sf: str) -> DataFrame:
    return _item_eval(spark, sf).select("item_id", "candidate_total")


def q_record_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.record_report(records_v(spark, sf))


def q_generation_log(spark: SparkSession, sf: str) -> DataFrame:
    rec = records_v(spark, sf)
    items = rec.select("item_id").distinct()
    log = R.generation_log(rec, items, schedule_column(SCHEDULE))
    return log.select(
        "item_id",
        "attempt",
        "beam_size",
        "temperature",
        "chunk",
        F.size("candidates").alias("n_candidates"),
        F.array_join(F.transform("candidates", lambda c: c["index"].cast("string")), ",").alias("indexes"),
    )


def reported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items with final code, their errors, their kept records).  The errors
    are the checker outputs of the item's number in ``events``.  Items and
    records are written: a report reads them several times."""
    records = written(records_v(spark, sf), "records")
    kept = written(R.stop_at_first_success(records).drop("first_ok"), "report-records")
    evaluated = R.item_evaluation(records, max_attempts=MAX_ATT, pass_k=PASS_K)
    items = written(evaluated.join(R.final_code(kept), "item_id", "left"), "report-items")
    errors = CL.errors_encountered(stderr_v(spark, sf)).select(
        "item_id", "attempt", F.lit(0).alias("beam_index"), F.col("event_id").alias("seq"), "primary_error"
    )
    return items, errors, kept


def q_item_report(spark: SparkSession, sf: str) -> DataFrame:
    """Item reports with their errors and records, in chunks of 256 entries."""
    rows = REP.nested_items(*reported(spark, sf))
    record = lambda r: F.concat_ws(
        ":", r["attempt"], r["beam_index"], r["compiled"], F.coalesce(r["compile_ok"].cast("string"), F.lit("-")), r["generation_time"].cast("long"), r["code_length"]
    )
    return rows.select(
        "item_id", "success", "success_rank", "success_attempt", "attempts", "total_time",
        "pass_at_1", "pass_at_5", "final_code", "candidate_total", "chunk", "n_errors",
        F.array_join(F.transform("errors", lambda e: F.concat(e["category"], F.lit(":"), e["message"])), " | ").alias("errors"),
        F.array_join(F.transform("candidate_records", record), ",").alias("records"),
    )


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.compute_metrics(_item_eval(spark, sf), PASS_K)
    return m.select(*[(_r6(F.col(c)).alias(c) if c not in ("total_items", "success_count") else c) for c in m.columns])


def q_compute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def q_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("total_items", "success_count", "success_rate")


def q_pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("pass_at_1", "pass_at_5")


def q_compile_rate_at_1(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("compile_rate_at_1")


def q_attempts_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("attempts_mean", "attempts_median", "attempts_p90")


def q_time_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("time_mean", "time_median", "time_p90")


QUERIES = {
    "sort_records": q_sort_records,
    "success_metadata": q_success_metadata,
    "final_code": q_final_code,
    "attempts_used": q_attempts_used,
    "item_times": q_item_times,
    "pass_flags": q_pass_flags,
    "item_evaluation": q_item_evaluation,
    "candidate_total": q_candidate_total,
    "record_report": q_record_report,
    "generation_log": q_generation_log,
    "item_report": q_item_report,
    "success_rate": q_success_rate,
    "pass_at_k": q_pass_at_k,
    "compile_rate_at_1": q_compile_rate_at_1,
    "attempts_stats": q_attempts_stats,
    "time_stats": q_time_stats,
    "compute_metrics": q_compute_metrics,
}

# ---------------------------------------------------------------------------
# Oracles (DuckDB).  Written independently: record rank by a window, first
# success by min over ranks.
# ---------------------------------------------------------------------------
_RANKED = """
, ranked AS (
  SELECT item_id, attempt, beam_index, code, generation_time, compiled, compile_ok,
         coalesce(compiled AND compile_ok, false) AS ok,
         row_number() OVER (PARTITION BY item_id ORDER BY attempt, beam_index) AS rn
  FROM records_v)
, firsts AS (
  SELECT item_id, min(CASE WHEN ok THEN rn END) AS fr, min(CASE WHEN ok THEN attempt END) AS fa
  FROM ranked GROUP BY item_id)
, ev AS (
  SELECT r.item_id,
         (f.fr IS NOT NULL) AS success,
         CAST(f.fr AS INT) AS success_rank,
         CAST(f.fa AS INT) AS success_attempt,
         CAST(coalesce(f.fa, 7) AS INT) AS attempts,
         CAST(sum(r.generation_time) AS DOUBLE) AS total_time,
         count(*) AS candidate_total,
         coalesce(f.fa <= 1, false) AS pass_at_1,
         coalesce(f.fa <= 5, false) AS pass_at_5
  FROM ranked r JOIN firsts f ON r.item_id = f.item_id
  WHERE f.fr IS NULL OR r.rn <= f.fr
  GROUP BY r.item_id, f.fr, f.fa)
, met AS (
  SELECT count(*) AS total_items,
         count(*) FILTER (WHERE success) AS success_count,
         round(coalesce(CAST(count(*) FILTER (WHERE success) AS DOUBLE) / nullif(count(*), 0), 0.0), 6) AS success_rate,
         round(coalesce(avg(CASE WHEN success_attempt <= 1 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS pass_at_1,
         round(coalesce(avg(CASE WHEN success_attempt <= 5 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS pass_at_5,
         round(coalesce(avg(CASE WHEN success_attempt <= 1 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS compile_rate_at_1,
         round(coalesce(avg(CAST(attempts AS DOUBLE)), 0.0), 6) AS attempts_mean,
         round(coalesce(quantile_cont(CAST(attempts AS DOUBLE), 0.5), 0.0), 6) AS attempts_median,
         round(coalesce(quantile_cont(CAST(attempts AS DOUBLE), 0.9), 0.0), 6) AS attempts_p90,
         round(coalesce(avg(total_time), 0.0), 6) AS time_mean,
         round(coalesce(quantile_cont(total_time, 0.5), 0.0), 6) AS time_median,
         round(coalesce(quantile_cont(total_time, 0.9), 0.0), 6) AS time_p90
  FROM ev)
"""


def _rv(sql: str) -> str:
    return with_views(_RANKED + sql, "records_v")


ORACLES = {
    "sort_records": _rv("SELECT item_id, attempt, beam_index, CAST(rn AS INT) AS record_rank FROM ranked"),
    "success_metadata": _rv("SELECT item_id, CAST(fr AS INT) AS success_rank, CAST(fa AS INT) AS success_attempt FROM firsts"),
    "final_code": _rv(
        "SELECT item_id, arg_min(CASE WHEN ok AND code <> '' THEN code END, CASE WHEN ok AND code <> '' THEN rn END) AS final_code "
        "FROM ranked GROUP BY item_id"
    ),
    "attempts_used": _rv("SELECT item_id, attempts FROM ev"),
    "item_times": _rv("SELECT item_id, total_time FROM ev"),
    "pass_flags": _rv("SELECT item_id, pass_at_1, pass_at_5 FROM ev"),
    "item_evaluation": _rv("SELECT * FROM ev"),
    "candidate_total": _rv("SELECT item_id, candidate_total FROM ev"),
    "record_report": with_views(
        "SELECT item_id, attempt, beam_index, compiled, CASE WHEN compiled THEN compile_ok END AS compile_ok, "
        "generation_time, CAST(coalesce(length(code), 0) AS INT) AS code_length FROM records_v",
        "records_v",
    ),
    "generation_log": _rv(
        """
, sched AS (SELECT * FROM (VALUES (1, 1, 0.3), (2, 3, 0.5), (3, 3, 0.5), (4, 5, 0.7), (5, 5, 0.8), (6, 5, 0.8), (7, 5, 0.8)) t(attempt, beam_size, temperature))
, slots AS (SELECT i.item_id, CAST(s.attempt AS INT) AS attempt, CAST(s.beam_size AS INT) AS beam_size,
                   CAST(s.temperature AS DOUBLE) AS temperature
            FROM (SELECT DISTINCT item_id FROM records_v) i, sched s)
, placed AS (SELECT item_id, attempt, beam_index, (row_number() OVER (PARTITION BY item_id, attempt ORDER BY beam_index) - 1) // 256 AS chunk FROM records_v)
SELECT s.item_id, s.attempt, s.beam_size, s.temperature, coalesce(r.chunk, 0) AS chunk,
       CAST(count(r.beam_index) AS INT) AS n_candidates,
       coalesce(string_agg(CAST(r.beam_index AS VARCHAR), ',' ORDER BY r.beam_index), '') AS indexes
FROM slots s LEFT JOIN placed r ON r.item_id = s.item_id AND r.attempt = s.attempt
GROUP BY s.item_id, s.attempt, s.beam_size, s.temperature, r.chunk"""
    ),
    "item_report": with_views(
        _PRIM + _RANKED + """
, kept AS (SELECT r.* FROM ranked r JOIN firsts f ON r.item_id = f.item_id WHERE f.fr IS NULL OR r.rn <= f.fr)
, fc AS (SELECT item_id, arg_min(CASE WHEN ok AND code <> '' THEN code END, CASE WHEN ok AND code <> '' THEN rn END) AS final_code FROM kept GROUP BY item_id)
, en AS (SELECT s.item_id, 0 AS kind, s.attempt, 0 AS beam_index, s.event_id AS seq, p.category || ':' || p.message AS error, NULL AS record
         FROM prim p JOIN stderr_v s ON p.event_id = s.event_id
         UNION ALL SELECT item_id, 1, attempt, beam_index, beam_index, NULL, concat_ws(':', attempt, beam_index, compiled,
           CASE WHEN compiled THEN CAST(compile_ok AS VARCHAR) ELSE '-' END, CAST(generation_time AS BIGINT), length(code)) FROM kept)
, pl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kind, attempt, beam_index, seq) - 1 AS place FROM en)
, ch AS (SELECT item_id, place // 256 AS chunk, coalesce(string_agg(error, ' | ' ORDER BY place), '') AS errors, coalesce(string_agg(record, ',' ORDER BY place), '') AS records
         FROM pl GROUP BY item_id, place // 256)
, ne AS (SELECT item_id, count(error) AS n_errors FROM en GROUP BY item_id)
SELECT ev.item_id, success, success_rank, success_attempt, attempts, total_time, pass_at_1, pass_at_5, final_code, candidate_total, ch.chunk, n_errors, errors, records
FROM ev LEFT JOIN fc ON ev.item_id = fc.item_id JOIN ch ON ch.item_id = ev.item_id JOIN ne ON ne.item_id = ev.item_id""",
        "records_v", "stderr_v",
    ),
    "success_rate": _rv("SELECT total_items, success_count, success_rate FROM met"),
    "pass_at_k": _rv("SELECT pass_at_1, pass_at_5 FROM met"),
    "compile_rate_at_1": _rv("SELECT compile_rate_at_1 FROM met"),
    "attempts_stats": _rv("SELECT attempts_mean, attempts_median, attempts_p90 FROM met"),
    "time_stats": _rv("SELECT time_mean, time_median, time_p90 FROM met"),
    "compute_metrics": _rv("SELECT * FROM met"),
}
