"""Nested reports in chunks and the one-document JSON sink (2.1, 2.8, 2.9)."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from proofloom.operators import metrics as M
from proofloom.operators import profile as PF
from proofloom.operators import reports as RP
from proofloom.operators import results as R
from proofloom.sources import sinks as SNK

RECORDS = "item_id string, attempt int, beam_index int, seq long, compiled boolean, compile_ok boolean, generation_time double, code string"
ERRORS = f"item_id string, attempt int, beam_index int, seq long, primary_error {RP.ERROR_TYPE[:-1]}, original_stderr: string>"


def loaded(path):
    """The parts, joined in the order of their names."""
    assert os.path.exists(os.path.join(path, "_SUCCESS"))
    return json.loads("".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(os.path.join(path, "part-*")))))


def run(spark, hot=40):
    """A hot item with half of the entries, one that passes, one without any
    record, texts that need escaping, and entries of no item."""
    records = [("hot", 1 + k % 3, k, k, k % 2 == 0, False, 0.5, "c" * (k % 4)) for k in range(hot)]
    records += [("ok", 1, 0, 0, True, False, 1.0, "a"), ("ok", 2, 0, 0, True, True, 1.0, 'say "}]"\n'), (None, 1, 0, 0, True, True, 1.0, "x")]
    errors = [("hot", 1 + k % 3, k, k, ("other", f'm "{k}"],\\ é', None, "error", ["fix"], "all")) for k in range(hot - 5)]
    errors += [("ok", 1, 0, 0, ("type_mismatch", "t", 3, "error", [], "all")), (None, 1, 0, 0, ("other", "nobody", None, "error", [], ""))]
    rec = spark.createDataFrame(records, RECORDS).repartition(5)
    items = spark.createDataFrame([("hot",), ("none",), ("ok",)], "item_id string")
    ev = R.item_evaluation(rec, items).join(R.final_code(rec), "item_id", "left")
    return ev, spark.createDataFrame(errors, ERRORS).repartition(3), rec


@pytest.mark.parametrize("chunk", [1, 7, 35, 256])
def test_chunks_hold_every_entry_in_order(spark, chunk):
    ev, errors, rec = run(spark)
    rows = RP.nested_items(ev.withColumn("_chunk", F.lit("mine")), errors, rec, chunk).collect()
    assert {r._chunk for r in rows} == {"mine"}
    for item, n_err, n_rec in (("hot", 35, 40), ("none", 0, 0), ("ok", 1, 2)):
        mine = sorted((r for r in rows if r.item_id == item), key=lambda r: r.chunk)
        assert [r.chunk for r in mine] == list(range(max(1, -(-(n_err + n_rec) // chunk))))
        assert all(len(r.errors) + len(r.candidate_records) <= chunk and r.chunks == len(mine) and r.n_errors == n_err for r in mine)
        recs = [c for r in mine for c in r.candidate_records]
        assert len(recs) == n_rec and [(c.attempt, c.beam_index) for c in recs] == sorted((c.attempt, c.beam_index) for c in recs)
        assert sum(len(r.errors) for r in mine) == n_err
        assert all(c.compile_ok is None for c in recs if not c.compiled)


@pytest.mark.parametrize("chunk", [1, 3, 35, 37, 256])
def test_the_joined_parts_are_the_report(spark, tmp_dir, chunk):
    ev, errors, rec = run(spark)
    met = M.compute_metrics(ev)
    head = met.select(F.lit("d.jsonl").alias("dataset_path"), F.struct(*met.columns).alias("metrics"), F.array(F.lit(1), F.lit(5)).alias("pass_k"))
    path = os.path.join(tmp_dir, "report")
    SNK.sink_report(head, ev, errors, rec, (1, 5), path, chunk=chunk)
    doc = loaded(path)
    assert doc["dataset_path"] == "d.jsonl" and doc["pass_k"] == [1, 5] and doc["metrics"]["total_items"] == 3
    hot, none, ok = doc["items"]
    assert [i["id"] for i in doc["items"]] == ["hot", "none", "ok"]
    assert none["errors"] == [] == none["candidate_records"] and none["final_code"] is None and none["success_rank"] is None
    assert ok["success"] and ok["pass_at_k"] == {"1": False, "5": True} and ok["final_code"] == 'say "}]"\n'
    assert ok["errors"][0]["category"] == "type_mismatch" and "original_stderr" not in ok["errors"][0]
    assert [e["message"] for e in hot["errors"]][:2] == ['m "0"],\\ é', 'm "3"],\\ é'] and len(hot["errors"]) == 35
    assert len(hot["candidate_records"]) == 40 and hot["candidate_records"][0]["code_length"] == 0
    assert len(glob.glob(os.path.join(path, "part-*"))) > 1


def test_an_empty_report_and_a_failed_task(spark, tmp_dir):
    ev, errors, rec = run(spark)
    path = os.path.join(tmp_dir, "empty")
    head = spark.range(1).select(F.lit(0).alias("total"))
    SNK.sink_report(head, ev.limit(0), errors, rec, (1,), path)
    assert loaded(path) == {"total": 0, "items": []}
    broken = spark.range(20, numPartitions=4).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("text"))
    bad = os.path.join(tmp_dir, "bad")
    with pytest.raises(Exception, match="lost"):
        SNK.sink_document(["[", broken.select(F.col("id").alias("n"), "text"), "]"], bad)
    assert not os.path.exists(os.path.join(bad, "_SUCCESS")) and not glob.glob(os.path.join(bad, "part-*"))


def test_validation_document(spark, tmp_dir):
    rows = [("a", "t", "x  y", 0), ("b", 't"q', "x y", 1), ("a", None, "z", 2), (None, "t", None, 3), (None, "t", None, 4)]
    items = spark.createDataFrame(rows, "id string, topic string, text string, seq int")
    verdicts = spark.createDataFrame([("a", True, None), ("a", False, 'bad "x"'), ("b", True, None)], "id string, ok boolean, stderr string")
    checked = PF.verification_rows(items.select("id", "seq"), verdicts, "id")
    path = os.path.join(tmp_dir, "validation")
    SNK.sink_validation_report(PF.findings(items, "text"), PF.duplicate_content_items(items, "text"), checked, path)
    doc = loaded(path)
    assert doc["total_items"] == 5 and doc["topics"] == {"t": 3, 't"q': 1, "null": 1}
    d = doc["duplicates"]
    assert d["duplicate_ids"] == [None, "a"] and d["duplicate_lean_items"] == ["a", "b"] and (d["total_items"], d["unique_ids"]) == (5, 3)
    c = doc["compilation"]
    assert (c["total_checked"], c["successful"], c["failed"]) == (5, 1, 4)
    assert [(r["id"], r["ok"]) for r in c["results"]] == [("a", False), ("b", True), ("a", False), (None, False), (None, False)]
    assert c["results"][0]["stderr"] == 'bad "x"' and c["results"][1]["stderr"] is None
    SNK.sink_validation_report(PF.findings(items.limit(0), "text"), items.select("id", "seq").limit(0), None, path + "0")
    assert loaded(path + "0")["duplicates"]["duplicate_ids"] == []


def test_generation_log_chunks(spark):
    from proofloom.operators.rounds import RetrySchedule, schedule_column

    _, _, rec = run(spark)
    items = spark.createDataFrame([("hot",), ("none",)], "item_id string")
    log = R.generation_log(rec, items, schedule_column(RetrySchedule()), chunk=5).collect()
    hot = [r for r in log if r.item_id == "hot" and r.attempt == 1]
    assert sorted((r.chunk, len(r.candidates)) for r in hot) == [(0, 5), (1, 5), (2, 4)]
    assert [c["index"] for r in sorted(hot, key=lambda r: r.chunk) for c in r.candidates] == list(range(0, 40, 3))
    assert [len(r.candidates) for r in log if r.item_id == "none"] == [0] * 5


def test_a_report_makes_its_entries_and_lines_once(spark, tmp_dir):
    """Every record passes the upstream step once, though the report reads the
    records several times."""
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    records = spark.range(120).selectExpr(
        "id % 30 AS item_id", "cast(id % 7 + 1 as int) AS attempt", "cast(0 as int) AS beam_index", "id AS seq", "true AS compiled",
        "true AS compile_ok", "cast(1 as double) AS generation_time", "'code' AS code",
    )
    counted = records.mapInPandas(passed, records.schema)
    errors = spark.createDataFrame([], "item_id long, attempt int, beam_index int, seq long, primary_error struct<category: string, message: string, line_number: int, severity: string, suggested_fixes: array<string>>")
    items = spark.range(30).selectExpr(
        "id AS item_id", "true AS success", "1 AS success_rank", "1 AS success_attempt", "1 AS attempts", "cast(1 as double) AS total_time", "'code' AS final_code"
    )
    from proofloom.sources import sinks as SNK

    SNK.sink_report(spark.range(1).selectExpr("'d' AS dataset_path"), items, errors, counted, (1, 5), f"{tmp_dir}/report")
    assert seen.value == 120
    text = "".join(r.value for r in spark.read.text(f"{tmp_dir}/report").collect())
    assert text.count('"beam_index":') == 120 and text.count('"final_code":') == 30
