"""Registered queries for scans and sinks (2.1).  Each writes its input,
derived from the driver tables, as JSONL (or partitioned output) to a fresh
folder under the session's checkpoint directory, then reads it back."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import checks as CK
from ..operators import metrics as M
from ..operators import profile as PF
from ..operators import splits as SP
from ..operators.numbering import numbered
from ..session import scratch_path, tasks_for
from ..sources import items as SRC
from ..sources import sinks as SNK
from .bindings import items_v, records_v, table, with_views
from .catalog_items import _ID_ERR, _THM_ERR, _docs, _iv, _vrows
from .catalog_items import ORACLES as _ITEM_ORACLES
from .catalog_results import ORACLES as _RESULT_ORACLES
from .catalog_results import PASS_K, SCHEDULE, reported


#: Lines that a task deals with at most, on average, where whole texts are moved.
LINES = 10_000


def _write_items(spark: SparkSession, sf: str, name: str, corrupt: bool = False) -> str:
    it = items_v(spark, sf)
    path = scratch_path(spark, name)
    body = it.select("doc_id", F.to_json(CK.item_struct(it)).alias("value"))
    if corrupt:
        body = body.withColumn(
            "value", F.when(F.col("doc_id") % 43 == 0, F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).otherwise(F.col("value"))
        )
    body.select("value").write.mode("overwrite").text(path)
    return path


def q_scan_items(spark, sf):
    path = _write_items(spark, sf, "scan_items")
    df = SRC.scan_items(spark, path)
    return df.select("id", "topic", F.col("english.statement").alias("statement"),
                     F.size("english.steps").alias("n_steps"), F.col("lean.theorem").alias("theorem"))


def q_scan_strict(spark, sf):
    """A file of only valid items (the quarantine's accepted rows) loads."""
    ok, _ = CK.quarantine(items_v(spark, sf))
    path = scratch_path(spark, "scan_strict")
    SNK.sink_jsonl(ok, path)
    return SRC.scan_strict(spark, path).select("id", "topic")


def q_scan_numbered(spark, sf):
    """Lines written in the order of the items, a bucket's file as a folder of
    part files, one per range, the line's own place among its file's lines
    written into it: the number that the scan gives and the place agree."""
    it = items_v(spark, sf).where(F.col("doc_id").isNotNull())
    tasks = tasks_for(it, LINES)
    path = scratch_path(spark, "scan_numbered")
    body = it.select((F.col("doc_id") % 7).alias("bucket"), "doc_id", F.to_json(CK.item_struct(it)).alias("value"))
    placed = numbered(body, [F.col("doc_id")], "place", group=["bucket"], tasks=tasks)
    line = F.concat((F.col("place") + 1).cast("string"), F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "), F.col("value"))
    # ranges of the order: the parts of a bucket's file follow each other by name
    out = placed.repartitionByRange(tasks, "bucket", "place").sortWithinPartitions("bucket", "place")
    out.select("bucket", line.alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)
    return SRC.scan_numbered(spark, path, parts=True).select(
        F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"),
        "line_number",
        F.regexp_extract("value", r"^(\d+) ", 1).cast("long").alias("written_number"),
        F.regexp_extract("value", r"^\d+ (\d+) ", 1).cast("long").alias("doc_id"),
    )


def q_scan_corrupt(spark, sf):
    path = _write_items(spark, sf, "scan_corrupt", corrupt=True)
    return SRC.scan_corrupt(spark, path).select("id", F.array_join("reasons", " | ").alias("reasons"))


def _benchmark_items(spark, sf):
    """Held-out passages of ``benchmark`` as items of their own file."""
    b = table(spark, sf, "benchmark")
    return b.select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"),
        F.lit("benchmark").alias("topic"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("statement"),
        F.split(F.col("text"), "\n", -1).alias("steps"),
        F.array().cast("array<string>").alias("imports"),
        F.concat(F.lit("theorem "), F.col("text")).alias("theorem"),
    )


def q_scan_union_files(spark, sf):
    """Two item files -- the documents' items and the benchmark's -- read in
    one multi-path scan, tagged by file."""
    a, b = scratch_path(spark, "union_documents"), scratch_path(spark, "union_benchmark")
    SNK.sink_jsonl(items_v(spark, sf), a)
    SNK.sink_jsonl(_benchmark_items(spark, sf), b)
    df = SRC.scan_union_files(spark, [a, b])
    return df.select("id", "topic", F.regexp_extract("path", "union_([a-z]+)", 1).alias("tagged"))


def q_sink_jsonl(spark, sf):
    """Items written as compact JSON lines, read back as typed items."""
    path = scratch_path(spark, "sink_jsonl")
    SNK.sink_jsonl(items_v(spark, sf), path)
    back = SRC.scan_items(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.sum(F.length("lean.theorem")).cast("long").alias("sum_theorem_length"),
        F.sum(F.size("english.steps")).cast("long").alias("sum_steps"),
    )


def q_sink_splits(spark, sf):
    tagged = SP.assign_splits(items_v(spark, sf))
    path = scratch_path(spark, "sink_splits")
    SNK.sink_splits(tagged, path)
    back = spark.read.text(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _times(column, text):
    """How often the text stands in a line of a document."""
    return (F.octet_length(column) - F.octet_length(F.replace(F.col(column), F.lit(text), F.lit("")))) / len(text)


def q_sink_report(spark, sf):
    """The evaluation report, written as one document and read back by line:
    the opening line's fields, and how many items, errors and records follow."""
    items, errors, kept = reported(spark, sf)
    met = M.compute_metrics(items, PASS_K)
    head = met.select(
        F.lit("lineitem").alias("dataset_path"), F.struct(*met.columns).alias("metrics"), F.array(*[F.lit(k) for k in PASS_K]).alias("pass_k"),
        F.struct(F.lit(SCHEDULE.attempts).alias("max_attempts"), F.lit(SCHEDULE.token_limit).alias("max_tokens")).alias("config"),
    )
    path = scratch_path(spark, "sink_report")
    SNK.sink_report(head, items, errors, kept, PASS_K, path)
    back = spark.read.text(path)
    opening = F.from_json(
        F.concat(F.col("value"), F.lit("]}")),
        "dataset_path string, metrics struct<total_items: long, success_count: long, pass_at_5: double, time_median: double>, pass_k array<int>, config struct<max_attempts: int>",
    )
    first = back.where(F.col("value").startswith('{"dataset_path"')).select(opening.alias("o")).select(
        "o.metrics.total_items", "o.metrics.success_count", F.round("o.metrics.pass_at_5", 6).alias("pass_at_5"),
        F.round("o.metrics.time_median", 6).alias("time_median"), F.array_join("o.pass_k", ",").alias("pass_k"), "o.config.max_attempts",
    )
    total = lambda text: F.sum(_times("value", text)).cast("long")
    counted = back.agg(
        F.count_if(F.col("value").rlike(r'^,?\{"id":')).alias("n_items"),
        total('"severity":').alias("n_errors"),
        total('"beam_index":').alias("n_records"),
    )
    return PF.one_row(first, counted)


def q_sink_validation_report(spark, sf):
    """The validation report, written as one document and read back by line."""
    docs = _docs(spark, sf)
    copies = PF.duplicate_content_items(docs, "text")
    path = scratch_path(spark, "sink_validation")
    SNK.sink_validation_report(PF.findings(docs, "text"), copies, _vrows(spark, sf), path)
    back = spark.read.text(path)
    line = F.col("value")
    return back.agg(
        F.max(F.regexp_extract(line, r'^\{"total_items":(\d+),"topics":', 1).try_cast("long")).alias("total_items"),
        F.max(F.regexp_extract(line, r'"compilation":\{"total_checked":(\d+),', 1).try_cast("long")).alias("total_checked"),
        F.max(F.regexp_extract(line, r'"compilation":.*"failed":(\d+),', 1).try_cast("long")).alias("failed"),
        F.count_if(line.rlike(r'^,?"[^"]*":\d+$')).alias("n_topics"),
        F.count_if(line.rlike(r'^,?\d+$')).alias("n_duplicate_content_items"),
        F.count_if(line.rlike(r'^,?\{"id":.*"ok":')).alias("n_results"),
        F.count_if(line.rlike(r'^,?\{"id":.*"ok":false')).alias("n_failed_results"),
    )


QUERIES = {
    "scan_items": q_scan_items,
    "scan_strict": q_scan_strict,
    "scan_numbered": q_scan_numbered,
    "scan_corrupt": q_scan_corrupt,
    "scan_union_files": q_scan_union_files,
    "sink_jsonl": q_sink_jsonl,
    "sink_splits": q_sink_splits,
    "sink_report": q_sink_report,
    "sink_validation_report": q_sink_validation_report,
}

_IT = ", it AS (SELECT *, string_split(steps_text, chr(10)) AS steps FROM items_v)\n"

ORACLES = {
    "scan_corrupt": _iv(
        f"""
, x AS (SELECT doc_id, id, {_THM_ERR} AS te, {_ID_ERR} AS ie FROM it)
, v AS (SELECT x.doc_id, x.id, list_filter([se.steps_error, x.te, x.ie], lambda e: e IS NOT NULL) AS vs
        FROM x JOIN se ON se.doc_id = x.doc_id)
SELECT CASE WHEN doc_id % 43 = 0 THEN NULL ELSE id END AS id,
       CASE WHEN doc_id % 43 = 0 THEN 'Invalid JSON' ELSE array_to_string(vs, ' | ') END AS reasons
FROM v WHERE doc_id % 43 = 0 OR len(vs) > 0"""
    ),
    "scan_strict": _iv(
        f"""
, x AS (SELECT doc_id, id, topic, {_THM_ERR} AS te, {_ID_ERR} AS ie FROM it)
SELECT x.id, x.topic FROM x JOIN se ON se.doc_id = x.doc_id
WHERE se.steps_error IS NULL AND x.te IS NULL AND x.ie IS NULL"""
    ),
    "scan_items": with_views(_IT + "SELECT id, topic, statement, CAST(len(steps) AS INT) AS n_steps, theorem FROM it", "items_v"),
    "scan_union_files": with_views(
        "SELECT id, topic, 'documents' AS tagged FROM items_v "
        "UNION ALL SELECT 'bench_' || CAST(item_id AS VARCHAR) AS id, 'benchmark' AS topic, 'benchmark' AS tagged FROM benchmark",
        "items_v",
    ),
    "sink_jsonl": with_views(
        _IT + "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, CAST(sum(length(theorem)) AS BIGINT) AS sum_theorem_length, "
        "CAST(sum(len(steps)) AS BIGINT) AS sum_steps FROM it",
        "items_v",
    ),
    "sink_splits": _ITEM_ORACLES["split_summary"].replace(
        "SELECT split, topic, count(*) AS n FROM sa GROUP BY GROUPING SETS ((split), (split, topic))",
        "SELECT split, count(*) AS n FROM sa GROUP BY split",
    ),
    "scan_numbered": with_views(
        "SELECT doc_id % 7 AS bucket, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS line_number, "
        "row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS written_number, doc_id FROM items_v",
        "items_v",
    ),
    "sink_report": _RESULT_ORACLES["item_report"].split("SELECT ev.item_id, success, success_rank")[0]
    + "SELECT total_items, success_count, pass_at_5, time_median, '1,5' AS pass_k, 7 AS max_attempts, (SELECT count(*) FROM ev) AS n_items, "
    "(SELECT count(error) FROM en WHERE item_id IN (SELECT item_id FROM ev)) AS n_errors, (SELECT count(*) FROM kept) AS n_records FROM met",
    "sink_validation_report": _ITEM_ORACLES["dataset_verdict"].split("SELECT (n_duplicate_ids = 0")[0]
    + "SELECT total_items, total_checked, failed, n_topics, n_duplicate_content_items, total_checked AS n_results, failed AS n_failed_results FROM ds, vs",
}
