"""Bindings of the operator inputs to the driver tables.

Each binding is a plain projection (one window for ``records_v``) over a
parquet table, written with the DataFrame API so column pruning and filter
push-down reach the scan.  The SQL text of the same views is kept below for
the DuckDB oracles; both forms return identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry long texts: per-row regex and hash work follows
# their scan.  Files of one row group cannot be split, so a session that reads
# such files may name a number of partitions to deal these tables over.
TEXT_TABLES = {"documents", "benchmark", "conversations", "events", "pages"}
DEAL_SETTING = "spark.proofloom.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    deal = spark.conf.get(DEAL_SETTING, None)
    return df.repartition(int(deal)) if deal and name in TEXT_TABLES else df


def _nl():
    return F.lit("\n")


def items_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof items from ``documents``: id, doc_id, topic, lang, statement,
    steps_text, theorem (+ ``steps`` array, + ``imports`` empty array)."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    text = F.col("text")
    sid = doc.cast("string")
    prefix = F.when(doc % 31 == 0, "def ").when(doc % 2 == 0, "theorem ").otherwise("lemma ")
    body = F.when(doc % 3 == 0, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text)
    tail = F.when(doc % 29 == 0, "").otherwise(" := by simp")
    steps_text = F.when(doc % 37 == 0, "").otherwise(text)
    return d.select(
        F.concat(F.when(doc % 41 == 0, "bad id ").otherwise("doc_"), sid).alias("id"),
        doc.alias("doc_id"),
        F.col("source").alias("topic"),
        F.col("lang"),
        F.split_part(text, _nl(), F.lit(1)).alias("statement"),
        steps_text.alias("steps_text"),
        F.concat(prefix, body, tail).alias("theorem"),
    ).withColumn("steps", F.split(F.col("steps_text"), "\n", -1)).withColumn(
        "imports", F.array().cast("array<string>")
    )


def records_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records from ``lineitem``: every line is an attempt, 1..7."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "generation_time"]
    rows = li.select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("attempt"),
        (F.col("l_linestatus") == "F").alias("compiled"),
        ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("compile_ok"),
        F.col("l_quantity").alias("generation_time"),
        "l_partkey", "l_suppkey", "l_extendedprice",
    )
    # Partitioned by the columns' own names: what groups by them afterwards
    # needs no further exchange.
    place = F.row_number().over(Window.partitionBy("item_id", "attempt").orderBy(*order))
    return rows.withColumn("beam_index", (place - 1).cast("int")).select(
        "item_id", "attempt", "beam_index", "compiled", "compile_ok", "generation_time",
        F.concat(F.lit("code_"), F.col("l_partkey").cast("string")).alias("code"),
        F.col("beam_index").cast("long").alias("seq"),
    )


def stderr_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checker output per (item, attempt) from ``events``; ``seq`` = event_id."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    uid = F.col("user_id").cast("string")
    q = F.lit("'")
    stderr = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("c.lean:"), (eid % 97).cast("string"), F.lit(":12: error: unknown identifier 'x"), uid, q),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit("c.lean:3:4: error: type mismatch"), _nl(), F.lit("  c.lean:9:1: error: unexpected token")),
        )
        .when(F.col("event_type") == "purchase", F.concat(F.lit("error: unsolved goals"), _nl(), _nl(), F.lit("note: see above")))
        .when(
            F.col("event_type") == "signup",
            F.when(eid % 2 == 0, F.lit("failed to prove termination")).otherwise(F.lit("mysterious failure")),
        )
        .otherwise(F.lit(""))
    )
    return e.select(
        eid.alias("event_id"),
        F.col("user_id").alias("item_id"),
        (eid % 5 + 1).cast("int").alias("attempt"),
        stderr.alias("stderr"),
    )


def responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies from the assistant turns of ``conversations``."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    k = (F.col("conv_id") + F.col("turn")) % 5
    t = F.col("text")
    fence = F.lit("```")
    response = (
        F.when(k == 0, F.concat(F.lit("Sure:"), _nl(), fence, F.lit("lean"), _nl(), F.lit("theorem t : "), t, F.lit(" := by simp"), _nl(), fence, _nl(), F.lit("done")))
        .when(k == 1, F.concat(fence, _nl(), F.lit("lemma l (a : Nat) := "), t, _nl(), fence))
        .when(k == 2, F.concat(F.lit("Lean: no"), _nl(), F.lit("Lean:"), _nl(), F.lit("theorem t (a : "), t, _nl(), _nl(), F.lit("hope it helps")))
        .when(k == 3, F.concat(F.lit("  "), t, F.lit("  ")))
        .otherwise(F.lit(""))
    )
    return c.select("conv_id", "turn", response.alias("response"))


# ---------------------------------------------------------------------------
# SQL text of the same views (DuckDB oracles; identical rows at sf0.01).
# ---------------------------------------------------------------------------
ITEMS_V_SQL = """
SELECT concat(CASE WHEN doc_id % 41 = 0 THEN 'bad id ' ELSE 'doc_' END, CAST(doc_id AS STRING)) AS id,
       doc_id, source AS topic, lang,
       split_part(text, chr(10), 1) AS statement,
       CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END AS steps_text,
       concat(CASE WHEN doc_id % 31 = 0 THEN 'def ' WHEN doc_id % 2 = 0 THEN 'theorem ' ELSE 'lemma ' END,
              CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '  ') ELSE text END,
              CASE WHEN doc_id % 29 = 0 THEN '' ELSE ' := by simp' END) AS theorem
FROM documents
"""

RECORDS_V_SQL = """
SELECT l_orderkey AS item_id, l_linenumber AS attempt,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INT) AS beam_index,
       (l_linestatus = 'F') AS compiled,
       (l_linestatus = 'F' AND l_returnflag = 'R') AS compile_ok,
       l_quantity AS generation_time,
       concat('code_', CAST(l_partkey AS STRING)) AS code
FROM lineitem
"""

STDERR_V_SQL = """
SELECT event_id, user_id AS item_id, CAST(event_id % 5 + 1 AS INT) AS attempt,
  CASE event_type
   WHEN 'error'    THEN concat('c.lean:', CAST(event_id % 97 AS STRING), ':12: error: unknown identifier ''x', CAST(user_id AS STRING), '''')
   WHEN 'click'    THEN concat('c.lean:3:4: error: type mismatch', chr(10), '  c.lean:9:1: error: unexpected token')
   WHEN 'purchase' THEN concat('error: unsolved goals', chr(10), chr(10), 'note: see above')
   WHEN 'signup'   THEN CASE WHEN event_id % 2 = 0 THEN 'failed to prove termination' ELSE 'mysterious failure' END
   ELSE '' END AS stderr
FROM events
"""

RESPONSES_V_SQL = """
SELECT conv_id, turn,
  CASE (conv_id + turn) % 5
   WHEN 0 THEN concat('Sure:', chr(10), '```lean', chr(10), 'theorem t : ', text, ' := by simp', chr(10), '```', chr(10), 'done')
   WHEN 1 THEN concat('```', chr(10), 'lemma l (a : Nat) := ', text, chr(10), '```')
   WHEN 2 THEN concat('Lean: no', chr(10), 'Lean:', chr(10), 'theorem t (a : ', text, chr(10), chr(10), 'hope it helps')
   WHEN 3 THEN concat('  ', text, '  ')
   ELSE '' END AS response
FROM conversations WHERE role = 'assistant'
"""


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the named binding views as CTEs."""
    texts = {
        "items_v": ITEMS_V_SQL,
        "records_v": RECORDS_V_SQL,
        "stderr_v": STDERR_V_SQL,
        "responses_v": RESPONSES_V_SQL,
    }
    ctes = ",\n".join(f"{v} AS ({texts[v]})" for v in views)
    return f"WITH {ctes}\n{sql}" if views else sql
