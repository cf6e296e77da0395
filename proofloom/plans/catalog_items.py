"""Registered queries for row checks (2.2), dedup/profile/validation (2.3)
and the stratified split (2.4), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as CK
from ..operators import profile as PF
from ..operators import splits as SP
from . import duck as D
from .bindings import items_v, table, with_views

TOPIC = "src3"
N_FIRST = 10
N_PREVIEW = 5


def _items(spark, sf):
    return items_v(spark, sf).withColumn("seq", F.col("doc_id"))


def _docs(spark, sf):
    """documents as items: id = doc_id, topic = source, seq = doc_id."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "lang", "text", F.col("doc_id").alias("seq"))


# ---- 2.2 -------------------------------------------------------------------
def q_check_steps(spark, sf):
    return _items(spark, sf).select("id", CK.steps_error("steps").alias("steps_error"))


def q_check_theorem(spark, sf):
    return _items(spark, sf).select("id", CK.theorem_error("theorem").alias("theorem_error"))


def q_check_id(spark, sf):
    return _items(spark, sf).select("doc_id", CK.id_error("id").alias("id_error"))


def q_quarantine_items(spark, sf):
    rows = CK.with_violations(_items(spark, sf))
    return rows.select("doc_id", (F.size("violations") == 0).alias("accepted"), F.size("violations").alias("n_violations"),
                       F.array_join("violations", " | ").alias("violations"))


def q_filter_topic(spark, sf):
    d = table(spark, sf, "documents")
    return CK.filter_topic(d, TOPIC, col="source").select("doc_id", "lang", "n_chars")


def q_distinct_topics(spark, sf):
    return CK.distinct_topics(table(spark, sf, "documents"), col="source")


def q_limit_first_n(spark, sf):
    return CK.limit_first_n(_docs(spark, sf), N_FIRST).select("id", "topic")


def q_sample_preview(spark, sf):
    return CK.sample_preview(_items(spark, sf), N_PREVIEW)


def q_item_dump(spark, sf):
    return CK.item_dump(_items(spark, sf))


# ---- 2.3 -------------------------------------------------------------------
def q_duplicate_ids(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return PF.duplicate_ids(e)


def q_normalized_hash(spark, sf):
    return PF.with_hash(_docs(spark, sf), "text").select("id", "hash")


def q_duplicate_content_items(spark, sf):
    return PF.duplicate_content_items(_docs(spark, sf), "text").select("id", "hash")


def q_duplicate_summary(spark, sf):
    """Totals and both lists of repeated values, as rows."""
    found = PF.findings(_docs(spark, sf), "text", topic=None)
    return PF.report_rows(found).where("section <> 'n_topics'").drop("rate")


def q_topic_distribution(spark, sf):
    return PF.topic_distribution(_docs(spark, sf))


def q_topic_distribution_by_file(spark, sf):
    return PF.topic_distribution_by_file(_docs(spark, sf), file="lang")


def _pooled(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("file"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("file"))
    return d.unionByName(b)


def q_cross_file_duplicates(spark, sf):
    return PF.cross_file_duplicates(_pooled(spark, sf))


def q_length_profile(spark, sf):
    p = PF.length_profile(_items(spark, sf))
    return p.select("total_items", "n_topics", *[F.round(c, 6).alias(c) for c in ("avg_statement_length", "avg_theorem_length")])


def _verdicts(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 1).alias("ok"),
        F.concat(F.lit("verdict: quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string")).alias("stderr"),
    )


def _vrows(spark, sf):
    return PF.verification_rows(_docs(spark, sf).select("id", "seq"), _verdicts(spark, sf), "id")


def q_verification_rows(spark, sf):
    return _vrows(spark, sf).select("id", "ok", "stderr")


def q_verification_early_stop(spark, sf):
    return PF.verification_early_stop(_vrows(spark, sf)).select("id", "ok", "stderr")


def q_verification_summary(spark, sf):
    s = PF.verification_summary(_vrows(spark, sf))
    return s.withColumn("success_rate", F.round("success_rate", 6))


def _report(spark, sf):
    checked = _vrows(spark, sf)
    return PF.validate_dataset(_docs(spark, sf), "text", checked=checked)


def q_validate_dataset(spark, sf):
    """Totals, both duplicate lists, every topic and the verification totals."""
    rows = PF.report_rows(PF.findings(_docs(spark, sf), "text"), _vrows(spark, sf))
    return rows.withColumn("rate", F.round("rate", 6))


def q_dataset_verdict(spark, sf):
    return PF.dataset_verdict(_report(spark, sf))


def q_issue_samples(spark, sf):
    docs = _docs(spark, sf)
    dups = PF.duplicate_ids(docs, seq="seq")
    fails = _vrows(spark, sf).where(~F.col("ok"))
    return PF.issue_samples(dups, fails)


# ---- 2.4 -------------------------------------------------------------------
def q_split_quotas(spark, sf):
    return SP.split_quotas(_docs(spark, sf))


def q_split_shuffle(spark, sf):
    return _items(spark, sf).select("id", SP.shuffle_key(F.col("id"), 42).alias("shuffle_key"))


def q_split_assign(spark, sf):
    return SP.assign_splits(_items(spark, sf)).select("id", "topic", "topic_rank", "split")


def q_split_summary(spark, sf):
    return SP.split_summary(SP.assign_splits(_items(spark, sf)))


def q_create_splits(spark, sf):
    train, dev, test = SP.create_splits(_items(spark, sf))
    return (
        train.select("id", F.lit("train").alias("split"))
        .unionByName(dev.select("id", F.lit("dev").alias("split")))
        .unionByName(test.select("id", F.lit("test").alias("split")))
    )


QUERIES = {
    "check_steps": q_check_steps,
    "check_theorem": q_check_theorem,
    "check_id": q_check_id,
    "quarantine_items": q_quarantine_items,
    "filter_topic": q_filter_topic,
    "distinct_topics": q_distinct_topics,
    "limit_first_n": q_limit_first_n,
    "sample_preview": q_sample_preview,
    "item_dump": q_item_dump,
    "duplicate_ids": q_duplicate_ids,
    "normalized_hash": q_normalized_hash,
    "duplicate_content_items": q_duplicate_content_items,
    "duplicate_summary": q_duplicate_summary,
    "topic_distribution": q_topic_distribution,
    "topic_distribution_by_file": q_topic_distribution_by_file,
    "cross_file_duplicates": q_cross_file_duplicates,
    "length_profile": q_length_profile,
    "verification_rows": q_verification_rows,
    "verification_early_stop": q_verification_early_stop,
    "verification_summary": q_verification_summary,
    "validate_dataset": q_validate_dataset,
    "dataset_verdict": q_dataset_verdict,
    "issue_samples": q_issue_samples,
    "split_quotas": q_split_quotas,
    "split_shuffle": q_split_shuffle,
    "split_assign": q_split_assign,
    "split_summary": q_split_summary,
    "create_splits": q_create_splits,
}

# ---------------------------------------------------------------------------
# Oracles
# ---------------------------------------------------------------------------
_IT = """
, it AS (SELECT *, string_split(steps_text, chr(10)) AS steps FROM items_v)
"""
_STEPS_ERR = f"""
, st AS (
  SELECT id, doc_id, steps,
    list_filter(list_transform(steps, lambda s, i: {{'i': i, 't': {D.strip('s')}}}), lambda e: length(e.t) < 5) AS bad
  FROM it)
, se AS (
  SELECT id, doc_id, CASE WHEN len(steps) = 0 THEN 'English proof must have at least one step'
    WHEN len(bad) > 0 AND bad[1].t = '' THEN 'Step ' || CAST(bad[1].i AS VARCHAR) || ' cannot be empty'
    WHEN len(bad) > 0 THEN 'Step ' || CAST(bad[1].i AS VARCHAR) || ' is too short: ''' || bad[1].t || ''''
    END AS steps_error FROM st)
"""
_THM_ERR = f"""CASE WHEN coalesce({D.strip('theorem')}, '') = '' THEN 'Theorem cannot be empty'
  WHEN NOT (starts_with({D.strip('theorem')}, 'theorem ') OR starts_with({D.strip('theorem')}, 'lemma '))
  THEN 'Theorem must start with ''theorem'' or ''lemma''' END"""
_ID_ERR = """CASE WHEN coalesce(id, '') = '' THEN 'ID cannot be empty'
  WHEN NOT regexp_matches(translate(id, '_-.', ''), '^[\\p{L}\\p{N}]+$') THEN 'Invalid ID format: ''' || id || '''' END"""


def _iv(sql: str) -> str:
    return with_views(_IT + _STEPS_ERR + sql, "items_v")


_DOCS = ", docs AS (SELECT doc_id AS id, source AS topic, lang, text, doc_id AS seq FROM documents)\n"
_VROWS = """
, vr AS (
  SELECT d.id, d.seq, coalesce(l.quality = 1, false) AS ok,
    CASE WHEN coalesce(l.quality = 1, false) THEN NULL
         WHEN l.doc_id IS NULL THEN 'Exception during compilation: no verdict'
         ELSE 'verdict: quality ' || CAST(l.quality AS VARCHAR) || ', toxic ' || CAST(l.toxic AS VARCHAR) END AS stderr
  FROM docs d LEFT JOIN labels l ON d.id = l.doc_id)
, fcut AS (SELECT CASE WHEN count(*) >= 5 THEN max(seq) END AS cut FROM (SELECT seq FROM vr WHERE NOT ok ORDER BY seq LIMIT 5))
, es AS (SELECT vr.* FROM vr, fcut WHERE fcut.cut IS NULL OR vr.seq <= fcut.cut)
, vs AS (SELECT count(*) AS total_checked, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed,
                round(coalesce(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / nullif(count(*), 0), 0.0), 6) AS success_rate FROM vr)
, ds AS (SELECT (SELECT count(*) FROM docs) AS total_items, (SELECT count(DISTINCT id) FROM docs) AS unique_ids,
                (SELECT count(*) FROM (SELECT id FROM docs GROUP BY id HAVING count(*) > 1)) AS n_duplicate_ids,
                (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM docs WHERE text IS NOT NULL GROUP BY {h} HAVING count(*) > 1)) AS n_duplicate_content_items,
                (SELECT count(DISTINCT topic) FROM docs) AS n_topics)
""".replace("{h}", D.sha16(D.collapse("text")))


_LISTS = """
, ds_rows AS (SELECT 'total_items' AS section, CAST(NULL AS VARCHAR) AS key, total_items AS n FROM ds
  UNION ALL SELECT 'unique_ids', NULL, unique_ids FROM ds UNION ALL SELECT 'n_duplicate_ids', NULL, n_duplicate_ids FROM ds
  UNION ALL SELECT 'n_duplicate_content_items', NULL, n_duplicate_content_items FROM ds)
, dup_rows AS (SELECT 'duplicate_ids' AS section, CAST(id AS VARCHAR) AS key, count(*) AS n FROM docs GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_content', {h}, count(*) FROM docs WHERE text IS NOT NULL GROUP BY {h} HAVING count(*) > 1)
""".replace("{h}", D.sha16(D.collapse("text")))


def _dv(sql: str) -> str:
    return "WITH _x AS (SELECT 1)\n" + _DOCS + _VROWS + sql


SPLIT_SQL = """
, keyed AS (SELECT id, topic, sha256('42:' || id) AS k FROM items_v)
, rk AS (SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY k, id) AS r, count(*) OVER (PARTITION BY topic) AS n FROM keyed)
, q AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(floor(n * 0.6) AS BIGINT)) ELSE 1 END AS nt,
               CASE WHEN n >= 3 THEN greatest(1, CAST(floor(n * 0.2) AS BIGINT)) WHEN n = 2 THEN 1 ELSE 0 END AS nd FROM rk)
, sa AS (SELECT id, topic, r AS topic_rank, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nd THEN 'dev' ELSE 'test' END AS split FROM q)
"""


def _sv(sql: str) -> str:
    return with_views(SPLIT_SQL + sql, "items_v")


ORACLES = {
    "check_steps": _iv("SELECT id, steps_error FROM se"),
    "check_theorem": with_views(f"SELECT id, {_THM_ERR} AS theorem_error FROM items_v", "items_v"),
    "check_id": with_views(f"SELECT doc_id, {_ID_ERR} AS id_error FROM items_v", "items_v"),
    "quarantine_items": _iv(
        f"""
, x AS (SELECT doc_id, {_THM_ERR} AS te, {_ID_ERR} AS ie FROM it)
, v AS (SELECT x.doc_id, list_filter([se.steps_error, x.te, x.ie], lambda e: e IS NOT NULL) AS vs
        FROM x JOIN se ON se.doc_id = x.doc_id)
SELECT doc_id, len(vs) = 0 AS accepted, CAST(len(vs) AS INT) AS n_violations, array_to_string(vs, ' | ') AS violations FROM v"""
    ),
    "filter_topic": f"SELECT doc_id, lang, n_chars FROM documents WHERE source = '{TOPIC}'",
    "distinct_topics": "SELECT DISTINCT source AS topic FROM documents",
    "limit_first_n": f"SELECT doc_id AS id, source AS topic FROM documents ORDER BY doc_id LIMIT {N_FIRST}",
    "sample_preview": with_views(
        f"""SELECT id, topic, statement,
  CASE WHEN length(theorem) > 80 THEN substr(theorem, 1, 80) || '...' ELSE theorem END AS theorem_preview,
  CAST(NULL AS VARCHAR) AS imports
FROM items_v ORDER BY doc_id LIMIT {N_PREVIEW}""",
        "items_v",
    ),
    "item_dump": with_views(
        _IT
        + """SELECT id, to_json({'id': id, 'topic': topic, 'english': {'statement': statement, 'steps': steps},
                         'lean': {'imports': CAST([] AS VARCHAR[]), 'theorem': theorem}})::VARCHAR AS json FROM it""",
        "items_v",
    ),
    "duplicate_ids": "SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1",
    "normalized_hash": f"SELECT doc_id AS id, {D.sha16(D.collapse('text'))} AS hash FROM documents",
    "duplicate_content_items": f"""
WITH h AS (SELECT doc_id AS id, {D.sha16(D.collapse('text'))} AS hash FROM documents)
SELECT id, hash FROM h WHERE hash IN (SELECT hash FROM h GROUP BY hash HAVING count(*) > 1)""",
    "duplicate_summary": _dv(_LISTS + "SELECT section, key, n FROM ds_rows UNION ALL SELECT section, key, n FROM dup_rows"),
    "topic_distribution": "SELECT source AS topic, count(*) AS n FROM documents GROUP BY source",
    "topic_distribution_by_file": "SELECT lang AS file, source AS topic, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (source), ())",
    "cross_file_duplicates": f"""
WITH p AS (SELECT doc_id AS id, text, 'documents' AS file FROM documents UNION ALL SELECT item_id AS id, text, 'benchmark' AS file FROM benchmark)
SELECT 'id' AS kind, CAST(id AS VARCHAR) AS key, count(*) AS n_items, array_to_string(list_sort(list_distinct(list(file))), ',') AS files
FROM p WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'content' AS kind, {D.sha16(D.collapse('text'))} AS key, count(*) AS n_items, array_to_string(list_sort(list_distinct(list(file))), ',') AS files
FROM p WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1""",
    "length_profile": with_views(
        "SELECT count(*) AS total_items, count(DISTINCT topic) AS n_topics, round(avg(length(statement)), 6) AS avg_statement_length, "
        "round(avg(length(theorem)), 6) AS avg_theorem_length FROM items_v",
        "items_v",
    ),
    "verification_rows": _dv("SELECT id, ok, stderr FROM vr"),
    "verification_early_stop": _dv("SELECT id, ok, stderr FROM es"),
    "verification_summary": _dv("SELECT * FROM vs"),
    "validate_dataset": _dv(
        _LISTS + """
SELECT section, key, n, CAST(NULL AS DOUBLE) AS rate FROM (SELECT * FROM ds_rows UNION ALL SELECT * FROM dup_rows
  UNION ALL SELECT 'n_topics', NULL, n_topics FROM ds UNION ALL SELECT 'topics', topic, count(*) FROM docs GROUP BY topic
  UNION ALL SELECT 'total_checked', NULL, total_checked FROM vs UNION ALL SELECT 'successful', NULL, successful FROM vs
  UNION ALL SELECT 'failed', NULL, failed FROM vs)
UNION ALL SELECT 'success_rate' AS section, NULL AS key, NULL AS n, success_rate AS rate FROM vs"""
    ),
    "dataset_verdict": _dv("SELECT (n_duplicate_ids = 0 AND n_duplicate_content_items = 0 AND failed = 0) AS is_valid FROM ds, vs"),
    "issue_samples": _dv(
        """
, dup AS (SELECT 'duplicate_id' AS kind, CAST(id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail
          FROM (SELECT id, min(seq) AS s FROM docs GROUP BY id HAVING count(*) > 1 ORDER BY s LIMIT 5))
, fl AS (SELECT 'failure' AS kind, CAST(id AS VARCHAR) AS id, substr(stderr, 1, 60) || '...' AS detail
         FROM (SELECT * FROM vr WHERE NOT ok ORDER BY seq LIMIT 3))
, mo AS (SELECT 'more_failures' AS kind, CAST(NULL AS VARCHAR) AS id, CAST(greatest(count(*) - 3, 0) AS VARCHAR) AS detail FROM vr WHERE NOT ok)
SELECT * FROM dup UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM mo"""
    ),
    "split_quotas": """
WITH c AS (SELECT source AS topic, count(*) AS n FROM documents GROUP BY source)
, q AS (SELECT topic, n, CASE WHEN n >= 3 THEN greatest(1, CAST(floor(n * 0.6) AS BIGINT)) ELSE 1 END AS n_train,
        CASE WHEN n >= 3 THEN greatest(1, CAST(floor(n * 0.2) AS BIGINT)) WHEN n = 2 THEN 1 ELSE 0 END AS n_dev FROM c)
SELECT topic, n, n_train, n_dev, n - n_train - n_dev AS n_test FROM q""",
    "split_shuffle": with_views("SELECT id, sha256('42:' || id) AS shuffle_key FROM items_v", "items_v"),
    "split_assign": _sv("SELECT id, topic, topic_rank, split FROM sa"),
    "split_summary": _sv("SELECT split, topic, count(*) AS n FROM sa GROUP BY GROUPING SETS ((split), (split, topic))"),
    "create_splits": _sv("SELECT id, split FROM sa"),
}
