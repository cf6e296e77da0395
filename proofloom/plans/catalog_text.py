"""Registered queries for the reply job (2.5) and the checker-output
classification job (2.6), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import prompts as PR
from ..functions import text as TX
from ..operators import classify as CL
from ..operators import memo as MM
from ..operators import replies as RP
from ..operators import splits as SP
from ..operators.stages import where_computed
from ..operators.rounds import RetrySchedule, schedule_column
from . import duck as D
from .bindings import items_v, records_v, responses_v, stderr_v, table, with_views
from .catalog_items import SPLIT_SQL

#: Import line of a module whose item names none.
DEFAULT_IMPORT = "Main.Basic"

# ---------------------------------------------------------------------------
# 2.5 reply post-processing
# ---------------------------------------------------------------------------


def _cands(spark, sf):
    return RP.candidates_from_replies(responses_v(spark, sf))


def q_extract_code(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select("conv_id", "turn", "code")


def q_check_balance(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("code")
    return _cands(spark, sf).select(
        "conv_id", "turn",
        TX.balanced(c, "(", ")").alias("parens_ok"),
        TX.balanced(c, "[", "]").alias("brackets_ok"),
        TX.balanced(c, "{", "}").alias("braces_ok"),
    )


def q_check_declaration(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select("conv_id", "turn", TX.has_declaration("code").alias("has_declaration"))


def q_check_body(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select("conv_id", "turn", TX.has_body("code").alias("has_body"))


def q_check_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Over whole ``documents`` texts (four languages, so many flagged)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(TX.suspicious_chars("text"), "").alias("suspicious"))


def q_check_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select("conv_id", "turn", TX.odd_quotes("code").alias("odd_quotes"))


def q_validate_code(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select(
        "conv_id", "turn", "is_valid", F.size("errors").alias("n_errors"),
        F.array_join("errors", " | ").alias("errors"),
    )


def q_reply_quality(spark: SparkSession, sf: str) -> DataFrame:
    c = _cands(spark, sf).withColumn("attempt", (F.col("turn") + 1).cast("int"))
    return RP.reply_quality(c).withColumn("valid_share", F.round("valid_share", 6))


def q_invalid_reason(spark: SparkSession, sf: str) -> DataFrame:
    return RP.invalid_reason(_cands(spark, sf)).select("conv_id", "turn", "invalid_reason")


def q_prompt_full(spark: SparkSession, sf: str) -> DataFrame:
    it = items_v(spark, sf)
    return it.select("id", PR.prompt_full("statement", "steps").alias("prompt"))


def q_prompt_initial(spark: SparkSession, sf: str) -> DataFrame:
    it = items_v(spark, sf)
    return it.select("id", PR.prompt_initial("statement", "steps").alias("prompt"))


def q_prompt_repair(spark: SparkSession, sf: str) -> DataFrame:
    s = where_computed(CL.with_primary_error(stderr_v(spark, sf)), F.col("primary_error").isNotNull())
    stub = PR.repair_stub(F.concat(F.lit("item "), F.col("item_id").cast("string")))
    p = PR.prompt_repair(F.col("primary_error.category"), F.col("primary_error.message"), stub)
    return s.select("event_id", p.alias("prompt"))


def q_render_module(spark: SparkSession, sf: str) -> DataFrame:
    it = items_v(spark, sf)
    return TX.with_rendered_module(it.select("id", "theorem", "imports"), "theorem", "imports", DEFAULT_IMPORT).select("id", "module")


def q_content_key(spark: SparkSession, sf: str) -> DataFrame:
    r = records_v(spark, sf)
    return r.select("item_id", "attempt", "beam_index", TX.content_key("code").alias("content_key"))


def q_params_key(spark: SparkSession, sf: str) -> DataFrame:
    """Generation key per record: hash of the prompt (the record's code
    stands in for it) joined to the hash of the sorted parameters."""
    r = records_v(spark, sf)
    sched = F.filter(schedule_column(RetrySchedule.of(attempts=7)), lambda s: s["attempt"] == F.col("attempt"))
    temp = F.element_at(sched, 1)["temperature"]
    seed = (F.col("attempt") * 100 + F.col("beam_index")).cast("int")
    key = MM.generation_key(F.col("code"), max_tokens=F.lit(S.DEFAULT_MAX_TOKENS), seed=seed, temperature=temp)
    return r.select("item_id", "attempt", "beam_index", MM.shown_key(key).alias("params_key"))


def q_code_length(spark: SparkSession, sf: str) -> DataFrame:
    r = records_v(spark, sf)
    return r.select("item_id", "attempt", "beam_index", TX.code_length("code").alias("code_length"))


def q_parse_steps_text(spark: SparkSession, sf: str) -> DataFrame:
    """documents.text with ';' in place of sentence stops, parsed to steps."""
    d = table(spark, sf, "documents")
    steps = PR.parse_steps_text(F.replace(F.col("text"), F.lit("."), F.lit(";")))
    return d.select("doc_id", F.size(steps).alias("n_steps"), F.array_join(steps, "|").alias("steps"))


# ---------------------------------------------------------------------------
# 2.6 checker-output classification
# ---------------------------------------------------------------------------


def _lines(spark, sf):
    return CL.error_lines(stderr_v(spark, sf))


def q_stderr_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("event_id", "pos", "line")


def q_line_number(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("event_id", "pos", "line_number")


def q_classify_line(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("event_id", "pos", "category")


def q_fix_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("event_id", "pos", F.array_join("suggested_fixes", " | ").alias("fixes"))


def q_classify_stderr(spark: SparkSession, sf: str) -> DataFrame:
    s = CL.with_classified(stderr_v(spark, sf))
    return s.select(
        "event_id",
        F.size("errors").alias("n_errors"),
        F.array_join(F.transform("errors", lambda e: e["category"]), ",").alias("categories"),
    )


def q_primary_error(spark: SparkSession, sf: str) -> DataFrame:
    s = CL.with_primary_error(stderr_v(spark, sf))
    return s.select(
        "event_id",
        F.col("primary_error.category").alias("category"),
        F.col("primary_error.message").alias("message"),
        F.col("primary_error.line_number").alias("line_number"),
    )


def q_errors_encountered(spark: SparkSession, sf: str) -> DataFrame:
    e = CL.errors_encountered(stderr_v(spark, sf))
    return e.select("item_id", "attempt", "event_id", F.col("primary_error.category").alias("category"))


def q_error_context(spark: SparkSession, sf: str) -> DataFrame:
    sched = F.transform(schedule_column(RetrySchedule()), lambda s: s["attempt"])
    ctx = CL.error_context(stderr_v(spark, sf), order=("event_id",), attempts=sched)
    return ctx.select(
        "item_id", "attempt",
        F.col("error_context.category").alias("category"),
        F.col("error_context.message").alias("message"),
    )


def q_error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Error lines by split and attempt; lines of items outside the data set
    have no split."""
    split = SP.assign_splits(items_v(spark, sf).select("doc_id", "id", "topic")).select(F.col("doc_id").alias("item_id"), "split")
    # Counts per item first: the join moves one row per item and category.
    per_item = CL.error_histogram(_lines(spark, sf), by=("item_id", "attempt"))
    tagged = per_item.join(split, "item_id", "left")
    return tagged.groupBy("split", "attempt", "category").agg(F.sum("n_errors").alias("n_errors"))


def q_error_report(spark: SparkSession, sf: str) -> DataFrame:
    ln = _lines(spark, sf)
    return ln.select(
        "event_id", "pos", "category", F.col("line").alias("message"), "line_number",
        F.lit(S.SEVERITY_ERROR).alias("severity"),
        F.array_join("suggested_fixes", " | ").alias("suggested_fixes"),
    )


QUERIES = {
    "extract_code": q_extract_code,
    "check_balance": q_check_balance,
    "check_declaration": q_check_declaration,
    "check_body": q_check_body,
    "check_symbols": q_check_symbols,
    "check_quotes": q_check_quotes,
    "validate_code": q_validate_code,
    "reply_quality": q_reply_quality,
    "invalid_reason": q_invalid_reason,
    "prompt_full": q_prompt_full,
    "prompt_initial": q_prompt_initial,
    "prompt_repair": q_prompt_repair,
    "render_module": q_render_module,
    "content_key": q_content_key,
    "params_key": q_params_key,
    "code_length": q_code_length,
    "parse_steps_text": q_parse_steps_text,
    "stderr_lines": q_stderr_lines,
    "line_number": q_line_number,
    "classify_line": q_classify_line,
    "fix_suggestions": q_fix_suggestions,
    "classify_stderr": q_classify_stderr,
    "primary_error": q_primary_error,
    "errors_encountered": q_errors_encountered,
    "error_context": q_error_context,
    "error_histogram": q_error_histogram,
    "error_report": q_error_report,
}

# ---------------------------------------------------------------------------
# Oracles
# ---------------------------------------------------------------------------
_CANDS = f"""
, cands AS (SELECT conv_id, turn, {D.extract_code('response')} AS code FROM responses_v)
, cv AS (SELECT conv_id, turn, code, {D.code_errors('code')} AS errors FROM cands)
"""


def _cv(sql: str) -> str:
    return with_views(_CANDS + sql, "responses_v")


_LINES = f"""
, lines AS ({D.stderr_lines_cte('stderr_v', 'event_id')})
, cl AS (SELECT event_id, pos, line, {D.classify_line('line')} AS category FROM lines)
, prim AS (
  SELECT event_id, arg_min(category, {D.priority('category')} * 100000 + pos) AS category,
         arg_min(line, {D.priority('category')} * 100000 + pos) AS message
  FROM cl GROUP BY event_id)
"""


def _sv(sql: str) -> str:
    return with_views(_LINES + sql, "stderr_v")


_NO_STEPS = D.q(S.NO_STEPS_TEXT)
_BLANK_LINES_EMPTIED = "regexp_replace(theorem, '(?m)^[ \\t]+$', '', 'g')"
_STEPS_JOINED = "array_to_string(string_split(steps_text, chr(10)), ', ')"

ORACLES = {
    "extract_code": _cv("SELECT conv_id, turn, code FROM cands"),
    "check_balance": _cv(
        f"SELECT conv_id, turn, {D.count_char('code', '(')} = {D.count_char('code', ')')} AS parens_ok, "
        f"{D.count_char('code', '[')} = {D.count_char('code', ']')} AS brackets_ok, "
        f"{D.count_char('code', '{')} = {D.count_char('code', '}')} AS braces_ok FROM cands"
    ),
    "check_declaration": _cv(f"SELECT conv_id, turn, regexp_matches(code, '{D.DECL_RE}') AS has_declaration FROM cands"),
    "check_body": _cv(f"SELECT conv_id, turn, regexp_matches(code, '{D.BODY_RE}') AS has_body FROM cands"),
    "check_symbols": f"SELECT doc_id, array_to_string({D.suspicious('text')}, '') AS suspicious FROM documents",
    "check_quotes": _cv(f"SELECT conv_id, turn, {D.count_char('code', chr(34))} % 2 <> 0 AS odd_quotes FROM cands"),
    "validate_code": _cv(
        "SELECT conv_id, turn, len(errors) = 0 AS is_valid, CAST(len(errors) AS INT) AS n_errors, "
        "array_to_string(errors, ' | ') AS errors FROM cv"
    ),
    "reply_quality": _cv(
        """
, att AS (SELECT CAST(turn + 1 AS INT) AS attempt, errors FROM cv)
, pa AS (SELECT attempt, count(*) AS replies, round(avg(CASE WHEN len(errors) = 0 THEN 1.0 ELSE 0.0 END), 6) AS valid_share FROM att GROUP BY attempt)
, pe AS (SELECT attempt, regexp_replace(e, '(?s): \\{.*\\}$', '') AS error, count(*) AS error_count
         FROM (SELECT attempt, unnest(errors) AS e FROM att) GROUP BY 1, 2)
SELECT pa.attempt, coalesce(pe.error, '') AS error, coalesce(pe.error_count, 0) AS error_count, replies, valid_share
FROM pa LEFT JOIN pe ON pa.attempt = pe.attempt"""
    ),
    "invalid_reason": _cv(
        "SELECT conv_id, turn, CASE WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS invalid_reason FROM cv"
    ),
    "prompt_full": with_views(
        f"SELECT id, replace(replace({D.q(__import__('proofloom.functions.prompts', fromlist=['x']).DEFAULT_FULL_TEMPLATE)}, "
        f"'{{statement}}', coalesce(statement, '')), '{{steps}}', "
        f"CASE WHEN len(string_split(steps_text, chr(10))) > 0 THEN {_STEPS_JOINED} ELSE {_NO_STEPS} END) AS prompt FROM items_v",
        "items_v",
    ),
    "prompt_initial": with_views(
        f"SELECT id, {D.q(S.INITIAL_PROMPT_HEAD)} || coalesce(statement, '') || chr(10) || "
        f"{D.q(S.INITIAL_PROMPT_STEPS)} || {_STEPS_JOINED} || chr(10) AS prompt FROM items_v",
        "items_v",
    ),
    "prompt_repair": _sv(
        f"SELECT p.event_id, {D.repair_prompt('p.category', 'p.message', D.q(S.REPAIR_STUB_HEAD) + ' || ' + chr(39) + 'item ' + chr(39) + ' || CAST(s.item_id AS VARCHAR) || ' + D.q(S.REPAIR_STUB_TAIL))} AS prompt "
        "FROM prim p JOIN stderr_v s ON p.event_id = s.event_id"
    ),
    "render_module": with_views(
        f"SELECT id, 'import {DEFAULT_IMPORT}' || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END || chr(10) AS module "
        f"FROM (SELECT id, {D.strip(_BLANK_LINES_EMPTIED)} AS body FROM items_v)",
        "items_v",
    ),
    "content_key": with_views(
        f"SELECT item_id, attempt, beam_index, {D.sha16('code')} AS content_key FROM records_v", "records_v"
    ),
    "params_key": with_views(
        f"""SELECT item_id, attempt, beam_index,
  {D.sha16('code')} || '_' || {D.sha16("'{\"max_tokens\":512,\"seed\":' || CAST(attempt * 100 + beam_index AS VARCHAR) || ',\"temperature\":' || CAST([0.3, 0.5, 0.5, 0.7, 0.8, 0.8, 0.8][attempt] AS VARCHAR) || '}'")} AS params_key
FROM records_v""",
        "records_v",
    ),
    "code_length": with_views(
        "SELECT item_id, attempt, beam_index, CAST(coalesce(length(code), 0) AS INT) AS code_length FROM records_v",
        "records_v",
    ),
    "parse_steps_text": f"""
SELECT doc_id, CAST(len(steps) AS INT) AS n_steps, array_to_string(steps, '|') AS steps FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.', ';'), ';'), lambda x: {D.strip('x')}), lambda x: x <> '') AS steps
  FROM documents)""",
    "stderr_lines": _sv("SELECT event_id, pos, line FROM lines"),
    "line_number": _sv(f"SELECT event_id, pos, {D.line_number('line')} AS line_number FROM lines"),
    "classify_line": _sv("SELECT event_id, pos, category FROM cl"),
    "fix_suggestions": _sv(f"SELECT event_id, pos, {D.fixes('category', 'line')} AS fixes FROM cl"),
    "classify_stderr": _sv(
        """SELECT s.event_id, CAST(count(cl.pos) AS INT) AS n_errors,
  coalesce(string_agg(cl.category, ',' ORDER BY cl.pos), '') AS categories
FROM stderr_v s LEFT JOIN cl ON s.event_id = cl.event_id GROUP BY s.event_id"""
    ),
    "primary_error": _sv(
        f"""SELECT s.event_id, p.category, p.message, {D.line_number('p.message')} AS line_number
FROM stderr_v s LEFT JOIN prim p ON s.event_id = p.event_id"""
    ),
    "errors_encountered": _sv(
        "SELECT s.item_id, s.attempt, s.event_id, p.category FROM prim p JOIN stderr_v s ON p.event_id = s.event_id"
    ),
    "error_context": _sv(
        """
, la AS (SELECT s.item_id, s.attempt, arg_max(p.category, s.event_id) AS category, arg_max(p.message, s.event_id) AS message
         FROM prim p JOIN stderr_v s ON p.event_id = s.event_id GROUP BY s.item_id, s.attempt)
, grid AS (SELECT i.item_id, CAST(a.attempt AS INT) AS attempt FROM (SELECT DISTINCT item_id FROM stderr_v) i,
           (SELECT unnest([1, 2, 3, 4, 5]) AS attempt) a)
SELECT g.item_id, g.attempt,
  last_value(la.category IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS category,
  last_value(la.message IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS message
FROM grid g LEFT JOIN la ON g.item_id = la.item_id AND g.attempt = la.attempt"""
    ),
    "error_histogram": with_views(
        _LINES + SPLIT_SQL + ", sp AS (SELECT i.doc_id, sa.split FROM sa JOIN items_v i ON i.id = sa.id) "
        "SELECT sp.split, s.attempt, cl.category, count(*) AS n_errors FROM cl JOIN stderr_v s ON cl.event_id = s.event_id "
        "LEFT JOIN sp ON sp.doc_id = s.item_id GROUP BY 1, 2, 3",
        "items_v", "stderr_v",
    ),
    "error_report": _sv(
        f"SELECT event_id, pos, category, line AS message, {D.line_number('line')} AS line_number, 'error' AS severity, "
        f"{D.fixes('category', 'line')} AS suggested_fixes FROM cl"
    ),
}
