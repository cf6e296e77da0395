"""Registered queries for candidate generation, memo tables and retry
rounds (2.7).  Replies are the assistant turns of ``conversations``, verdicts
the ``labels`` of the documents whose theorems are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as TX
from ..operators import batch as B
from ..operators import classify as CL
from ..operators import memo as MM
from ..operators import results as R
from ..operators import rounds as RD
from ..operators.stages import where_computed
from ..session import tasks_for
from . import duck as D
from .bindings import items_v, records_v, responses_v, stderr_v, table, with_views
from .catalog_text import _LINES

SCHED = RD.RetrySchedule()
#: The bound records have seven attempts (``bindings.records_v``).
RECORD_SCHED = RD.RetrySchedule.of(attempts=7)
MODEL = "model"


def _round_items(spark, sf):
    it = items_v(spark, sf)
    return it.select(F.col("doc_id").alias("item_id"), "id", "statement", "steps")


def q_schedule_table(spark, sf):
    counts = records_v(spark, sf).groupBy("attempt").agg(F.count(F.lit(1)).alias("n_records"))
    sched = RD.schedule_table(spark, RECORD_SCHED)  # one row per attempt
    # the per-attempt counts are a tiny aggregate; AQE broadcasts them
    return sched.join(counts, "attempt", "left").select(
        "attempt", "beam_size", "temperature", "max_tokens", F.coalesce("n_records", F.lit(0)).alias("n_records")
    )


def q_slot_expand(spark, sf):
    return RD.slot_expand(_round_items(spark, sf), SCHED).select("id", "attempt", "beam_index", "seed", "temperature")


def _contexts(spark, sf):
    attempts = F.array(*[F.lit(a) for a in range(1, SCHED.attempts + 1)])
    return CL.error_context(stderr_v(spark, sf), order=("event_id",), attempts=attempts)


def q_slot_prompt(spark, sf):
    """One prompt per item and attempt, hashed before the beams share it.  The
    contexts join as one map per item (an entry per attempt at most), so texts
    are shuffled once."""
    known = _contexts(spark, sf).where(F.col("error_context").isNotNull())
    contexts = known.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("attempt", "error_context"))).alias("contexts"))
    rows = _round_items(spark, sf).join(contexts, "item_id", "left").select("*", F.inline(RD.schedule_column(SCHED)))
    rows = rows.withColumn("error_context", F.try_element_at("contexts", F.col("attempt")))
    p = RD.slot_prompt(rows).select("id", "attempt", "beam_size", F.col("error_context").isNotNull().alias("is_repair"),
                                    TX.sha16("prompt").alias("prompt_key"))
    beams = F.explode(F.sequence(F.lit(0), F.col("beam_size") - 1)).alias("beam_index")
    return p.select("id", "attempt", beams, "is_repair", "prompt_key")


def _answered(spark, sf, work):
    """Candidates of (conv_id, turn) requests: the reply to a turn is the
    assistant turn after it."""
    replies = responses_v(spark, sf).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("response").alias("reply"))
    return B.candidate_columns(B.recorded_replies(work, replies, ["conv_id", "turn"]))


def _generated(spark, sf):
    users = table(spark, sf, "conversations").where(F.col("role") == "user")
    return _answered(spark, sf, users.select("conv_id", "turn"))


def q_generate_batch(spark, sf):
    """A reply for every user turn, extracted and validated."""
    c = _generated(spark, sf)
    return c.select("conv_id", "turn", "code", "is_valid", F.array_join("errors", " | ").alias("errors"))


def q_generation_failed(spark, sf):
    """User turns that got no reply: failed candidates."""
    c = _generated(spark, sf).where(F.col("gen_error").isNotNull())
    return c.select("conv_id", "turn", "code", "is_valid", F.array_join("errors", " | ").alias("errors"))


def q_single_attempt(spark, sf):
    """One attempt with three beams per conversation: beam i asks at turn 2i."""
    convs = table(spark, sf, "conversations").select("conv_id").distinct()
    slots = RD.slot_expand(convs, RD.RetrySchedule((3,), (0.5,), SCHED.token_limit), 1)
    c = _answered(spark, sf, slots.select("conv_id", "beam_index", (F.col("beam_index") * 2).cast("long").alias("turn")))
    return c.select("conv_id", "beam_index", "code", "is_valid")


def _requests(spark, sf):
    return _keyed(records_v(spark, sf))


def _keyed(r):
    temps = F.element_at(F.array(*[F.lit(t) for t in RECORD_SCHED.temperatures]), F.col("attempt"))
    key = MM.generation_key(F.col("code"), max_tokens=F.lit(SCHED.token_limit), model=F.lit(MODEL),
                            seed=(F.col("attempt") * 100 + F.col("beam_index")).cast("int"), temperature=temps)
    return r.withColumn("gen_key", key).withColumn("content_key", TX.digest("code"))


ORDER = ["item_id", "attempt", "beam_index"]


def q_memo_generation(spark, sf):
    """Generation requests of all records; a key seen earlier in the run is
    served from the memo."""
    req = _requests(spark, sf)
    marked = MM.mark_repeats(req, "gen_key", ORDER)
    return marked.select(*ORDER, MM.shown_key(F.col("gen_key")).alias("gen_key"), "from_memo")


def _theorems(spark, sf):
    """Check requests: every item's theorem, keyed by its whole digest."""
    code = F.coalesce(F.col("theorem"), F.lit(""))
    return items_v(spark, sf).select("doc_id", code.alias("code")).withColumn("content_key", F.sha2("code", 256))


def _verdicts(spark, sf, theorems):
    """Recorded verdict per theorem, from the labels of its documents."""
    top = lambda c: F.coalesce(F.max(c), F.lit(0))
    v = theorems.join(table(spark, sf, "labels"), "doc_id").groupBy("content_key").agg(top("quality").alias("q"), top("toxic").alias("t"))
    message = F.concat(F.lit("error: quality "), F.col("q").cast("string"), F.lit(", toxic "), F.col("t").cast("string"))
    ok = F.col("q") == 1
    return v.select("content_key", ok.alias("ok"), F.when(ok, "").otherwise(message).alias("stderr"))


def q_memo_check(spark, sf):
    """Check requests of all theorems: each distinct one is looked up once
    (work list), every request gets its verdict; repeats come from the memo."""
    req = _theorems(spark, sf)
    verdicts = B.recorded_verdicts(MM.work_list(req, "content_key", None), _verdicts(spark, sf, req))
    flagged = MM.mark_repeats(req, "content_key", ["doc_id"])
    return flagged.join(verdicts, "content_key", "left").select(
        "doc_id", F.substring("content_key", 1, 16).alias("content_key"), "from_memo", "ok", "check_error"
    )


#: Requests whose keys a task makes at most, on average.
REQUESTS = 500_000


def q_memo_stats(spark, sf):
    """The keys are many times a request's own columns, and the table that
    tells them apart holds them all: requests are dealt out by what the keys
    are made of before the keys are, over as many tasks as they need."""
    r = records_v(spark, sf).select("code", "attempt", "beam_index")
    req = _keyed(r.repartition(tasks_for(r, REQUESTS), "code", "attempt", "beam_index"))
    out = MM.run_stats(req, {"generation_": "gen_key", "check_": "content_key"})
    return out.select(*[F.round(x, 6).alias(x) if x.endswith("hit_rate") else x for x in out.columns])


def _checked(spark, sf):
    c = _theorems(spark, sf).withColumn("errors", TX.code_errors("code"))
    c = c.withColumn("checkable", (F.size("errors") == 0) & (TX.py_strip("code") != ""))
    work = MM.work_list(where_computed(c, F.col("checkable")), "content_key", None)
    return c, B.recorded_verdicts(work, _verdicts(spark, sf, _theorems(spark, sf)))


def q_check_batch(spark, sf):
    c, v = _checked(spark, sf)
    return where_computed(c, F.col("checkable")).join(v, "content_key").select("doc_id", "ok", "stderr", "check_error")


def q_skip_invalid(spark, sf):
    """Every theorem becomes a record; only valid, non-blank code is checked."""
    c, v = _checked(spark, sf)
    return B.check_records(c, v).select("doc_id", "compiled", "compile_ok", "compile_stderr", "run_error")


def q_stop_at_first_success(spark, sf):
    return R.stop_at_first_success(records_v(spark, sf)).select("item_id", "attempt", "beam_index")


def q_pending_items(spark, sf):
    """(item, attempt) pairs an item reaches: every attempt up to and
    including its first success, all attempts when it never succeeds."""
    rec = records_v(spark, sf)
    items = rec.select("item_id").distinct()
    firsts = R.first_success(rec)
    last = F.coalesce(F.col("first_ok.attempt"), F.lit(RECORD_SCHED.attempts))
    return items.join(firsts, "item_id", "left").select("item_id", F.explode(F.sequence(F.lit(1), last)).alias("attempt"))


QUERIES = {
    "schedule_table": q_schedule_table,
    "slot_expand": q_slot_expand,
    "slot_prompt": q_slot_prompt,
    "generate_batch": q_generate_batch,
    "generation_failed": q_generation_failed,
    "single_attempt": q_single_attempt,
    "memo_generation": q_memo_generation,
    "memo_check": q_memo_check,
    "memo_stats": q_memo_stats,
    "check_batch": q_check_batch,
    "skip_invalid": q_skip_invalid,
    "stop_at_first_success": q_stop_at_first_success,
    "pending_items": q_pending_items,
}

# ---------------------------------------------------------------------------
# Oracles
# ---------------------------------------------------------------------------
_SCHED_SQL = "(SELECT * FROM (VALUES (1, 1, 0.3), (2, 3, 0.5), (3, 3, 0.5), (4, 5, 0.7), (5, 5, 0.8)) t(attempt, beam_size, temperature))"
_RECORD_SCHED_SQL = _SCHED_SQL.replace("(5, 5, 0.8)", "(5, 5, 0.8), (6, 5, 0.8), (7, 5, 0.8)")
_SLOTS = f"""
, sl AS (SELECT i.doc_id AS item_id, i.id, i.statement, i.steps_text, CAST(s.attempt AS INT) AS attempt,
                CAST(s.temperature AS DOUBLE) AS temperature, CAST(unnest(generate_series(0, s.beam_size - 1)) AS INT) AS beam_index
         FROM items_v i, {_SCHED_SQL} s)
"""
_INITIAL = (
    f"{D.q(S.INITIAL_PROMPT_HEAD)} || coalesce(statement, '') || chr(10) || {D.q(S.INITIAL_PROMPT_STEPS)} || "
    "array_to_string(string_split(steps_text, chr(10)), ', ') || chr(10)"
)


def _gen_sql(requests: str, select: str) -> str:
    """Candidates of (conv_id, turn, beam_index) requests."""
    return with_views(
        f"""
, req AS ({requests})
, rep AS (SELECT conv_id, turn - 1 AS turn, response FROM responses_v)
, g AS (SELECT req.*, response AS reply, CASE WHEN rep.conv_id IS NULL THEN 'no reply recorded' END AS gen_error
        FROM req LEFT JOIN rep ON rep.conv_id = req.conv_id AND rep.turn = req.turn)
, c AS (SELECT conv_id, turn, beam_index, gen_error, CASE WHEN gen_error IS NOT NULL THEN '' ELSE {D.extract_code('reply')} END AS code FROM g)
, cv AS (SELECT conv_id, turn, beam_index, gen_error, code,
         CASE WHEN gen_error IS NOT NULL THEN ['Generation failed: ' || gen_error] ELSE {D.code_errors('code')} END AS errors FROM c)
{select}""",
        "responses_v",
    )


_USER_TURNS = "SELECT conv_id, turn, 0 AS beam_index FROM conversations WHERE role = 'user'"
_GEN_COLUMNS = "SELECT conv_id, turn, code, len(errors) = 0 AS is_valid, array_to_string(errors, ' | ') AS errors FROM cv"


_REQ = """
, req AS (SELECT item_id, attempt, beam_index, code,
  {gk} AS gen_key, {ck} AS content_key FROM records_v)
""".replace(
    "{gk}",
    D.sha16("code")
    + " || '_' || "
    + D.sha16(
        "'{\"max_tokens\":512,\"model\":\"model\",\"seed\":' || CAST(attempt * 100 + beam_index AS VARCHAR) || "
        "',\"temperature\":' || CAST([0.3, 0.5, 0.5, 0.7, 0.8, 0.8, 0.8][attempt] AS VARCHAR) || '}'"
    ),
).replace("{ck}", D.sha16("code"))

_CHECKS = f"""
, cand AS (SELECT doc_id, coalesce(theorem, '') AS code, sha256(coalesce(theorem, '')) AS content_key FROM items_v)
, lab AS (SELECT content_key, coalesce(max(quality), 0) AS q, coalesce(max(toxic), 0) AS t FROM cand JOIN labels USING (doc_id) GROUP BY content_key)
, ver AS (SELECT content_key, q = 1 AS ok, CASE WHEN q = 1 THEN '' ELSE 'error: quality ' || q || ', toxic ' || t END AS stderr FROM lab)
, cv AS (SELECT doc_id, content_key, code, {D.code_errors('code')} AS errors FROM cand)
, rr AS (SELECT cv.*, len(errors) = 0 AND {D.strip('code')} <> '' AS checkable, ver.content_key IS NOT NULL AS found, ver.ok AS ok, ver.stderr AS stderr
         FROM cv LEFT JOIN ver ON ver.content_key = cv.content_key)
"""

_CTX = _LINES + """
, la AS (SELECT s.item_id, s.attempt, arg_max(p.category, s.event_id) AS category, arg_max(p.message, s.event_id) AS message
         FROM prim p JOIN stderr_v s ON p.event_id = s.event_id GROUP BY s.item_id, s.attempt)
, grid AS (SELECT i.item_id, CAST(a.attempt AS INT) AS attempt FROM (SELECT DISTINCT item_id FROM stderr_v) i,
           (SELECT unnest([1, 2, 3, 4, 5]) AS attempt) a)
, ctx AS (SELECT g.item_id, g.attempt,
  last_value(la.category IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS category,
  last_value(la.message IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS message
  FROM grid g LEFT JOIN la ON g.item_id = la.item_id AND g.attempt = la.attempt)
"""

_STUB_CODE = f"{D.q(S.REPAIR_STUB_HEAD)} || coalesce(sl.statement, '') || {D.q(S.REPAIR_STUB_TAIL)}"

ORACLES = {
    "schedule_table": with_views(
        f"""SELECT CAST(s.attempt AS INT) AS attempt, CAST(s.beam_size AS INT) AS beam_size, CAST(s.temperature AS DOUBLE) AS temperature,
  512 AS max_tokens, coalesce(c.n, 0) AS n_records
FROM {_RECORD_SCHED_SQL} s LEFT JOIN (SELECT attempt, count(*) AS n FROM records_v GROUP BY attempt) c ON c.attempt = s.attempt""",
        "records_v",
    ),
    "slot_expand": with_views(_SLOTS + "SELECT id, attempt, beam_index, CAST(attempt * 100 + beam_index AS INT) AS seed, temperature FROM sl", "items_v"),
    "slot_prompt": with_views(
        _CTX + _SLOTS + f"""
SELECT sl.id, sl.attempt, sl.beam_index, (ctx.category IS NOT NULL) AS is_repair,
  {D.sha16(f"CASE WHEN ctx.category IS NULL THEN {_INITIAL.replace('statement', 'sl.statement').replace('steps_text', 'sl.steps_text')} ELSE {D.repair_prompt('ctx.category', 'ctx.message', _STUB_CODE)} END")} AS prompt_key
FROM sl LEFT JOIN ctx ON ctx.item_id = sl.item_id AND ctx.attempt = sl.attempt""",
        "items_v", "stderr_v",
    ),
    "generate_batch": _gen_sql(_USER_TURNS, _GEN_COLUMNS),
    "generation_failed": _gen_sql(_USER_TURNS, _GEN_COLUMNS + " WHERE gen_error IS NOT NULL"),
    "single_attempt": _gen_sql(
        "SELECT conv_id, 2 * b AS turn, CAST(b AS INT) AS beam_index FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([0, 1, 2]) AS b)",
        "SELECT conv_id, beam_index, code, len(errors) = 0 AS is_valid FROM cv",
    ),
    "memo_generation": with_views(
        _REQ + "SELECT item_id, attempt, beam_index, gen_key, "
        "row_number() OVER (PARTITION BY gen_key ORDER BY item_id, attempt, beam_index) > 1 AS from_memo FROM req",
        "records_v",
    ),
    "memo_check": with_views(
        _CHECKS + "SELECT doc_id, substr(content_key, 1, 16) AS content_key, row_number() OVER (PARTITION BY content_key ORDER BY doc_id) > 1 AS from_memo, "
        "coalesce(ok, false) AS ok, CASE WHEN NOT found THEN 'no verdict recorded' END AS check_error FROM rr",
        "items_v",
    ),
    "memo_stats": with_views(
        _REQ
        + """
, gm AS (SELECT count(*) AS r, count(DISTINCT gen_key) AS m FROM req)
, cm AS (SELECT count(*) AS r, count(DISTINCT content_key) AS m FROM req)
SELECT gm.r AS generation_requests, gm.r - gm.m AS generation_hits, gm.m AS generation_misses,
  round(coalesce(CAST(gm.r - gm.m AS DOUBLE) / nullif(gm.r, 0), 0.0), 6) AS generation_hit_rate, CAST(0 AS BIGINT) AS generation_size_before, gm.m AS generation_size_after,
  cm.r AS check_requests, cm.r - cm.m AS check_hits, cm.m AS check_misses,
  round(coalesce(CAST(cm.r - cm.m AS DOUBLE) / nullif(cm.r, 0), 0.0), 6) AS check_hit_rate, CAST(0 AS BIGINT) AS check_size_before, cm.m AS check_size_after
FROM gm, cm""",
        "records_v",
    ),
    "check_batch": with_views(
        _CHECKS + "SELECT doc_id, coalesce(ok, false) AS ok, stderr, CASE WHEN NOT found THEN 'no verdict recorded' END AS check_error FROM rr WHERE checkable",
        "items_v",
    ),
    "skip_invalid": with_views(
        _CHECKS
        + """SELECT doc_id, checkable AND found AS compiled, coalesce(checkable AND found AND ok, false) AS compile_ok,
  CASE WHEN checkable AND found THEN nullif(stderr, '') WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS compile_stderr,
  CASE WHEN checkable AND NOT found THEN 'no verdict recorded' END AS run_error FROM rr""",
        "items_v",
    ),
    "stop_at_first_success": with_views(
        """
, ranked AS (SELECT item_id, attempt, beam_index, coalesce(compiled AND compile_ok, false) AS ok,
             row_number() OVER (PARTITION BY item_id ORDER BY attempt, beam_index) AS rn FROM records_v)
, f AS (SELECT item_id, min(CASE WHEN ok THEN rn END) AS fr FROM ranked GROUP BY item_id)
SELECT r.item_id, r.attempt, r.beam_index FROM ranked r JOIN f ON r.item_id = f.item_id WHERE f.fr IS NULL OR r.rn <= f.fr""",
        "records_v",
    ),
    "pending_items": with_views(
        """
, f AS (SELECT item_id, min(CASE WHEN compiled AND compile_ok THEN attempt END) AS fa FROM records_v GROUP BY item_id)
SELECT item_id, CAST(unnest(generate_series(1, coalesce(fa, 7))) AS INT) AS attempt FROM f""",
        "records_v",
    ),
}
