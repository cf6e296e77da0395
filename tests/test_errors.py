"""Checker-output classification (2.6)."""

from pyspark.sql import functions as F

from proofloom import schema as S
from proofloom.functions import errors as ER
from proofloom.functions import prompts as PR
from proofloom.operators import classify as CL

CASES = [
    ("c.lean:5:12: error: unknown identifier 'Nat.foo'", S.UNKNOWN_IDENTIFIER, 5),
    ("failed to resolve 'bar'", S.UNKNOWN_IDENTIFIER, None),
    ("'baz' has not been declared", S.UNKNOWN_IDENTIFIER, None),
    ("x.lean:1:2: error: type mismatch", S.TYPE_MISMATCH, 1),
    ("unexpected token, expected x, got y", S.TYPE_MISMATCH, None),  # pattern order: mismatch first
    ("h has type Nat but is expected to have type Int", S.TYPE_MISMATCH, None),
    ("tactic failed", S.TACTIC_FAILED, None),
    ("error: unsolved goals", S.TACTIC_FAILED, None),
    ("goal state: x", S.TACTIC_FAILED, None),
    ("invalid tactic 'foo'", S.TACTIC_FAILED, None),
    ("could not synthesize instance", S.MISSING_PREMISE, None),
    ("no applicable rules", S.MISSING_PREMISE, None),
    ("failed to prove termination", S.MISSING_PREMISE, None),
    ("a.lean:9:1: error: unexpected token", S.SYNTAX_ERROR, 9),
    ("expected ')'", S.SYNTAX_ERROR, None),
    ("expected ']'", S.SYNTAX_ERROR, None),
    ("expected '}'", S.SYNTAX_ERROR, None),
    ("invalid expression", S.SYNTAX_ERROR, None),
    ("something else entirely", S.OTHER, None),
    ("Type Mismatch", S.OTHER, None),  # case-sensitive
    ("expected a\u2028b, got c", S.TYPE_MISMATCH, None),  # only a line feed ends a line
]


def test_classify_line_and_line_number(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "l string")
    rows = df.select("l", ER.classify_line("l").alias("c"), ER.line_number("l").alias("n")).collect()
    for (line, cat, num), row in zip(CASES, rows):
        assert row.c == cat, line
        assert row.n == num, line


def test_fix_suggestions(spark):
    df = spark.createDataFrame([("unknown identifier 'Foo.bar'",), ("unknown identifier x",)], "l string")
    df = df.withColumn("c", F.lit(S.UNKNOWN_IDENTIFIER))
    rows = df.select(ER.fix_suggestions("c", "l").alias("f")).collect()
    assert rows[0].f == [t.replace("{identifier}", "Foo.bar") for t in S.FIXES_WITH_IDENTIFIER]
    assert rows[1].f == S.FIXES_NO_IDENTIFIER


STDERRS = [
    "c.lean:3:4: error: type mismatch\n  c.lean:9:1: error: unexpected token",
    "error: unsolved goals\n\nnote: see above",
    "   \n\t\n",
    "",
    "c.lean:1:1: error: unknown identifier 'x'\nc.lean:2:1: error: type mismatch",
    "note: one\nnote: two",
]


#: Category and line of each text's primary error.
PRIMARY = [('syntax_error', 'c.lean:9:1: error: unexpected token'),
 ('tactic_failed', 'error: unsolved goals'),
 None,
 None,
 ('unknown_identifier', "c.lean:1:1: error: unknown identifier 'x'"),
 ('other', 'note: one')]


def test_primary_error_priority(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STDERRS)], "i int, stderr string")
    rows = {r.i: r for r in CL.with_primary_error(df).collect()}
    for i, s in enumerate(STDERRS):
        want = PRIMARY[i]
        got = rows[i].primary_error
        if want is None:
            assert got is None
        else:
            assert (got.category, got.message) == want
            assert got.original_stderr == s and got.severity == "error"


def test_classified_lines(spark):
    df = spark.createDataFrame([(1, STDERRS[0]), (2, STDERRS[1]), (3, "")], "i int, stderr string")
    rows = {r.i: r.errors for r in CL.with_classified(df).collect()}
    assert [e.category for e in rows[1]] == [S.TYPE_MISMATCH, S.SYNTAX_ERROR]
    assert [e.message for e in rows[2]] == ["error: unsolved goals", "note: see above"]
    assert rows[3] == []


def test_error_context_carries_over_attempts(spark):
    data = [
        (1, 1, 10, "c.lean:1:1: error: type mismatch"),
        (1, 1, 11, "error: unsolved goals"),
        (1, 3, 12, "c.lean:2:2: error: unexpected token"),
        (2, 2, 13, ""),
    ]
    df = spark.createDataFrame(data, "item_id int, attempt int, seq int, stderr string")
    attempts = F.array(*[F.lit(a) for a in range(1, 6)])
    rows = {(r.item_id, r.attempt): r.error_context for r in CL.error_context(df, attempts=attempts).collect()}
    cat = lambda k: rows[k].category if rows[k] is not None else None
    assert cat((1, 1)) is None
    assert cat((1, 2)) == S.TACTIC_FAILED  # last failing check of attempt 1
    assert cat((1, 3)) == S.TACTIC_FAILED  # carried over an attempt without errors
    assert cat((1, 4)) == S.SYNTAX_ERROR
    assert cat((2, 5)) is None


def test_repair_prompt(spark):
    df = spark.createDataFrame([(S.UNKNOWN_IDENTIFIER, "unknown identifier 'Foo'"), ("weird", "boom")], "c string, m string")
    rows = df.select(PR.prompt_repair("c", "m", F.lit("CODE")).alias("p")).collect()
    want0 = S.REPAIR_TEMPLATES[S.UNKNOWN_IDENTIFIER].format(identifier="Foo", original_code="CODE", error_message="unknown identifier 'Foo'").strip()
    want1 = S.REPAIR_TEMPLATES[S.OTHER].format(identifier="", original_code="CODE", error_message="boom").strip()
    assert rows[0].p == want0 and rows[1].p == want1


def test_repair_prompt_inserts_values_verbatim(spark):
    msg = "type mismatch {original_code} 100%"
    df = spark.createDataFrame([(S.TYPE_MISMATCH, msg, "code {error_message}")], "c string, m string, k string")
    got = df.select(PR.prompt_repair("c", "m", "k")).first()[0]
    want = S.REPAIR_TEMPLATES[S.TYPE_MISMATCH].format(identifier="", original_code="code {error_message}", error_message=msg).strip()
    assert got == want


def test_error_histogram_wide(spark):
    df = spark.createDataFrame([(1, STDERRS[0]), (1, STDERRS[1]), (2, STDERRS[4])], "attempt int, stderr string")
    lines = CL.error_lines(df)
    wide = {r.attempt: r for r in CL.error_histogram_wide(lines).collect()}
    assert wide[1][S.TYPE_MISMATCH] == 1 and wide[1][S.SYNTAX_ERROR] == 1 and wide[1][S.TACTIC_FAILED] == 1
    assert wide[1][S.OTHER] == 1 and wide[2][S.UNKNOWN_IDENTIFIER] == 1 and wide[2][S.MISSING_PREMISE] == 0
    long = {(r.attempt, r.category): r.n_errors for r in CL.error_histogram(lines).collect()}
    assert long[(1, S.TYPE_MISMATCH)] == 1


def test_one_match_per_category_gives_the_first_pattern(spark):
    """The joined patterns against the list walked in order, over all pairs of
    phrases in both orders."""
    import itertools
    import re

    phrases = [c[0] for c in CASES]
    lines = [f"{a} {b}" for a, b in itertools.permutations(phrases, 2)]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select("l", ER.classify_line("l").alias("c"))
    for r in df.collect():
        want = next((cat for cat, p in S.ERROR_PATTERNS if re.search(p, r.l)), S.OTHER)
        assert r.c == want, r.l
    assert len(ER._alternations()) == 5


def test_error_context_carries_forward(spark):
    """Gaps, blank outputs, several outputs of one attempt, a null item, an item
    without errors; no window and no join in the plan."""
    rows = [("a", 1, 1, "type mismatch"), ("a", 1, 2, "error: unsolved goals"), ("a", 3, 3, "  "), ("a", 4, 4, "unexpected token"), ("b", 2, 5, ""), (None, 1, 6, "tactic failed"), ("c", None, 7, "tactic failed")]
    df = spark.createDataFrame(rows, "item_id string, attempt int, seq int, stderr string")
    wanted = F.array(*[F.lit(k) for k in range(1, 6)])
    out = CL.error_context(df, attempts=wanted)
    got = {(r.item_id, r.attempt): r.error_context and r.error_context.message for r in out.collect()}
    assert [got[("a", k)] for k in range(1, 6)] == [None, *["error: unsolved goals"] * 3, "unexpected token"]
    assert [got[("b", k)] for k in range(1, 6)] == [None] * 5 and got[(None, 2)] == "tactic failed" and len(got) == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    present = CL.error_context(df)
    assert {(r.item_id, r.attempt) for r in present.collect()} == {("a", 1), ("a", 3), ("a", 4), ("b", 2), (None, 1)}
