"""Reply post-processing: extraction and structural checks (2.5)."""

import pytest
from pyspark.sql import functions as F

from proofloom import schema as S
from proofloom.functions import prompts as PR
from proofloom.functions import text as TX

REPLIES = [
    "```lean\ntheorem foo : True := by trivial\n```",
    "Here you go:\n```lean\ntheorem a (n : Nat) : n = n := rfl\n```\nDone.",
    "```\nlemma b : 1 = 1 := rfl\n```",
    "```lean\nfoo```",  # lean fence not closed on its own line -> generic rule keeps the tag
    "Lean: no\nLean:\ntheorem t : True := by\n  trivial\n\nhope it helps",
    "Lean:\n\n\ntheorem x := y\n \t \nrest",
    "   plain text answer   ",
    "",
    "Lean:",
    "```\n\n```",
    "text ``` inline ``` more",
    "Lean:\ntheorem a\r\n\r\nnext",
]

CODES = [
    "theorem foo : True := by trivial",
    "theorem foo (a : Nat : True := by trivial",
    "lemma x [a : b := rfl",
    "theorem y {a : b := rfl",
    "def z : Nat := 1",
    "theorem w : True",
    "theorem baby : True baby here",  # "by" without a left boundary counts
    "theorem u : ∀ x, x ∈ S → x ≠ 0 := by simp",
    "theorem v : é = ü := by simp",
    'theorem q : "abc = 1 := by simp',
    "étheorem k := 1",
    "theorem_x := 1",
    "lemma\tfoo := 1",
    "",
    "theorem t : α ≤ β ∧ γ := by\n  exact ⟨h₁, h₂⟩ ⋆",
]


#: What each reply holds, and what each code breaks.
EXTRACTED = ['theorem foo : True := by trivial',
 'theorem a (n : Nat) : n = n := rfl',
 'lemma b : 1 = 1 := rfl',
 'lean\nfoo',
 'theorem t : True := by\n  trivial',
 'theorem x := y',
 'plain text answer',
 '',
 '',
 '',
 'inline',
 'theorem a']

BROKEN = [[],
 ['Unbalanced parentheses'],
 ['Unbalanced brackets'],
 ['Unbalanced braces'],
 ['No theorem or lemma declaration found'],
 ['No proof body found'],
 [],
 [],
 ["Potentially problematic unicode characters: {'é', 'ü'}"],
 ['Unterminated string literal'],
 ['No theorem or lemma declaration found', "Potentially problematic unicode characters: {'é'}"],
 ['No theorem or lemma declaration found'],
 [],
 ['No theorem or lemma declaration found', 'No proof body found'],
 ["Potentially problematic unicode characters: {'⋆'}"]]


def test_extract_code(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, r string")
    got = {row.i: row.c for row in df.select("i", TX.extract_code("r").alias("c")).collect()}
    for i, r in enumerate(REPLIES):
        assert got[i] == EXTRACTED[i], (i, r)


def test_lean_fence_not_on_own_line_keeps_tag(spark):
    df = spark.createDataFrame([("```lean\nfoo```",)], "r string")
    assert df.select(TX.extract_code("r")).first()[0] == "lean\nfoo"


def test_code_errors(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "i int, c string")
    got = {row.i: list(row.e) for row in df.select("i", TX.code_errors("c").alias("e")).collect()}
    for i, c in enumerate(CODES):
        assert got[i] == BROKEN[i], (i, c)


def test_validate_struct(spark):
    df = spark.createDataFrame([("theorem t : True := by trivial",), ("nope",)], "c string")
    rows = df.select(TX.validate_code("c").alias("v")).collect()
    assert rows[0].v.is_valid and rows[0].v.errors == []
    assert not rows[1].v.is_valid and S.MSG_NO_DECLARATION in rows[1].v.errors


@pytest.mark.parametrize(
    "text,want",
    list(zip(["a  b\tc\n", " 　lead and trail  ", "x\x1cy\x85z", "", "no-space"],
        ["0e9f64031fcb2bc7", "8ffa7386ba1c81e5", "00d9bf1235b65cc6", "e3b0c44298fc1c14", "07452ade9ff3a727"])),
)
def test_normalized_hash(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(TX.normalized_hash("t")).first()[0] == want


def test_content_key_keeps_whitespace(spark):
    df = spark.createDataFrame([("a b",), ("a  b",)], "t string")
    keys = [r[0] for r in df.select(TX.content_key("t")).collect()]
    assert keys[0] != keys[1]


def test_prompts(spark):
    df = spark.createDataFrame([("S", ["one step", "two step"]), ("T", [])], "st string, steps array<string>")
    rows = df.select(PR.prompt_initial("st", "steps").alias("p"), PR.prompt_full("st", "steps").alias("f")).collect()
    assert rows[0].p == "Convert this to Lean 4:\nStatement: S\nSteps: one step, two step\n"
    assert rows[1].p == "Convert this to Lean 4:\nStatement: T\n"
    assert S.NO_STEPS_TEXT in rows[1].f and "one step, two step" in rows[0].f


def test_parse_steps_text(spark):
    df = spark.createDataFrame([(" a ; ;b;  c  ;",)], "s string")
    assert df.select(PR.parse_steps_text("s")).first()[0] == ["a", "b", "c"]


def test_render_module(spark):
    df = spark.createDataFrame(
        [("    theorem a := 1\n      b\n   \n", []), ("x", ["Mathlib.Data"]), ("  ", None)], "c string, imps array<string>"
    )
    got = [r[0] for r in df.select(TX.render_module("c", "imps", "Main.Basic")).collect()]
    assert got[0] == f"import Main.Basic\n\ntheorem a := 1\n  b\n"
    assert got[1] == "import Mathlib.Data\n\nx\n"
    assert got[2] == f"import Main.Basic\n"
    staged = [r.module for r in TX.with_rendered_module(df, "c", "imps", "Main.Basic").collect()]
    assert staged == got


def test_dedent_matches_textwrap(spark):
    import textwrap

    cases = ["\t a\n\t b", "  a\n\tb", "    x\n\n      y\n    z", "  \n  a\n   b\n  ", "no margin\n  b", " \t a\n \t\tb\n \t c", "a\r\n  b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: r.d for r in TX.with_dedented(df, "c", "d").collect()}
    single = {r.i: r.d for r in df.select("i", TX.dedent("c").alias("d")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == textwrap.dedent(c) == single[i], (i, c)
