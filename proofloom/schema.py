"""Types, enums and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Item schema (declared, never inferred)
# ---------------------------------------------------------------------------
ENGLISH = T.StructType(
    [
        T.StructField("statement", T.StringType()),
        T.StructField("steps", T.ArrayType(T.StringType())),
    ]
)
LEAN = T.StructType(
    [
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("theorem", T.StringType()),
    ]
)
ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("english", ENGLISH),
        T.StructField("lean", LEAN),
    ]
)

CANDIDATE_RECORD = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("beam_index", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("generation_time", T.DoubleType()),
        T.StructField("compiled", T.BooleanType()),
        T.StructField("compile_ok", T.BooleanType()),
        T.StructField("compile_stderr", T.StringType()),
    ]
)

LEAN_ERROR = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("suggested_fixes", T.ArrayType(T.StringType())),
        T.StructField("original_stderr", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# Whitespace.  Python's str.strip()/str.split() treat exactly these 29 code
# points as whitespace; Java's \s and Spark's trim() do not, so every strip
# and collapse goes through this one set.
# ---------------------------------------------------------------------------
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Java regex character-class body for the same set (used inside [...]).
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same set without the line feed (a "blank line" may hold any of these).
WS_CLASS_NO_LF = r"\t\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

assert len(WS_CHARS) == 29

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Non-ASCII characters a candidate may contain without being flagged
# (code points, in the reference's order).
ALLOWED_UNICODE_CODEPOINTS = [
    0x2227, 0x2228, 0x21D4, 0x2194, 0x2192, 0x00AC, 0x2264, 0x2265, 0x2200,
    0x2203, 0x2115, 0x2124, 0x211D, 0x211A, 0x2102, 0x03B1, 0x03B2, 0x03B3,
    0x03B4, 0x03B5, 0x03B8, 0x03BB, 0x03BC, 0x03C0, 0x03C3, 0x03C4, 0x03C6,
    0x03C8, 0x03C9, 0x2208, 0x2286, 0x2282, 0x2287, 0x2283, 0x2260, 0x22C5,
    0x00B7, 0x2218, 0x2211, 0x220F, 0x22A4, 0x22A5, 0x2229, 0x222A, 0x2223,
    0x2081, 0x2082, 0x27E8, 0x27E9,
]
ALLOWED_UNICODE_CHARS = "".join(chr(c) for c in ALLOWED_UNICODE_CODEPOINTS)

# Structural-check messages, in check order.
MSG_UNBALANCED_PARENS = "Unbalanced parentheses"
MSG_UNBALANCED_BRACKETS = "Unbalanced brackets"
MSG_UNBALANCED_BRACES = "Unbalanced braces"
MSG_NO_DECLARATION = "No theorem or lemma declaration found"
MSG_NO_BODY = "No proof body found"
MSG_UNICODE_PREFIX = "Potentially problematic unicode characters: "
MSG_UNTERMINATED_STRING = "Unterminated string literal"
MSG_GENERATION_FAILED_PREFIX = "Generation failed: "

# Error categories.
UNKNOWN_IDENTIFIER = "unknown_identifier"
TYPE_MISMATCH = "type_mismatch"
TACTIC_FAILED = "tactic_failed"
MISSING_PREMISE = "missing_premise"
SYNTAX_ERROR = "syntax_error"
OTHER = "other"
SEVERITY_ERROR = "error"

# Checker-output patterns: the first one (in this order) that matches a
# stderr line gives the line's category.  Case-sensitive; Java regex syntax.
ERROR_PATTERNS = [
    (UNKNOWN_IDENTIFIER, r"unknown identifier '([^']+)'"),
    (UNKNOWN_IDENTIFIER, r"failed to resolve '([^']+)'"),
    (UNKNOWN_IDENTIFIER, r"'([^']+)' has not been declared"),
    (TYPE_MISMATCH, r"type mismatch"),
    (TYPE_MISMATCH, r"expected .+, got .+"),
    (TYPE_MISMATCH, r"has type .+ but is expected to have type"),
    (TACTIC_FAILED, r"tactic failed"),
    (TACTIC_FAILED, r"unsolved goals"),
    (TACTIC_FAILED, r"goal state:"),
    (TACTIC_FAILED, r"invalid tactic"),
    (MISSING_PREMISE, r"could not synthesize"),
    (MISSING_PREMISE, r"no applicable rules"),
    (MISSING_PREMISE, r"failed to prove"),
    (SYNTAX_ERROR, r"unexpected token"),
    (SYNTAX_ERROR, r"expected '\)'"),
    (SYNTAX_ERROR, r"expected '\]'"),
    (SYNTAX_ERROR, r"expected '\}'"),
    (SYNTAX_ERROR, r"invalid expression"),
]

# Which error of a stderr is fed to the next attempt: most important first.
PRIORITY = [SYNTAX_ERROR, UNKNOWN_IDENTIFIER, TYPE_MISMATCH, TACTIC_FAILED, MISSING_PREMISE, OTHER]

# Fix suggestions per category.  "{identifier}" is filled from the first
# single-quoted name in the message.
FIXES_WITH_IDENTIFIER = [
    "Add import for '{identifier}'",
    "Check spelling of '{identifier}'",
    "Use correct namespace for '{identifier}'",
]
FIXES_NO_IDENTIFIER = ["Check imports and identifier spelling"]
FIXES = {
    TYPE_MISMATCH: [
        "Check types match expected",
        "Add explicit type annotations",
        "Use type coercion if needed",
    ],
    TACTIC_FAILED: [
        "Try a different tactic",
        "Break proof into smaller steps",
        "Check goal state carefully",
    ],
    MISSING_PREMISE: [
        "Add missing hypothesis",
        "Import required lemmas",
        "Use 'have' to establish needed facts",
    ],
    SYNTAX_ERROR: [
        "Check parentheses/brackets are balanced",
        "Fix indentation",
        "Check Lean 4 syntax",
    ],
    OTHER: [],
}

# Repair-prompt templates per category (placeholders {identifier},
# {original_code}, {error_message}); the rendered prompt is stripped.
REPAIR_TEMPLATES = {
    UNKNOWN_IDENTIFIER: """
The Lean compiler couldn't find '{identifier}'. This usually means:
1. Missing import statement
2. Typo in identifier name  
3. Wrong namespace

Original code:
{original_code}

Error: {error_message}

Fix the code by adding the correct import or fixing the identifier:
""",
    TYPE_MISMATCH: """
There's a type mismatch in your Lean code. The compiler expected one type but got another.

Original code:
{original_code}

Error: {error_message}

Fix the type mismatch by adjusting the proof or using appropriate coercions:
""",
    TACTIC_FAILED: """
The tactic in your proof failed to solve the goal.

Original code:
{original_code}

Error: {error_message}

Try a different tactic or break down the proof into smaller steps:
""",
    MISSING_PREMISE: """
The proof requires a lemma or premise that couldn't be found or synthesized.

Original code:
{original_code}

Error: {error_message}

Add the missing premise or use a different approach:
""",
    SYNTAX_ERROR: """
There's a syntax error in your Lean code.

Original code:
{original_code}

Error: {error_message}

Fix the syntax error:
""",
    OTHER: """
The Lean compiler encountered an error.

Original code:
{original_code}

Error: {error_message}

Please fix the error:
""",
}

# First-attempt prompt: "Convert this to Lean 4:\nStatement: {statement}\n"
# followed by "Steps: {steps joined by ', '}\n" only when steps exist.
INITIAL_PROMPT_HEAD = "Convert this to Lean 4:\nStatement: "
INITIAL_PROMPT_STEPS = "Steps: "
# Stub code a repair prompt embeds: "theorem example : {statement} := sorry".
REPAIR_STUB_HEAD = "theorem example : "
REPAIR_STUB_TAIL = " := sorry"
NO_STEPS_TEXT = "No specific steps provided"
COMPILE_EXCEPTION_PREFIX = "Exception during compilation: "

# Default retry schedule.
DEFAULT_MAX_ATTEMPTS = 5
DEFAULT_BEAM_SCHEDULE = [1, 3, 3, 5, 5]
DEFAULT_TEMPERATURE_SCHEDULE = [0.3, 0.5, 0.5, 0.7, 0.8]
DEFAULT_MAX_TOKENS = 512
DEFAULT_PASS_K = (1, 5)
# ---------------------------------------------------------------------------
