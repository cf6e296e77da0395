"""Column functions for text: Python-compatible strip/collapse, hashes, code
extraction from model replies and the structural code checks.

All functions take and return ``Column`` objects built from Spark built-ins,
so they stay inside whole-stage codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# whitespace
# ---------------------------------------------------------------------------
def py_strip(x: ColumnOrName) -> Column:
    """``str.strip()``: remove the 29 Python whitespace code points at both ends."""
    return F.btrim(_c(x), F.lit(S.WS_CHARS))


def collapse_ws(x: ColumnOrName) -> Column:
    """``" ".join(s.split())``: runs of whitespace become one space, ends trimmed.

    Every whitespace code point is first mapped to a space by ``translate``
    (a per-character table lookup), which leaves a much simpler regex."""
    spaced = F.translate(_c(x), S.WS_CHARS, " " * len(S.WS_CHARS))
    return F.btrim(F.regexp_replace(spaced, " {2,}", " "), F.lit(" "))


def is_blank(x: ColumnOrName) -> Column:
    """True when the text is empty or whitespace only (null stays null)."""
    return py_strip(x) == F.lit("")


# ---------------------------------------------------------------------------
# hashes
# ---------------------------------------------------------------------------
def sha16(x: ColumnOrName) -> Column:
    """First 16 hex characters of SHA-256 over the UTF-8 bytes."""
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def digest(x: ColumnOrName) -> Column:
    """The whole SHA-256: what groups and joins go by."""
    return F.sha2(_c(x), 256)


def normalized_digest(x: ColumnOrName) -> Column:
    """The whole SHA-256 of the whitespace-collapsed text."""
    return digest(collapse_ws(x))


def normalized_hash(x: ColumnOrName) -> Column:
    """Whitespace-collapsed text -> SHA-256 -> 16 hex chars, for display."""
    return sha16(collapse_ws(x))


def content_key(x: ColumnOrName) -> Column:
    """Memo key of raw text (whitespace matters)."""
    return sha16(x)


# ---------------------------------------------------------------------------
# code extraction from a model reply
# ---------------------------------------------------------------------------
LEAN_FENCE = r"(?s)```lean\n(.*?)\n```"
ANY_FENCE = r"(?s)```\n?(.*?)\n?```"
# From the first blank line (a line of whitespace only) to the end.
FROM_BLANK_LINE = rf"(?s)\n[{S.WS_CLASS_NO_LF}]*\n.*"


def extract_code(reply: ColumnOrName) -> Column:
    """Ordered fallbacks: a ```lean fence; any fence; the text after the last
    ``Lean:`` up to its first blank line; the whole reply.  Always stripped.

    ``regexp_extract`` returns '' both for no match and for an empty match,
    so each branch is guarded with ``rlike``.
    """
    r = _c(reply)
    after_marker = py_strip(F.substring_index(r, "Lean:", -1))
    marker_code = F.regexp_replace(after_marker, FROM_BLANK_LINE, "")
    return (
        F.when(r.rlike(LEAN_FENCE), py_strip(F.regexp_extract(r, LEAN_FENCE, 1)))
        .when(r.rlike(ANY_FENCE), py_strip(F.regexp_extract(r, ANY_FENCE, 1)))
        .when(r.contains("Lean:"), py_strip(marker_code))
        .otherwise(py_strip(r))
    )


# ---------------------------------------------------------------------------
# structural checks
# ---------------------------------------------------------------------------
def count_char(x: ColumnOrName, ch: str) -> Column:
    """Occurrences of one character (code points)."""
    c = _c(x)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def balanced(x: ColumnOrName, open_ch: str, close_ch: str) -> Column:
    return count_char(x, open_ch) == count_char(x, close_ch)


# Word-boundary-free form that agrees with Python's unicode \b.
DECLARATION = r"(^|[^\p{L}\p{N}_])(theorem|lemma)($|[^\p{L}\p{N}_])"
# ``by`` needs no left boundary: "baby " counts as a body (kept quirk).
BODY = rf":=|by[{S.WS_CLASS}]"
_ALLOWED_CLASS = "".join(f"\\u{cp:04x}" for cp in S.ALLOWED_UNICODE_CODEPOINTS)
SUSPICIOUS_CHAR = rf"([^\x00-\x7F{S.WS_CLASS}{_ALLOWED_CLASS}])"


def has_declaration(x: ColumnOrName) -> Column:
    return _c(x).rlike(DECLARATION)


def has_body(x: ColumnOrName) -> Column:
    return _c(x).rlike(BODY)


ASCII_RUN = r"[\x00-\x7F]+"
ALLOWED_RUN = rf"[{S.WS_CLASS}{_ALLOWED_CLASS}]+"


def suspicious_chars(x: ColumnOrName) -> Column:
    """Distinct non-ASCII, non-space characters outside the allow list, sorted.

    ASCII is deleted first, by a class of one range, so the class of the many
    allowed characters only sees what is left, and the extraction only the few
    characters after that."""
    rest = F.regexp_replace(F.regexp_replace(_c(x), ASCII_RUN, ""), ALLOWED_RUN, "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(rest, F.lit("(?s)(.)"), 1)))


def odd_quotes(x: ColumnOrName) -> Column:
    return F.pmod(count_char(x, '"'), F.lit(2)) != 0


def code_errors(code: ColumnOrName) -> Column:
    """All structural problems of a candidate, in check order (ARRAY<STRING>)."""
    c = _c(code)
    sus = suspicious_chars(c)
    sus_msg = F.concat(
        F.lit(S.MSG_UNICODE_PREFIX + "{"),
        F.array_join(F.transform(sus, lambda ch: F.concat(F.lit("'"), ch, F.lit("'"))), ", "),
        F.lit("}"),
    )
    checks = [
        F.when(~balanced(c, "(", ")"), F.lit(S.MSG_UNBALANCED_PARENS)),
        F.when(~balanced(c, "[", "]"), F.lit(S.MSG_UNBALANCED_BRACKETS)),
        F.when(~balanced(c, "{", "}"), F.lit(S.MSG_UNBALANCED_BRACES)),
        F.when(~has_declaration(c), F.lit(S.MSG_NO_DECLARATION)),
        F.when(~has_body(c), F.lit(S.MSG_NO_BODY)),
        F.when(F.size(sus) > 0, sus_msg),
        F.when(odd_quotes(c), F.lit(S.MSG_UNTERMINATED_STRING)),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_code(code: ColumnOrName) -> Column:
    """``STRUCT<is_valid BOOLEAN, errors ARRAY<STRING>>``."""
    errs = code_errors(code)
    return F.struct((F.size(errs) == 0).alias("is_valid"), errs.alias("errors"))


def code_length(code: ColumnOrName) -> Column:
    """Length in code points, 0 when empty or null."""
    return F.coalesce(F.length(_c(code)), F.lit(0))


def cut_with_ellipsis(x: ColumnOrName, n: int) -> Column:
    """First ``n`` characters plus ``...`` when the text is longer."""
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def _margin_len(lines: Column) -> Column:
    """Length of the longest common leading blank prefix (spaces and tabs) of
    the non-blank lines of an already normalised line array."""
    margins = F.transform(
        F.filter(lines, lambda ln: ln != ""), lambda ln: F.regexp_extract(ln, r"^([ \t]*)", 1)
    )
    # The common prefix of the sorted first and last margin is the common
    # prefix of all margins.
    srt = F.array_sort(margins)
    first = F.element_at(srt, 1)
    last = F.element_at(srt, -1)
    idx = F.sequence(F.lit(1), F.least(F.length(first), F.length(last)))
    same = F.transform(idx, lambda i: first.substr(i, F.lit(1)) == last.substr(i, F.lit(1)))
    mismatch = F.array_position(same, F.lit(False))
    return F.when(F.size(srt) == 0, F.lit(0)).otherwise(
        F.when(mismatch == 0, F.least(F.length(first), F.length(last))).otherwise(mismatch - 1)
    )


def _normal_lines(x: ColumnOrName) -> Column:
    """Lines split on LF, lines of only spaces/tabs emptied."""
    return F.transform(
        F.split(_c(x), "\n", -1), lambda ln: F.when(ln.rlike(r"^[ \t]*\z"), F.lit("")).otherwise(ln)
    )


def _cut_lines(lines: Column, margin: Column) -> Column:
    """Join the lines and drop the first ``margin`` characters of each line.
    Every non-blank line starts with the common margin and blank lines are
    empty, so one multi-line regex does it (``d``: only LF ends a line) --
    no per-line lambda, which would re-evaluate ``margin`` for every line."""
    text = F.array_join(lines, "\n")
    pattern = F.concat(F.lit("(?md)^[ \t]{"), margin.cast("string"), F.lit("}"))
    return F.when(margin == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit("")))


def dedent(x: ColumnOrName) -> Column:
    """``textwrap.dedent``: remove the longest common leading blank prefix of
    the non-blank lines; lines of only spaces/tabs become empty."""
    lines = _normal_lines(x)
    return _cut_lines(lines, _margin_len(lines))


def with_dedented(df: DataFrame, col: str, out: str) -> DataFrame:
    """``textwrap.dedent`` in stages: lines, then the margin length, then the
    cut -- each a separate projection, so the margin is computed once per row."""
    return (
        df.withColumn("_dd_lines", _normal_lines(F.col(col)))
        .withColumn("_dd_margin", _margin_len(F.col("_dd_lines")))
        .withColumn(out, _cut_lines(F.col("_dd_lines"), F.col("_dd_margin")))
        .drop("_dd_lines", "_dd_margin")
    )


def _module(imports: Column, body: Column, default_import: str) -> Column:
    imps = F.coalesce(imports, F.array().cast("array<string>"))
    imps = F.when(F.size(imps) == 0, F.array(F.lit(default_import))).otherwise(imps)
    header = F.array_join(F.transform(imps, lambda i: F.concat(F.lit("import "), i)), "\n")
    return F.concat(
        F.when(body == "", header).otherwise(F.concat(header, F.lit("\n\n"), body)), F.lit("\n")
    )


def render_module(code: ColumnOrName, imports: ColumnOrName, default_import: str) -> Column:
    """A checker input file: ``import X`` lines (the default import when the
    list is empty or null), a blank line, then the dedented, stripped code."""
    return _module(_c(imports), py_strip(dedent(code)), default_import)


def with_rendered_module(df: DataFrame, code: str, imports: str, default_import: str, out: str = "module") -> DataFrame:
    """Staged ``render_module`` for long code texts."""
    staged = with_dedented(df, code, "_rm_body").withColumn("_rm_body", py_strip(F.col("_rm_body")))
    return staged.withColumn(out, _module(F.col(imports), F.col("_rm_body"), default_import)).drop("_rm_body")
