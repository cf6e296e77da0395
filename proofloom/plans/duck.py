"""DuckDB spellings of the shared text rules, for the SQL oracles.

DuckDB uses RE2 (no ``\\uXXXX``; ``\\x{..}`` instead) and does not unescape
string literals, so these are written separately from the Java forms."""

from __future__ import annotations

from .. import schema as S

# The 29 whitespace code points as a SQL string expression.
WS = "(" + " || ".join(f"chr({ord(c)})" for c in S.WS_CHARS) + ")"
WS_RE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_RE_NO_LF = r"\t\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ALLOWED_RE = "".join(f"\\x{{{cp:x}}}" for cp in S.ALLOWED_UNICODE_CODEPOINTS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS_RE}]+', ' ', 'g'), ' ')"


def sha16(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def extract_code(r: str) -> str:
    lean = r"(?s)```lean\n(.*?)\n```"
    anyf = r"(?s)```\n?(.*?)\n?```"
    after = strip(f"string_split({r}, 'Lean:')[-1]")
    marker = strip(f"regexp_replace({after}, '(?s)\\n[{WS_RE_NO_LF}]*\\n.*', '')")
    return (
        f"CASE WHEN regexp_matches({r}, '{lean}') THEN {strip(f'regexp_extract({r}, {q(lean)}, 1)')} "
        f"WHEN regexp_matches({r}, '{anyf}') THEN {strip(f'regexp_extract({r}, {q(anyf)}, 1)')} "
        f"WHEN contains({r}, 'Lean:') THEN {marker} "
        f"ELSE {strip(r)} END"
    )


def count_char(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


DECL_RE = r"(^|[^\p{L}\p{N}_])(theorem|lemma)($|[^\p{L}\p{N}_])"
BODY_RE = f":=|by[{WS_RE}]"
SUS_RE = f"([^\\x00-\\x7F{WS_RE}{ALLOWED_RE}])"


def suspicious(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '{SUS_RE}', 1)))"


def code_errors(c: str) -> str:
    sus = suspicious(c)
    sus_msg = (
        f"'{S.MSG_UNICODE_PREFIX}' || '{{' || "
        f"array_to_string(list_transform({sus}, lambda x: '''' || x || ''''), ', ') || '}}'"
    )
    checks = [
        f"CASE WHEN {count_char(c, '(')} <> {count_char(c, ')')} THEN {q(S.MSG_UNBALANCED_PARENS)} END",
        f"CASE WHEN {count_char(c, '[')} <> {count_char(c, ']')} THEN {q(S.MSG_UNBALANCED_BRACKETS)} END",
        f"CASE WHEN {count_char(c, '{')} <> {count_char(c, '}')} THEN {q(S.MSG_UNBALANCED_BRACES)} END",
        f"CASE WHEN NOT regexp_matches({c}, '{DECL_RE}') THEN {q(S.MSG_NO_DECLARATION)} END",
        f"CASE WHEN NOT regexp_matches({c}, '{BODY_RE}') THEN {q(S.MSG_NO_BODY)} END",
        f"CASE WHEN len({sus}) > 0 THEN {sus_msg} END",
        f"CASE WHEN {count_char(c, chr(34))} % 2 <> 0 THEN {q(S.MSG_UNTERMINATED_STRING)} END",
    ]
    return "list_filter([" + ", ".join(checks) + "], lambda x: x IS NOT NULL)"


def classify_line(line: str) -> str:
    parts = [f"WHEN regexp_matches({line}, {q(p)}) THEN {q(c)}" for c, p in S.ERROR_PATTERNS]
    return "CASE " + " ".join(parts) + f" ELSE {q(S.OTHER)} END"


def priority(cat: str) -> str:
    parts = [f"WHEN {cat} = {q(c)} THEN {i}" for i, c in enumerate(S.PRIORITY)]
    return "CASE " + " ".join(parts) + f" ELSE {len(S.PRIORITY)} END"


def line_number(line: str) -> str:
    return (
        f"CASE WHEN regexp_matches({line}, ':([0-9]+):[0-9]+:') "
        f"THEN TRY_CAST(regexp_extract({line}, ':([0-9]+):[0-9]+:', 1) AS INTEGER) END"
    )


def quoted(msg: str) -> str:
    return f"CASE WHEN regexp_matches({msg}, '''([^'']+)''') THEN regexp_extract({msg}, '''([^'']+)''', 1) END"


def fixes(cat: str, msg: str) -> str:
    """Fix suggestions joined by ' | ' ('' when none)."""
    ident = quoted(msg)
    with_ident = " || ' | ' || ".join(
        f"{q(t.split('{identifier}')[0])} || {ident} || {q(t.split('{identifier}')[1])}"
        for t in S.FIXES_WITH_IDENTIFIER
    )
    parts = [
        f"WHEN {cat} = {q(S.UNKNOWN_IDENTIFIER)} THEN CASE WHEN {ident} IS NOT NULL THEN {with_ident} "
        f"ELSE {q(' | '.join(S.FIXES_NO_IDENTIFIER))} END"
    ]
    parts += [f"WHEN {cat} = {q(c)} THEN {q(' | '.join(v))}" for c, v in S.FIXES.items()]
    return "CASE " + " ".join(parts) + " ELSE '' END"


def fill(template: str, **values: str) -> str:
    out = q(template)
    for name, expr in values.items():
        out = f"replace({out}, {q('{' + name + '}')}, coalesce({expr}, ''))"
    return out


def repair_prompt(cat: str, msg: str, code: str) -> str:
    ident = f"CASE WHEN {cat} = {q(S.UNKNOWN_IDENTIFIER)} THEN coalesce({quoted(msg)}, '') ELSE '' END"
    parts = [
        f"WHEN {cat} = {q(c)} THEN {fill(t, identifier=ident, original_code=code, error_message=msg)}"
        for c, t in S.REPAIR_TEMPLATES.items()
    ]
    return strip("CASE " + " ".join(parts) + " END")


def stderr_lines_cte(src: str, keys: str, stderr: str = "stderr") -> str:
    """SQL producing (keys, pos, line): non-blank stripped lines, pos 0-based
    among the kept lines."""
    return f"""
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS INT) AS pos, line FROM (
    SELECT {keys}, i, {strip('parts[i]')} AS line FROM (
      SELECT {keys}, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT {keys}, string_split(coalesce({stderr}, ''), chr(10)) AS parts FROM {src})))
  WHERE line <> ''"""
