"""Prompt columns: the first-attempt prompt, repair prompts per error
category, and the full instruction prompt built from a caller's template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .errors import quoted_name
from .text import ColumnOrName, _c, py_strip

# Our own instruction template for ``prompt_full``; callers pass theirs.
# Placeholders: {statement}, {steps}.
DEFAULT_FULL_TEMPLATE = (
    "Translate the statement below into one complete Lean 4 theorem with its proof.\n\n"
    "Statement: {statement}\n"
    "Proof steps: {steps}\n\n"
    "Answer with the Lean code only, in a ```lean block, using tactic mode (by).\n"
)


def joined_steps(steps: ColumnOrName, empty_text: str | None = None) -> Column:
    """Steps joined with ``", "``; ``empty_text`` when there are none."""
    s = F.coalesce(_c(steps), F.array().cast("array<string>"))
    joined = F.array_join(s, ", ")
    if empty_text is None:
        return joined
    return F.when(F.size(s) > 0, joined).otherwise(F.lit(empty_text))


def fill(template: str, **values: Column) -> Column:
    """Fill the ``{name}`` placeholders of a literal template in one pass
    (values are inserted verbatim, like ``str.format``)."""
    fmt = template.replace("%", "%%")
    names = list(values)
    for i, name in enumerate(names, start=1):
        fmt = fmt.replace("{" + name + "}", f"%{i}$s")
    return F.format_string(fmt, *[F.coalesce(values[n], F.lit("")) for n in names])


def prompt_full(statement: ColumnOrName, steps: ColumnOrName, template: str = DEFAULT_FULL_TEMPLATE) -> Column:
    return fill(template, statement=_c(statement), steps=joined_steps(steps, S.NO_STEPS_TEXT))


def prompt_initial(statement: ColumnOrName, steps: ColumnOrName) -> Column:
    """``Convert this to Lean 4:`` prompt; the steps line only when steps exist."""
    s = F.coalesce(_c(steps), F.array().cast("array<string>"))
    head = F.concat(F.lit(S.INITIAL_PROMPT_HEAD), F.coalesce(_c(statement), F.lit("")), F.lit("\n"))
    steps_line = F.concat(F.lit(S.INITIAL_PROMPT_STEPS), F.array_join(s, ", "), F.lit("\n"))
    return F.when(F.size(s) > 0, F.concat(head, steps_line)).otherwise(head)


def repair_stub(statement: ColumnOrName) -> Column:
    """The stub code the repair prompt embeds by default."""
    return F.concat(F.lit(S.REPAIR_STUB_HEAD), F.coalesce(_c(statement), F.lit("")), F.lit(S.REPAIR_STUB_TAIL))


def _printf_template(template: str) -> str:
    """A ``{name}`` template as a positional printf format (one pass, values
    inserted verbatim, like ``str.format``)."""
    out = template.replace("%", "%%")
    for i, name in enumerate(("identifier", "original_code", "error_message"), start=1):
        out = out.replace("{" + name + "}", f"%{i}$s")
    return out


def prompt_repair(category: ColumnOrName, message: ColumnOrName, original_code: ColumnOrName) -> Column:
    """Template by category, filled with identifier, code and message in one
    pass, stripped.  Only the branch of the row's category is evaluated."""
    cat = _c(category)
    msg = F.coalesce(_c(message), F.lit(""))
    code = F.coalesce(_c(original_code), F.lit(""))
    ident = F.when(cat == S.UNKNOWN_IDENTIFIER, F.coalesce(quoted_name(msg), F.lit(""))).otherwise(F.lit(""))
    expr = None
    for name, template in S.REPAIR_TEMPLATES.items():
        filled = F.format_string(_printf_template(template), ident, code, msg)
        expr = (F.when if expr is None else expr.when)(cat == name, filled)
    other = F.format_string(_printf_template(S.REPAIR_TEMPLATES[S.OTHER]), ident, code, msg)
    return py_strip(expr.otherwise(other))


def parse_steps_text(text: ColumnOrName) -> Column:
    """``a; b ;; c`` -> ``[a, b, c]``: split on ';', strip, drop empties."""
    return F.filter(F.transform(F.split(_c(text), ";", -1), py_strip), lambda x: x != "")
