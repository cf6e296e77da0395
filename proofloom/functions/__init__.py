"""Column functions (built-in expressions only)."""

from .errors import classify_line, classify_stderr, fix_suggestions, line_number, stderr_lines, with_classified, with_primary_error
from .prompts import parse_steps_text, prompt_full, prompt_initial, prompt_repair, repair_stub
from .text import (
    code_errors,
    code_length,
    collapse_ws,
    content_key,
    extract_code,
    normalized_hash,
    py_strip,
    render_module,
    sha16,
    validate_code,
)

__all__ = [
    "classify_line", "classify_stderr", "code_errors", "code_length", "collapse_ws",
    "content_key", "extract_code", "fix_suggestions", "line_number", "normalized_hash",
    "parse_steps_text", "prompt_full", "prompt_initial", "prompt_repair",
    "py_strip", "render_module", "repair_stub", "sha16", "stderr_lines", "validate_code",
    "with_classified", "with_primary_error",
]
