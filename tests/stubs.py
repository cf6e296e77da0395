"""Deterministic stand-ins for the model and the checker (tests, benches).

Both derive their answer from a SHA-256 of the input."""

from __future__ import annotations

import hashlib


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


class StubModel:
    """Reply chosen by ``sha256(prompt + '|' + seed)``:

    * first hex digit 0-3: a ```lean fenced theorem (structurally valid)
    * 4-7: a bare fence with a lemma (valid)
    * 8-b: text after ``Lean:`` with an unclosed parenthesis (invalid)
    * c-f: prose without a declaration (invalid)
    The call fails (raises) when the 8th hex digit is ``0``.
    """

    def __init__(self, fail: bool = True) -> None:
        self.fail = fail

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, seed: int | None = None, **_: object) -> str:
        h = _h(f"{prompt}|{seed}")
        if self.fail and h[7] == "0":
            raise RuntimeError(f"stub outage {h[:4]}")
        d = h[0]
        if d in "0123":
            return f"```lean\ntheorem t{h[1:7]} : True := by\n  trivial\n```"
        if d in "4567":
            return f"Here:\n```\nlemma l{h[1:5]} (a : Nat) : a = a := rfl\n```"
        if d in "89ab":
            return f"Lean:\ntheorem bad{h[1:5]} : (a = a := by simp"
        return f"I cannot do this {h[1:7]}"


class StubChecker:
    """Verdict chosen by ``sha256(code)``: ok when the first hex digit is
    below 8; otherwise a checker message picked by the second digit.
    ``raise_on`` (a hex digit) makes the checker raise for codes whose
    third digit equals it (to exercise failed items)."""

    MESSAGES = {
        "0123": "c.lean:2:4: error: unknown identifier 'foo'",
        "4567": "c.lean:1:10: error: type mismatch\n  expected Nat, got Int",
        "89ab": "error: unsolved goals\n⊢ True",
        "cdef": "c.lean:3:1: error: unexpected token ':='",
    }

    def __init__(self, raise_on: str | None = None) -> None:
        self.raise_on = raise_on

    def __call__(self, code: str) -> tuple[bool, str]:
        h = _h(code)
        if self.raise_on is not None and h[2] == self.raise_on:
            raise RuntimeError(f"checker crashed on {h[:6]}")
        if h[0] < "8":
            return True, ""
        for digits, msg in self.MESSAGES.items():
            if h[1] in digits:
                return False, msg
        raise AssertionError("unreachable")


def stub_model_factory() -> StubModel:
    return StubModel()


def stub_checker_factory() -> StubChecker:
    return StubChecker()


def raising_checker_factory() -> StubChecker:
    """A checker that crashes on about one code in sixteen."""
    return StubChecker(raise_on="f")
