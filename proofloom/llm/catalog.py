"""Registered queries and oracles of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "toxicity", "passages", "simhash", "licenses", "topk", "mixing", "pieces", "personal", "suffixes", "whitening", "lexical", "contamination"]


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
