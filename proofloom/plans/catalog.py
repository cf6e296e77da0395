"""All registered queries and oracles, merged from the per-section catalogs."""

from __future__ import annotations

import importlib

SECTIONS = [
    "catalog_results",
    "catalog_text",
    "catalog_items",
    "catalog_io",
    "catalog_rounds",
]


def _load():
    queries, oracles = {}, {}
    for name in SECTIONS:
        mod = importlib.import_module(f"{__package__}.{name}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    missing = set(oracles) - set(queries)
    assert not missing, f"oracles without a query: {missing}"
    return queries, oracles


def queries():
    return _load()[0]


def oracles():
    return _load()[1]
