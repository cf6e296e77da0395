"""Operators for large training-data pipelines, one module per operator.

``catalog.queries()`` and ``catalog.oracles()`` hold the registered queries.
Nothing outside this subpackage imports it, except ``corpus_pipeline.py``.
"""
