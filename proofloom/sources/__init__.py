"""Sources and sinks."""

from .items import scan_checked, scan_corrupt, scan_items, scan_numbered, scan_strict, scan_union_files
from .sinks import sink_document, sink_jsonl, sink_report, sink_rows_jsonl, sink_splits, sink_validation_report

__all__ = [
    "scan_checked", "scan_corrupt", "scan_items", "scan_numbered", "scan_strict", "scan_union_files",
    "sink_document", "sink_jsonl", "sink_report", "sink_rows_jsonl", "sink_splits", "sink_validation_report",
]
