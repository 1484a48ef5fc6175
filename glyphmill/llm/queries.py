"""All queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["packing", "url_filter", "shingle_join", "line_dedup", "exact_topk", "piece_codec", "sharding", "quality", "transcripts", "ann", "infill", "prefix_trie", "embedding_dedup", "pipeline_query"]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


QUERIES = _gather("QUERIES")
SQL = _gather("SQL")
