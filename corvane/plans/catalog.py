"""Collects the registered queries of the library's own operators."""

from __future__ import annotations

from . import code_queries, config_queries, diagram_queries, document_queries, drift_queries, graph_queries, history_queries, model_queries, output_queries, registry, render_queries, source_queries, stream_queries, upkeep_queries  # noqa: F401  registers its queries

FLAGSHIP = "project_l2_edges"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
