"""Every query of the engine with the SQL that states its result."""

from __future__ import annotations

from . import agents, graphs, hybrid, registry, retrieval, streams, surface, texts, tiers  # noqa: F401  each adds its queries

flagship = retrieval.flagship


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
