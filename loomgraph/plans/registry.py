"""Queries and oracle SQL of the core: one module for each area."""

from __future__ import annotations

from loomgraph.plans import briefing, compositions, core_problems, graphs, knowledge, records, relational, resolution, scoring, streams

PARTS = [relational, scoring, graphs, knowledge, records, resolution, streams, compositions, briefing, core_problems]
FLAGSHIP = "network_health"


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for p in PARTS for k, q in p.SQL.items()}
