"""Queries of the training-data operators."""

from __future__ import annotations

from loomgraph.llm import problems

PARTS = [problems]


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for p in PARTS for k, q in p.SQL.items()}
