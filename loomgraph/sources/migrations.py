"""Versions of the tables' columns: a table written by an older version is read as the newest, or taken back to an older one.

A step adds columns to a table; nothing is rewritten, the columns are null for rows from before. Steps are applied in order
of their version, each once: a column that is there already is left as it is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Step(NamedTuple):
    version: int
    table: str
    columns: dict[str, str]


STEPS = (
    Step(2, "nodes", {"review_date": "timestamp", "tags": "array<string>"}),
    Step(3, "edges", {"weight": "double", "bidirectional": "boolean"}),
    Step(4, "nodes", {"deleted": "boolean"}),
    Step(5, "verified_facts", {"recheck_interval_days": "int", "next_check": "timestamp"}),
)
NEWEST = max(s.version for s in STEPS)


def upgraded(df: DataFrame, table: str, version: int = 1, to: int = NEWEST) -> DataFrame:
    """``df``, written at ``version``, with the columns of the steps up to ``to``."""
    for s in sorted(STEPS):
        if s.table == table and version < s.version <= to:
            df = df.withColumns({c: F.lit(None).cast(t) for c, t in s.columns.items() if c not in df.columns})
    return df


def taken_back(df: DataFrame, table: str, to: int) -> DataFrame:
    """``df`` without the columns of the steps after ``to``."""
    return df.drop(*(c for s in STEPS if s.table == table and s.version > to for c in s.columns))


def versions(spark, applied: DataFrame | None = None) -> DataFrame:
    """(version, table_name) of all steps, those already applied left out."""
    all_ = spark.createDataFrame([(s.version, s.table) for s in STEPS], "version int, table_name string")
    return all_ if applied is None else all_.join(applied.select("version"), "version", "left_anti")
