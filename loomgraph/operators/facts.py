"""Verified facts: duplicates, contradictions, decay of confidence and check history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scores import days_between

# How far a source is trusted, and words that carry no statement.
SOURCE_WEIGHTS = {"pipeline_auto": 0.85, "archivist": 0.85, "researcher": 0.75, "outcome_tracker": 1.0, "action_engine": 0.90, "user": 1.0}
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "on", "at", "and", "or", "for", "with", "by", "from", "it", "that", "this", "as", "be", "has", "have", "had")


def statement_key(column: str = "statement"):
    return F.lower(F.trim(column))


def distinct_facts(facts: DataFrame) -> DataFrame:
    return facts.dropDuplicates(["id"])


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Facts that repeat an earlier statement about the same node: the first is kept, the others point to it."""
    w = Window.partitionBy("node_id", statement_key()).orderBy(F.asc_nulls_last("created_at"), "id")
    first = F.first("id").over(w)
    return distinct_facts(facts).where("node_id is not null and statement is not null").select("id", first.alias("first_id")).where("id <> first_id")


def words(column: str = "statement"):
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(column), r"[^a-z0-9]+"), lambda w: F.length(w) > 1)), F.array(*map(F.lit, STOPWORDS)))


def possible_contradictions(facts: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(a, b, n_common) of different active statements about one node that share enough words: at least ``least`` and
    ``share`` of the shorter one."""
    own = distinct_facts(facts).where("node_id is not null and statement is not null and status = 'active'").select("id", "node_id", statement_key().alias("key"), words().alias("words"))
    a, b = own.select(F.col("id").alias("a"), "node_id", F.col("key").alias("key_a"), F.col("words").alias("words_a")), own.select(F.col("id").alias("b"), "node_id", F.col("key").alias("key_b"), F.col("words").alias("words_b"))
    n = F.size(F.array_intersect("words_a", "words_b"))
    needed = F.greatest(F.lit(float(least)), share * F.least(F.size("words_a"), F.size("words_b")))
    return a.join(b, "node_id").where("a < b and key_a <> key_b").select("a", "b", n.alias("n_common"), needed.alias("needed")).where("n_common >= needed").select("a", "b", "n_common")


def faded_confidence(facts: DataFrame, as_of: str, rate: float = 0.9, stale_below: float = 0.4, usual_days: int = 90) -> DataFrame:
    """Overdue dynamic facts lose confidence for each interval they are late; below the limit they are stale. An interval
    that is missing or not above 0 counts as ``usual_days``."""
    days = days_between(F.lit(as_of).cast("timestamp"), F.col("next_check"))
    interval = F.when(F.col("recheck_interval_days") > 0, F.col("recheck_interval_days")).otherwise(usual_days)
    steps = F.greatest(F.lit(1), F.floor(days / interval) + 1)
    due = distinct_facts(facts).where("lifecycle = 'dynamic' and status = 'active'").where(days >= 0)
    new = F.round(F.greatest(F.lit(0.0), F.col("confidence") * F.pow(F.lit(rate), steps)), 4)
    return due.select("id", F.col("confidence").alias("old_confidence"), new.alias("new_confidence"), F.when(new < stale_below, "stale").otherwise("active").alias("new_status"))


def check_history(checks: DataFrame) -> DataFrame:
    """Each check with its number for the fact and whether its result differs from the one before."""
    w = Window.partitionBy("fact_id").orderBy("checked_at", "id")
    own = checks.dropDuplicates(["id"]).where("fact_id is not null and checked_at is not null")
    return own.select("id", "fact_id", F.row_number().over(w).cast("long").alias("number"), F.coalesce(F.lag("result").over(w) != F.col("result"), F.lit(False)).alias("changed"))
