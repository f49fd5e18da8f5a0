"""Types of the graph and their rules, and checks of nodes and edges against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edge type -> (category, source types or None for any, target types or None, cardinality or None).
EDGE_RULES = {
    "PART_OF": ("STRUCTURAL", None, None, "MANY_TO_ONE"),
    "CONTAINS": ("STRUCTURAL", None, None, None),
    "SUBTASK_OF": ("STRUCTURAL", ["COMMITMENT", "GOAL", "PROJECT"], ["COMMITMENT", "GOAL", "PROJECT"], "MANY_TO_ONE"),
    "RELATED_TO": ("ASSOCIATIVE", None, None, None),
    "INSPIRED_BY": ("ASSOCIATIVE", None, None, None),
    "CONTRADICTS": ("ASSOCIATIVE", None, None, None),
    "SIMILAR_TO": ("ASSOCIATIVE", None, None, None),
    "COMPLEMENTS": ("ASSOCIATIVE", None, None, None),
    "DERIVED_FROM": ("PROVENANCE", None, None, None),
    "VERIFIED_BY": ("PROVENANCE", None, ["REFERENCE", "PERSON"], None),
    "SOURCE_OF": ("PROVENANCE", ["REFERENCE", "PERSON"], None, None),
    "EXTRACTED_FROM": ("PROVENANCE", None, None, None),
    "PRECEDED_BY": ("TEMPORAL", None, None, None),
    "EVOLVED_INTO": ("TEMPORAL", None, None, None),
    "TRIGGERED": ("TEMPORAL", None, None, None),
    "CONCURRENT_WITH": ("TEMPORAL", None, None, None),
    "COMMITTED_TO": ("PERSONAL", ["PERSON"], ["COMMITMENT"], None),
    "DECIDED": ("PERSONAL", ["PERSON"], ["DECISION"], None),
    "FELT_ABOUT": ("PERSONAL", ["PERSON"], None, None),
    "RESPONSIBLE_FOR": ("PERSONAL", ["PERSON"], None, None),
    "KNOWS": ("SOCIAL", ["PERSON"], ["PERSON"], None),
    "INTRODUCED_BY": ("SOCIAL", ["PERSON"], ["PERSON"], None),
    "OWES_FAVOR": ("SOCIAL", ["PERSON"], ["PERSON"], None),
    "COLLABORATES_WITH": ("SOCIAL", ["PERSON"], ["PERSON"], None),
    "REPORTS_TO": ("SOCIAL", ["PERSON"], ["PERSON"], None),
    "BRIDGES": ("NETWORK", None, None, None),
    "MEMBER_OF": ("NETWORK", None, ["PROJECT", "EVENT", "ORGANIZATION"], None),
    "IMPACTS": ("NETWORK", None, None, None),
    "CORRELATES_WITH": ("NETWORK", None, None, None),
    "HOLDS_POSITION": ("STRATEGIC", ["PERSON"], ["POSITION"], "ONE_TO_MANY"),
    "CANDIDATE_IN": ("STRATEGIC", ["PERSON"], ["ELECTION"], None),
    "PREREQUISITE_OF": ("STRUCTURAL", ["COURSE", "COMMITMENT", "GOAL"], ["COURSE", "COMMITMENT", "GOAL"], None),
    "MEASURES": ("ASSOCIATIVE", ["METRIC"], None, None),
    "COMPETES_WITH": ("STRATEGIC", ["PERSON", "ORGANIZATION"], ["PERSON", "ORGANIZATION"], None),
    "ENDORSES": ("STRATEGIC", ["PERSON", "ORGANIZATION"], ["PERSON"], None),
    "OPPOSES": ("STRATEGIC", ["PERSON", "ORGANIZATION"], None, None),
}
INTERFACES = {"SCHEDULABLE": ("EVENT", "COMMITMENT", "GOAL"), "TRACKABLE": ("COMMITMENT", "GOAL", "PROJECT", "POSITION", "COURSE")}
VALUE_PATTERNS = {"URL": r"^https?://\S+$", "CURRENCY_CODE": r"^[A-Z]{3}$"}


def edge_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table of fixed size: (edge_type, category, sources, targets, cardinality)."""
    rows = [(k, *v) for k, v in EDGE_RULES.items()]
    return spark.createDataFrame(rows, "edge_type string, category string, sources array<string>, targets array<string>, cardinality string")


def judged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with the first rule that it breaks, null if none: unknown_type, no_source, no_target, source_type,
    target_type, category."""
    kinds = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("node_type").alias(f"{end}_type"))
    e = edges.withColumn("type", F.upper("edge_type")).join(F.broadcast(edge_rules(edges.sparkSession).withColumnRenamed("edge_type", "type")), "type", "left")
    e = e.join(kinds("source"), "source_id", "left").join(kinds("target"), "target_id", "left")
    fits = lambda allowed, kind: F.col(allowed).isNull() | F.array_contains(allowed, F.col(kind))
    broken = (
        F.when(F.col("category").isNull(), "unknown_type")
        .when(F.col("source_type").isNull(), "no_source")
        .when(F.col("target_type").isNull(), "no_target")
        .when(~fits("sources", "source_type"), "source_type")
        .when(~fits("targets", "target_type"), "target_type")
        .when(F.col("edge_category") != F.col("category"), "category")
    )
    return e.withColumn("broken", broken)


def cardinality_breaks(edges: DataFrame) -> DataFrame:
    """(edge_type, id, n): ends with more partners than the type allows."""
    rules = F.broadcast(edge_rules(edges.sparkSession).where("cardinality is not null").select(F.col("edge_type").alias("type"), "cardinality"))
    e = edges.withColumn("type", F.upper("edge_type")).join(rules, "type")
    end = F.when(F.col("cardinality") == "MANY_TO_ONE", F.col("source_id")).otherwise(F.col("target_id"))
    partner = F.when(F.col("cardinality") == "MANY_TO_ONE", F.col("target_id")).otherwise(F.col("source_id"))
    return e.select("type", end.alias("id"), partner.alias("partner")).distinct().groupBy(F.col("type").alias("edge_type"), "id").agg(F.count("*").alias("n")).where("n > 1")


def valid_value(kind: str, value: Column) -> Column:
    if kind in VALUE_PATTERNS:
        return value.rlike(VALUE_PATTERNS[kind])
    if kind == "PERCENTAGE":
        return value.try_cast("double").between(0.0, 1.0)
    raise ValueError(f"no such value type: {kind}")
