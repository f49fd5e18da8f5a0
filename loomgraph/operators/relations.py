"""Joins of nodes and edges: orphans, neighbours, ties, shared and mutual connections, merges of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scores as sc
from loomgraph.operators.lookup import OWNER, distinct_edges, iso_day, live, prop, symmetric

TEMPORAL_TYPES = ("TRIGGERED", "PRECEDED_BY", "EVOLVED_INTO")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null")


def unconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live nodes that no edge touches, the owner aside."""
    return live(nodes).where(F.col("id") != OWNER).join(endpoints(edges).distinct(), "id", "left_anti")


def stalled(nodes: DataFrame, edges: DataFrame, node_type: str, as_of: str, days: int) -> DataFrame:
    """Active nodes of a type that no edge of the last ``days`` days touches."""
    recent = edges.where(F.col("created_at") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))
    return live(nodes).where((F.col("node_type") == node_type) & (prop("status") == "active")).join(endpoints(recent).distinct(), "id", "left_anti")


def without_neighbour(nodes: DataFrame, edges: DataFrame, node_type: str, neighbour_types: Sequence[str]) -> DataFrame:
    """Nodes of a type with no neighbour of the given types."""
    near = symmetric(edges).select("node_id", "other_id").join(live(nodes).where(F.col("node_type").isin(*neighbour_types)).select(F.col("id").alias("other_id")), "other_id", "left_semi")
    return live(nodes).where(F.col("node_type") == node_type).join(near.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")


def neighbours(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, edge_types: Sequence[str] = (), direction: str = "both") -> DataFrame:
    """(seed_id, edge, other node) of each edge of the seeds (id), the other node live."""
    both = symmetric(distinct_edges(edges))
    if edge_types:
        both = both.where(F.upper("edge_type").isin(*edge_types))
    if direction != "both":
        both = both.where(F.col("direction") == direction)
    other = live(nodes).select(F.col("id").alias("other_id"), F.col("node_type").alias("other_type"), F.col("title").alias("other_title"))
    picked = both.join(seeds.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    return picked.select(F.col("node_id").alias("seed_id"), F.col("id").alias("edge_id"), F.upper("edge_type").alias("edge_type"), "direction", "weight", "confidence", "other_id").join(other, "other_id")


def strongest_ties(edges: DataFrame, nodes: DataFrame, node_type: str = "PERSON") -> DataFrame:
    """Edges between two live nodes of a type, each link once with its best weight."""
    own = live(nodes).where(F.col("node_type") == node_type)
    a, b = own.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), own.select(F.col("id").alias("target_id"), F.col("title").alias("target_title"))
    return edges.join(a, "source_id").join(b, "target_id").groupBy("source_id", "target_id", "source_title", "target_title").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"))


def shared_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that are adjacent to all seeds: one count of distinct seeds, however many there are."""
    seed = seeds.select(F.col("id").alias("node_id")).distinct()
    near = symmetric(edges).select("node_id", "other_id").join(seed, "node_id", "left_semi").distinct()
    return near.groupBy("other_id").agg(F.count("*").alias("n_seeds")).join(seed.select(F.col("node_id").alias("other_id")), "other_id", "left_anti").crossJoin(F.broadcast(seed.agg(F.count("*").alias("wanted")))).where("n_seeds = wanted").select(F.col("other_id").alias("id"), "n_seeds")


def common_neighbour_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n_common) of members (id) that share neighbours: members meet at a neighbour, never pairwise."""
    near = symmetric(edges).select("node_id", "other_id").join(members.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").distinct()
    left, right = near.select(F.col("node_id").alias("a"), "other_id"), near.select(F.col("node_id").alias("b"), "other_id")
    return left.join(right, "other_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"))


def support_counts(nodes: DataFrame, edges: DataFrame, node_type: str, edge_types: Sequence[str]) -> DataFrame:
    """Active nodes of a type with the number of supporting edges: aggregated first, then joined."""
    counts = symmetric(distinct_edges(edges)).where(F.upper("edge_type").isin(*edge_types)).groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n"))
    return live(nodes).where((F.col("node_type") == node_type) & (prop("status") == "active")).join(counts, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("n_support"))


def merge_entities(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (gone_id into kept_id): ends rewritten, self links dropped, one edge for each (source, target,
    type) with the highest weight, then the oldest."""
    to = lambda end: merges.select(F.col("gone_id").alias(end), F.col("kept_id").alias(f"{end}_kept"))
    moved = edges.join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    moved = moved.withColumn("source_id", F.coalesce("source_id_kept", "source_id")).withColumn("target_id", F.coalesce("target_id_kept", "target_id")).drop("source_id_kept", "target_id_kept").where("source_id <> target_id")
    w = Window.partitionBy("source_id", "target_id", "edge_type").orderBy(F.desc_nulls_last("weight"), F.asc_nulls_last("created_at"), "id")
    return moved.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def neighbours_with_due(nodes: DataFrame, edges: DataFrame, node_type: str) -> DataFrame:
    """(id, commitment_id, status, due) of the commitments next to each node of a type."""
    due = live(nodes).where(F.col("node_type") == "COMMITMENT").select(F.col("id").alias("other_id"), prop("status").alias("status"), iso_day(prop("due_date")).alias("due"))
    own = live(nodes).where(F.col("node_type") == node_type).select(F.col("id").alias("node_id"))
    return symmetric(edges).select("node_id", "other_id").distinct().join(own, "node_id", "left_semi").join(due, "other_id").select(F.col("node_id").alias("id"), F.col("other_id").alias("commitment_id"), "status", "due")


def tie_strengths(nodes: DataFrame, edges: DataFrame, as_of: str, node_type: str = "PERSON") -> DataFrame:
    """(id, source_id, target_id, n_shared, strength) of the edges between live nodes of a type, from weight, confidence,
    type, recency and the connections that both ends share.

    Shared connections are counted from the end with fewer neighbours: its neighbours are looked up among those of the
    other end, so a hub is never opened up for each of its ties.
    """
    own = live(nodes).where(F.col("node_type") == node_type).select("id")
    e = distinct_edges(edges).join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    near = symmetric(edges).select("node_id", "other_id").where("other_id is not null and node_id is not null and node_id <> other_id").distinct()
    degree = near.groupBy("node_id").agg(F.count("*").alias("n"))
    pairs = e.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    sized = pairs.join(degree.select(F.col("node_id").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("node_id").alias("b"), F.col("n").alias("n_b")), "b")
    few = F.col("n_a") <= F.col("n_b")
    ends = sized.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("many"))
    opened = ends.join(near.select(F.col("node_id").alias("few"), "other_id"), "few").where("other_id <> many")
    shared = opened.join(near.select(F.col("node_id").alias("many"), "other_id"), ["many", "other_id"]).groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    joined = e.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}).join(shared, ["a", "b"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    share = sc.lookup(sc.TIE_SHARES, F.upper("edge_type"), sc.DEFAULT_TIE_SHARE)
    strength = sc.tie_strength(F.coalesce("weight", F.lit(1.0)), F.coalesce("confidence", F.lit(0.5)), share, sc.recency(F.col("updated_at"), F.lit(as_of).cast("timestamp")), F.col("n_shared"))
    return joined.select("id", "source_id", "target_id", "n_shared", F.round(strength, 3).alias("strength"))
