"""Write path as whole-table transforms: merges of changes, checked commits of proposals, soft deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ontology import judged_edges


def append_new(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """``stored`` and the arriving rows whose key is not there yet, one for each key (the first by id)."""
    w = Window.partitionBy(key).orderBy("id")
    fresh = arriving.withColumn("r", F.row_number().over(w)).where(F.col(key).isNull() | (F.col("r") == 1)).drop("r").join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version for each key, changes winning at equal versions."""
    both = stored.withColumn("side", F.lit(0)).unionByName(changes.select(*stored.columns).withColumn("side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("side"))
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "side")


def patch(stored: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Partial updates: a non-null value of a change replaces the stored one; other columns stay."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"new_{c}") for c in columns)).dropDuplicates([key])
    joined = stored.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns))


def merge_json(stored: str, change: str) -> F.Column:
    """A JSON object of strings with the members of another over it; broken JSON counts as empty."""
    kind = "map<string,string>"
    empty = F.from_json(F.lit("{}"), kind)
    old, new = F.coalesce(F.from_json(stored, kind), empty), F.coalesce(F.from_json(change, kind), empty)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.map_concat(kept, new))


def soft_delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return nodes.join(gone, "id", "left").withColumn("deleted", F.coalesce("gone", "deleted", F.lit(False))).drop("gone").select(*nodes.columns)


def commit_proposals(nodes: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new nodes, new edges, verdicts) of proposals (proposal_id, nodes_to_create, edges_to_create).

    Temporary ids become ids made from the proposal and the temporary id, so a job that runs again makes the same ones.
    A proposal is all or nothing: one edge that breaks a rule rejects it, and nothing of it is written.
    """
    made = proposals.select("proposal_id", F.explode("nodes_to_create").alias("n")).select(
        "proposal_id", F.md5(F.concat_ws("|", "proposal_id", "n.temp_id")).alias("id"), F.col("n.temp_id").alias("temp_id"), F.col("n.node_type").alias("node_type"), F.col("n.title").alias("title"), F.col("n.confidence").alias("confidence")
    )
    edges = proposals.select("proposal_id", F.posexplode("edges_to_create").alias("pos", "e")).select("proposal_id", "pos", F.col("e.source_id").alias("s"), F.col("e.target_id").alias("t"), F.col("e.edge_type").alias("edge_type"))
    real = lambda end: made.select("proposal_id", F.col("temp_id").alias(end), F.col("id").alias(f"{end}_id"))
    placed = edges.join(real("s"), ["proposal_id", "s"], "left").join(real("t"), ["proposal_id", "t"], "left")
    placed = placed.select("proposal_id", "pos", F.coalesce("s_id", "s").alias("source_id"), F.coalesce("t_id", "t").alias("target_id"), "edge_type", F.lit(None).cast("string").alias("edge_category"))
    known = nodes.select("id", "node_type").unionByName(made.select("id", "node_type"))
    judged = judged_edges(placed, known)
    bad = judged.where("broken is not null").groupBy("proposal_id").agg(F.min("broken").alias("reason"))
    verdicts = proposals.select("proposal_id").join(bad, "proposal_id", "left").select("proposal_id", F.when(F.col("reason").isNull(), "approved").otherwise("rejected").alias("status"), "reason")
    good = verdicts.where("status = 'approved'").select("proposal_id")
    return made.join(good, "proposal_id", "left_semi").drop("temp_id"), judged.join(good, "proposal_id", "left_semi").select("proposal_id", "source_id", "target_id", "edge_type", F.col("category").alias("edge_category")), verdicts
