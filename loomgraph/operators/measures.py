"""Counts and rates over the graph: one pass per result, conditional aggregates instead of a query for each network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.lookup import OWNER, distinct_edges, iso_day, live, prop, symmetric

NETWORKS = ("ACADEMIC", "PROFESSIONAL", "FINANCIAL", "HEALTH", "PERSONAL_GROWTH", "SOCIAL", "VENTURES", "GOVERNANCE", "CLUBS")


def per_network(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("network", F.explode("networks"))


def all_networks(df: DataFrame) -> DataFrame:
    """Outer join with the fixed list of networks, so that one without rows shows with zeros."""
    names = df.sparkSession.createDataFrame([(n,) for n in NETWORKS], "network string")
    return F.broadcast(names).join(df, "network", "left")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, name, n): totals, and counts by node type, edge type and network."""
    own = live(nodes)
    n = F.count("*").alias("n")
    parts = [
        own.groupBy(F.lit("nodes").alias("measure"), F.lit("all").alias("name")).agg(n),
        own.groupBy(F.lit("node_type").alias("measure"), F.col("node_type").alias("name")).agg(n),
        per_network(own).groupBy(F.lit("network").alias("measure"), F.col("network").alias("name")).agg(n),
        distinct_edges(edges).groupBy(F.lit("edge_type").alias("measure"), F.upper("edge_type").alias("name")).agg(n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, degree) with map-side combine: a hub sends one row a partition."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("e")).select("e.*").where("id is not null").groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def status_of(completion: Column, alert: Column, stale_flags: Column) -> Column:
    return (
        F.when((completion < 0.4) | (alert > 0.3) | (stale_flags >= 2), "falling_behind")
        .when((completion < 0.7) | (alert >= 0.1), "needs_attention")
        .otherwise("on_track")
    )


HEALTH_COUNTS = ("n_commitments", "n_completed", "n_open", "n_overdue", "n_stale", "n_nodes")


def network_health(nodes: DataFrame, months: list[str]) -> DataFrame:
    """Health of each network at each snapshot (midnights, ascending), with the momentum against the snapshot before.

    Completion is that of the commitments created so far (1 without any), alerts are open ones past their day (0 without
    any open), a network is stale by the nodes with a decay score below 0.3.
    """
    snaps = F.array(*(F.lit(m).cast("timestamp_ntz") for m in months))
    first_after = lambda x: F.array_min(F.filter(snaps, lambda m: m > x))
    status, due, created = prop("status"), iso_day(prop("due_date")).cast("timestamp_ntz"), F.col("created_at").cast("timestamp_ntz")
    is_c = F.col("node_type") == "COMMITMENT"
    is_open = is_c & (status == "open")
    # each node counts from the first snapshot after it appears, an overdue one from the first after its day as well:
    # rows are summed by that snapshot and the sums run over the few snapshots, so no row meets every snapshot
    one = lambda at, **n: F.struct(first_after(at).alias("snapshot"), *(F.coalesce(n[k].cast("int"), F.lit(0)).alias(k) if k in n else F.lit(0).alias(k) for k in HEALTH_COUNTS))
    marks = F.array(
        one(created, n_commitments=is_c, n_completed=is_c & (status == "completed"), n_open=is_open, n_stale=F.col("decay_score") < 0.3, n_nodes=F.lit(True)),
        # the day before the snapshot's day is overdue, hence the plain comparison of midnights
        one(F.greatest(created, due), n_overdue=is_open & due.isNotNull()),
    )
    summed = per_network(live(nodes)).select("network", F.explode(marks).alias("m")).select("network", "m.*").where("snapshot is not null").groupBy("network", "snapshot").agg(*(F.sum(c).alias(c) for c in HEALTH_COUNTS))
    spark = nodes.sparkSession
    grid = summed.select("network").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in months], "s string").select(F.col("s").cast("timestamp_ntz").alias("snapshot"))))
    so_far = Window.partitionBy("network").orderBy("snapshot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = grid.join(summed, ["network", "snapshot"], "left").select("network", "snapshot", *(F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in HEALTH_COUNTS)).where("n_nodes > 0")
    completion = F.when(F.col("n_commitments") == 0, 1.0).otherwise(F.col("n_completed") / F.col("n_commitments"))
    alert = F.when(F.col("n_open") == 0, 0.0).otherwise(F.col("n_overdue") / F.col("n_open"))
    flags = (F.col("n_stale") > 0.5 * F.col("n_nodes")).cast("int") + (F.col("n_overdue") > 10).cast("int")
    scored = agg.select("network", "snapshot", F.round(completion, 6).alias("completion_rate"), F.round(alert, 6).alias("alert_ratio"), F.col("n_stale"), status_of(completion, alert, flags).alias("status"))
    w = Window.partitionBy("network").orderBy("snapshot")
    before_c, before_a = F.lag("completion_rate").over(w), F.lag("alert_ratio").over(w)
    momentum = (
        F.when(before_c.isNull(), "stable")
        .when((F.col("completion_rate") > before_c + 0.05) & (F.col("alert_ratio") < before_a), "up")
        .when((F.col("completion_rate") < before_c - 0.05) | (F.col("alert_ratio") > before_a + 0.05), "down")
        .otherwise("stable")
    )
    return scored.withColumn("momentum", momentum)


def commitment_stats(nodes: DataFrame, as_of: str) -> DataFrame:
    """By network: total, open, completed, overdue and the completion rate."""
    status = prop("status")
    own = per_network(live(nodes).where(F.col("node_type") == "COMMITMENT"))
    late = (status == "open") & (iso_day(prop("due_date")) < F.to_date(F.lit(as_of)))
    return own.groupBy("network").agg(
        F.count("*").alias("total"), F.count_if(status == "open").alias("n_open"), F.count_if(status == "completed").alias("n_completed"), F.count_if(late).alias("n_overdue"), F.round(F.count_if(status == "completed") / F.count("*"), 6).alias("completion_rate")
    )


def people_stats(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Each person with degree, days since the last update and an activity band; the owner aside."""
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("updated_at"))
    band = F.when(days.isNull(), "unknown").when(days < 30, "active").when(days < 90, "fading").otherwise("cold")
    people = live(nodes).where((F.col("node_type") == "PERSON") & (F.col("id") != OWNER))
    return people.join(degrees(distinct_edges(edges)).select("id", "degree"), "id", "left").select("id", "title", "networks", F.coalesce("degree", F.lit(0)).alias("degree"), days.alias("idle_days"), band.alias("band"))


def neighbour_type_counts(nodes: DataFrame, edges: DataFrame, node_type: str) -> DataFrame:
    """(id, other_type, n) of the distinct live neighbours of each node of a type."""
    near = symmetric(edges).select("node_id", "other_id").distinct()
    own = live(nodes).where(F.col("node_type") == node_type).select(F.col("id").alias("node_id"))
    other = live(nodes).select(F.col("id").alias("other_id"), F.col("node_type").alias("other_type"))
    return near.join(own, "node_id", "left_semi").join(other, "other_id").groupBy(F.col("node_id").alias("id"), "other_type").agg(F.count("*").alias("n"))
