"""What lies ahead: time-bound nodes with five signals of priority, their buckets, and what waits for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scores as sc
from loomgraph.operators.lookup import live, prop, symmetric
from loomgraph.operators.measures import network_health

# The kinds that count with the statuses that keep them open, weights of the signals, marks of a health.
OPEN_STATUSES = {"COMMITMENT": ("open", "overdue"), "GOAL": ("active",), "PROJECT": ("active",), "EVENT": (), "DECISION": ()}
WEIGHTS = {"urgency": 0.35, "centrality": 0.15, "health_impact": 0.20, "decay_momentum": 0.10, "dependency_depth": 0.20}
HEALTH_MARKS = {"falling_behind": 1.0, "needs_attention": 0.6}
QUIET, STEP, DEEPEST = 0.2, 0.2, 5


def items(nodes: DataFrame, as_of: str) -> DataFrame:
    """Open time-bound nodes with ``days``, whole days until their date (null without one), and ``late``."""
    open_ = F.lit(False)
    for kind, statuses in OPEN_STATUSES.items():
        fits = F.col("node_type") == kind
        open_ = open_ | (fits & prop("status").isin(*statuses) if statuses else fits)
    at = sc.iso_instant(sc.by_type({k: prop(f) for k, f in sc.DATE_FIELDS.items() if k in OPEN_STATUSES}))
    left = sc.days_between(at, F.lit(as_of).cast("timestamp"))
    whole = F.when(left >= 0, F.floor(left)).otherwise(F.ceil(left)).cast("long")
    return live(nodes).where(F.coalesce(open_, F.lit(False))).withColumns({"days": whole, "late": F.coalesce(left < 0, F.lit(False))})


def bucket() -> Column:
    d = F.col("days")
    return (
        F.when(d.isNull(), "undated").when(F.col("late"), "overdue").when(d == 0, "today").when(d == 1, "tomorrow").when(d <= 7, "this_week").when(d <= 14, "next_week").when(d <= 30, "this_month").otherwise("later")
    )


def subtasks(edges: DataFrame) -> DataFrame:
    """(child, parent) of the subtask links, one parent for each child."""
    e = edges.where((F.upper("edge_type") == "SUBTASK_OF") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return e.groupBy(F.col("source_id").alias("child")).agg(F.min("target_id").alias("parent"))


def chain_depth(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, depth): steps up the subtask links, DEEPEST at most, as the score grows no further; a cycle ends the way."""
    state = ids.select("id", F.col("id").alias("at"), F.array("id").alias("way"), F.lit(0).alias("depth"))
    for _ in range(DEEPEST):
        up = parents.select(F.col("child").alias("at"), "parent")
        seen = F.size("way") > F.col("depth") + 1  # the last step met a node of the way
        go = F.col("parent").isNotNull() & ~seen
        state = state.join(up, "at", "left").select(
            "id",
            F.when(go, F.col("parent")).otherwise(F.col("at")).alias("at"),
            F.when(go, F.when(F.array_contains("way", F.col("parent")), F.concat("way", F.array("parent", "parent"))).otherwise(F.concat("way", F.array("parent")))).otherwise(F.col("way")).alias("way"),
            F.when(go, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
        )
    return state.select("id", "depth")


def scored(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """(id, node_type, days, bucket, five signals, priority, networks) of all items."""
    own = items(nodes, as_of)
    waiting = edges.where(F.upper("edge_type") == "SUBTASK_OF").select("id", "target_id").distinct().groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_waiting"))
    marks = network_health(nodes, [as_of]).select("network", "status")
    mark = F.when(F.col("status") == "falling_behind", 1.0).when(F.col("status") == "needs_attention", 0.6).otherwise(QUIET)
    worst = own.select("id", F.explode("networks").alias("network")).join(F.broadcast(marks), "network", "left").groupBy("id").agg(F.max(mark).alias("worst"))
    j = own.join(waiting, "id", "left").join(worst, "id", "left").join(chain_depth(own.select("id"), subtasks(edges)), "id", "left")
    n = F.coalesce("n_waiting", F.lit(0))
    s = {
        "urgency": sc.urgency(F.col("days")),
        "centrality": F.when(n > 0, F.log1p(n) / F.log(F.lit(11.0))).otherwise(0.0),
        "health_impact": F.coalesce("worst", F.lit(QUIET)),
        "decay_momentum": 1 - F.coalesce("decay_score", F.lit(1.0)),
        "dependency_depth": F.least(F.col("depth") * STEP, F.lit(1.0)),
    }
    out = j.select("id", "node_type", "networks", "days", bucket().alias("bucket"), *(v.alias(k) for k, v in s.items()))
    return out.withColumn("priority", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))


def network_load(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("networks").alias("network"), "bucket").groupBy("network").agg(F.count("*").alias("n_items"), F.count_if(F.col("bucket") == "overdue").alias("n_overdue"))


def blocked_by(ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, blocked_id): live nodes that are subtasks of the given ones."""
    e = edges.where(F.upper("edge_type") == "SUBTASK_OF").select(F.col("target_id").alias("id"), F.col("source_id").alias("blocked_id")).distinct()
    return e.join(ids.select("id"), "id", "left_semi").join(live(nodes).select(F.col("id").alias("blocked_id")), "blocked_id", "left_semi").select("id", "blocked_id")


def impact(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """(id, n_unblocked, worst_status) of each item: what its completion frees, and how its networks stand now."""
    own = items(nodes, as_of).where(F.col("node_type").isin("COMMITMENT", "GOAL"))
    freed = blocked_by(own.select("id"), edges, nodes).groupBy("id").agg(F.count("*").alias("n_unblocked"))
    rank = F.when(F.col("status") == "falling_behind", 2).when(F.col("status") == "needs_attention", 1).otherwise(0)
    worst = own.select("id", F.explode("networks").alias("network")).join(F.broadcast(network_health(nodes, [as_of]).select("network", "status")), "network").groupBy("id").agg(F.max_by("status", rank).alias("worst_status"))
    return own.select("id").join(freed, "id", "left").join(worst, "id", "left").select("id", F.coalesce("n_unblocked", F.lit(0)).alias("n_unblocked"), "worst_status")


def answers(focus: DataFrame, nodes: DataFrame, edges: DataFrame, words: tuple[str, ...], node_types: tuple[str, ...], edge_types: tuple[str, ...], check_properties: bool) -> DataFrame:
    """(focus_id, id, score) of the neighbours (one link away) that answer a question about a node: by their type, the link's
    type, a stated status and the question's words in title or content."""
    other = live(nodes).select(F.col("id").alias("other_id"), F.col("node_type").alias("other_type"), "properties", F.lower(F.concat_ws(" ", "title", F.coalesce("content", F.lit("")))).alias("text"))
    near = symmetric(edges).select("node_id", "other_id", F.upper("edge_type").alias("edge_type")).distinct().join(focus.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(other, "other_id")
    score = F.when(F.col("other_type").isin(*node_types), 0.4).otherwise(0.0) + F.when(F.col("edge_type").isin(*edge_types), 0.3).otherwise(0.0)
    if check_properties:
        score = score + F.when(F.coalesce(*(prop(k) for k in ("status", "progress", "state", "phase"))).isNotNull(), 0.5).otherwise(0.0)
    hits = sum((F.contains(F.col("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    score = score + 0.2 * F.least(hits, F.lit(3))
    return near.select(F.col("node_id").alias("focus_id"), F.col("other_id").alias("id"), score.alias("score")).groupBy("focus_id", "id").agg(F.max("score").alias("score")).where("score > 0")
