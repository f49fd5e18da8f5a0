"""Detectors of behaviour over the graph: each returns (pattern, subject, value, confidence), so they union and store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scores import days_between
from loomgraph.operators import lookup, measures, relations, temporal


def confidence(points: Column, signal: Column) -> Column:
    """At most 0.95: more data points and a stronger signal make it surer."""
    return F.least(F.lit(0.95), 0.25 + 0.30 * F.least(points / 20.0, F.lit(1.0)) + 0.4 * signal)


def _rows(df: DataFrame, pattern: str, subject: Column, value: Column, sure: Column) -> DataFrame:
    return df.select(F.lit(pattern).alias("pattern"), subject.alias("subject"), F.round(value.cast("double"), 6).alias("value"), F.round(sure, 6).alias("confidence"))


def low_completion(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    s = measures.commitment_stats(nodes, as_of).where("total >= 2 and completion_rate < 0.4")
    return _rows(s, "low_completion", F.col("network"), F.col("completion_rate"), confidence(F.col("total"), 1 - F.col("completion_rate")))


def network_concentration(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    by = measures.per_network(lookup.live(nodes)).groupBy("network").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    s = by.crossJoin(F.broadcast(total)).where("n / total > 0.15")
    return _rows(s, "network_concentration", F.col("network"), F.col("n") / F.col("total"), confidence(F.col("n"), F.col("n") / F.col("total")))


def activity_change(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    s = temporal.recent_against_prior(measures.per_network(lookup.live(nodes)), "network", "created_at", as_of, 30).where("prior >= 5")
    ratio = F.col("recent") / F.col("prior")
    return _rows(s.where((ratio < 0.8) | (ratio > 1.25)), "activity_change", F.col("network"), ratio, confidence(F.col("recent") + F.col("prior"), F.least(F.abs(1 - ratio), F.lit(1.0))))


def idle_people(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    s = measures.people_stats(nodes, edges, as_of).where("band <> 'unknown'").agg(F.count("*").alias("n"), F.count_if(F.col("band") == "cold").alias("cold")).where("n >= 5 and cold / n > 0.3")
    return _rows(s, "idle_people", F.lit("PERSON"), F.col("cold") / F.col("n"), confidence(F.col("n"), F.col("cold") / F.col("n")))


def stalled_goals(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    s = relations.stalled(nodes, edges, "GOAL", as_of, 200).agg(F.count("*").alias("n")).where("n > 0")
    return _rows(s, "stalled_goals", F.lit("GOAL"), F.col("n"), confidence(F.col("n"), F.lit(0.5)))


def hubs(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    deg = measures.degrees(lookup.distinct_edges(edges)).select("id", "degree")
    mean = deg.agg(F.avg("degree").alias("mean"))
    s = deg.crossJoin(F.broadcast(mean)).where("degree > 10 * mean")
    return _rows(s, "hub", F.col("id"), F.col("degree") / F.col("mean"), confidence(F.col("degree"), F.lit(1.0)))


def undecided(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    d = lookup.live(nodes).where("node_type = 'DECISION'")
    open_ = F.coalesce(lookup.prop("outcome"), F.lit("")) == ""
    s = d.agg(F.count("*").alias("n"), F.count_if(open_).alias("k")).where("n >= 5 and k / n > 0.5")
    return _rows(s, "undecided", F.lit("DECISION"), F.col("k") / F.col("n"), confidence(F.col("n"), F.col("k") / F.col("n")))


def network_silence(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    last = measures.per_network(lookup.live(nodes).where(F.col("created_at") < F.lit(as_of).cast("timestamp"))).groupBy("network").agg(F.max("created_at").alias("last"), F.count("*").alias("n"))
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last"))
    return _rows(last.where(days >= 1), "network_silence", F.col("network"), F.datediff(F.to_date(F.lit(as_of)), F.to_date("last")), confidence(F.col("n"), F.lit(0.3)))


def networks_turning(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Two networks or more whose momentum has just turned down, or just turned up, against the month before."""
    months = months_before(as_of)
    w = Window.partitionBy("network").orderBy("snapshot")
    h = measures.network_health(nodes, months).withColumn("before", F.lag("momentum").over(w)).where(F.col("snapshot") == F.lit(months[-1]).cast("timestamp_ntz"))
    turned = h.where("before is not null and momentum in ('up', 'down') and momentum <> before").groupBy("momentum").agg(F.count("*").alias("n")).where("n >= 2")
    strength = F.when(F.col("momentum") == "down", 0.8).otherwise(0.7)
    return _rows(turned, "networks_turning", F.col("momentum"), F.col("n"), confidence(F.col("n") * 5, strength))


def months_before(as_of: str) -> list[str]:
    """The first days of the ten months up to ``as_of``."""
    y, m = int(as_of[:4]), int(as_of[5:7])
    return [f"{y + (m - 1 - k) // 12:04d}-{(m - 1 - k) % 12 + 1:02d}-01 00:00:00" for k in range(9, -1, -1)]


def outcome_rates(stats: DataFrame) -> DataFrame:
    """Networks with three outcomes or more of which over half are negative, or over four fifths positive."""
    s = stats.where("total >= 3").withColumns({"bad": F.col("n_negative") / F.col("total"), "good": F.col("n_positive") / F.col("total")})
    bad = _rows(s.where("bad > 0.5"), "outcomes_negative", F.col("network"), F.col("bad"), confidence(F.col("total"), F.col("bad")))
    good = _rows(s.where("bad <= 0.5 and good > 0.8"), "outcomes_positive", F.col("network"), F.col("good"), confidence(F.col("total"), F.col("good")))
    return bad.unionByName(good)


def _old(days: int, as_of: str) -> Column:
    return F.floor(days_between(F.lit(as_of).cast("timestamp"), F.col("created_at"))) >= days


def goal_alignment(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Active goals that nothing supports, that have no milestones, or that stand at 0 after a fortnight."""
    touched = relations.endpoints(edges).distinct().withColumn("touched", F.lit(True))
    g = lookup.live(nodes).where((F.col("node_type") == "GOAL") & (lookup.prop("status") == "active")).join(touched, "id", "left")
    progress = F.coalesce(lookup.prop("progress").try_cast("double"), F.lit(0.0))
    none = F.coalesce(lookup.prop("milestones"), F.lit("[]")) == "[]"
    n = g.agg(F.count("*").alias("n"), F.count_if(F.col("touched").isNull()).alias("lonely"), F.count_if(none).alias("bare"), F.count_if((progress == 0) & _old(14, as_of)).alias("still"))
    parts = [("goals_disconnected", "lonely", F.col("lonely"), F.lit(0.6)), ("goals_without_milestones", "bare", F.col("n"), F.col("bare") / F.col("n")), ("goals_at_zero", "still", F.col("still"), F.lit(0.7))]
    return reduce(DataFrame.unionByName, (_rows(n.where(F.col(c) > 0), name, F.lit("GOAL"), F.col(c), confidence(points, strength)) for name, c, points, strength in parts))


def commitment_scope(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Open commitments without a day, networks where they gather while others have none, networks with two overdue."""
    status, due = F.coalesce(lookup.prop("status"), F.lit("open")), lookup.prop("due_date")
    c = lookup.live(nodes).where("node_type = 'COMMITMENT'")
    n = c.agg(F.count("*").alias("n"), F.count_if((status == "open") & (F.coalesce(due, F.lit("")) == "")).alias("k")).where("k > 0")
    undated = _rows(n, "commitments_undated", F.lit("COMMITMENT"), F.col("k") / F.col("n"), confidence(F.col("n"), F.col("k") / F.col("n")))
    late = (status == "open") & (lookup.iso_day(due) < F.to_date(F.lit(as_of)))
    by = measures.per_network(c).groupBy("network").agg(F.count("*").alias("n"), F.count_if(late).alias("late"))
    overdue = _rows(by.where("late >= 2"), "commitments_overdue", F.col("network"), F.col("late"), confidence(F.col("late"), F.lit(0.8)))
    known = by.agg(F.count("*").alias("n_networks"), F.max("n").alias("top"), F.max_by("network", F.struct("n", "network")).alias("network")).where(f"n_networks >= 2 and n_networks < {len(measures.NETWORKS)} and top >= 3")
    uneven = _rows(known, "commitments_uneven", F.col("network"), F.col("top"), confidence(F.col("top"), F.lit(0.5)))
    return undated.unionByName(overdue).unionByName(uneven)


def idea_maturity(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Ideas that are seeds for thirty days or more, and ideas that stand in one or two networks only."""
    i = lookup.live(nodes).where("node_type = 'IDEA'")
    n = i.agg(F.count("*").alias("n"), F.count_if((F.coalesce(lookup.prop("maturity"), F.lit("seed")) == "seed") & _old(30, as_of)).alias("k"))
    seeds = _rows(n.where("k > 0"), "ideas_at_seed", F.lit("IDEA"), F.col("k"), confidence(F.col("n"), F.col("k") / F.col("n")))
    by = measures.per_network(i).groupBy("network").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_networks"), F.max_by("network", F.struct("n", "network")).alias("network")).crossJoin(F.broadcast(n))
    few = _rows(by.where("n >= 3 and n_networks between 1 and 2"), "ideas_gathered", F.col("network"), F.col("n_networks"), confidence(F.col("n"), F.lit(0.5)))
    return seeds.unionByName(few)


def community_shape(labels: DataFrame) -> DataFrame:
    """Communities (id, label): many of one node, one that holds over three fifths, and how many there are."""
    by = labels.groupBy("label").agg(F.count("*").alias("size"))
    all_ = by.agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.count_if(F.col("size") == 1).alias("single"))
    single = _rows(all_.where("single >= 3"), "communities_single", F.lit("GRAPH"), F.col("single"), confidence(F.col("single"), F.lit(0.4)))
    share = F.col("size") / F.col("n")
    big = _rows(by.crossJoin(F.broadcast(all_)).where((share > 0.6) & (F.col("size") >= 5)), "community_dominant", F.col("label"), share, confidence(F.col("n"), share))
    count = _rows(all_.where("k >= 2"), "communities", F.lit("GRAPH"), F.col("k"), confidence(F.col("n"), F.lit(0.3)))
    return single.unionByName(big).unionByName(count)


def position_health(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Positions with two overdue commitments or more next to them, or with two blockers or more."""
    own = lookup.live(nodes).where("node_type = 'POSITION'")
    c = lookup.live(nodes).where("node_type = 'COMMITMENT'").select(F.col("id").alias("other_id"), (lookup.prop("status") == "overdue").alias("late"))
    near = lookup.symmetric(edges).select("node_id", "other_id").distinct().join(own.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(c, "other_id")
    by = near.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("late").alias("late")).where("late >= 2")
    late = _rows(by, "position_overdue", F.col("id"), F.col("late"), confidence(F.col("n"), F.least(F.lit(1.0), F.col("late") / F.col("n"))))
    stuck = own.select("id", F.size(F.from_json(lookup.prop("blockers"), "array<string>")).alias("k")).where("k >= 2")
    return late.unionByName(_rows(stuck, "position_blocked", F.col("id"), F.col("k"), confidence(F.col("k"), F.lit(0.7))))


def flywheels(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Pairs of positions that share two neighbours or more."""
    p = relations.common_neighbour_counts(edges, lookup.live(nodes).where("node_type = 'POSITION'").select("id")).where("n_common >= 2")
    return _rows(p, "flywheel", F.concat_ws("|", "a", "b"), F.col("n_common"), confidence(F.col("n_common"), F.least(F.lit(1.0), F.col("n_common") / 5)))


def rivalry(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Edges that state competition or opposition."""
    e = lookup.distinct_edges(edges).groupBy(F.upper("edge_type").alias("kind")).agg(F.count("*").alias("n")).where("kind in ('COMPETES_WITH', 'OPPOSES')")
    return _rows(e, "rivalry", F.col("kind"), F.col("n"), confidence(F.col("n"), F.when(F.col("kind") == "OPPOSES", 0.5).otherwise(0.6)))


DETECTORS: dict[str, Callable[[DataFrame, DataFrame, str], DataFrame]] = {
    f.__name__: f for f in (low_completion, network_concentration, activity_change, idle_people, stalled_goals, hubs, undecided, network_silence, networks_turning, goal_alignment, commitment_scope, idea_maturity, position_health, flywheels, rivalry)
}


def detect_all(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(nodes, edges, as_of) for f in DETECTORS.values()))


def reconcile(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored active patterns against the ones found now, keyed by pattern and subject: new, confirmed (with the old
    value as trend) or resolved."""
    old = stored.where("status = 'active'").select("pattern", "subject", F.col("value").alias("old_value"))
    both = found.join(old, ["pattern", "subject"], "full")
    state = F.when(F.col("old_value").isNull(), "new").when(F.col("value").isNull(), "resolved").otherwise("confirmed")
    return both.select("pattern", "subject", state.alias("state"), F.round(F.col("value") - F.col("old_value"), 6).alias("trend"))


