"""Record tables beside the graph: outcomes, actions, bridges, proposals, notices and stored patterns.

Every operator takes such a table as a DataFrame and returns the changed or selected rows; nothing is updated in place. The
last section derives such tables from the graph's own rows, for stores that keep only nodes, edges, facts and checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ontology import EDGE_RULES
from loomgraph.operators.lookup import OWNER, distinct_edges, iso_day, live, prop
from loomgraph.operators.writes import merge_json

# How a rating moves a node's confidence, how sure the fact is that it leaves, and the order of priorities.
CONFIDENCE_DELTA = {"positive": 0.1, "negative": -0.15}
FACT_CONFIDENCE = {"positive": 0.9, "neutral": 0.7, "negative": 0.5, "mixed": 0.6}
PRIORITIES = ("critical", "high", "medium", "low")
OUTCOME_TYPES = ("DECISION", "GOAL", "COMMITMENT")
# The edge by which the owner holds a node that nothing else ties to them.
OWNER_EDGES = {"GOAL": "RESPONSIBLE_FOR", "COMMITMENT": "COMMITTED_TO", "DECISION": "DECIDED", "PROJECT": "RESPONSIBLE_FOR", "EVENT": "RESPONSIBLE_FOR", "PERSON": "KNOWS"}
AUTO_APPROVE = 0.85


def _pick(values: dict[str, float], key: Column, default: float) -> Column:
    return reduce(lambda out, kv: out.when(key == kv[0], kv[1]), list(values.items())[1:], F.when(key == next(iter(values)), next(iter(values.values())))).otherwise(default)


# --- outcomes ---------------------------------------------------------------------------------------------------------
def outcome_stats(outcomes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(network, total, n_positive, n_negative, positive_rate) of the outcomes of live nodes."""
    nets = live(nodes).select(F.col("id").alias("node_id"), F.explode("networks").alias("network"))
    positive = F.col("rating") == "positive"
    return outcomes.join(nets, "node_id").groupBy("network").agg(F.count("*").alias("total"), F.count_if(positive).alias("n_positive"), F.count_if(F.col("rating") == "negative").alias("n_negative"), F.round(F.avg(positive.cast("double")), 6).alias("positive_rate"))


def pending_outcomes(nodes: DataFrame, outcomes: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Live decisions, goals and commitments older than ``days`` days that no outcome tells of, with their age in days."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("created_at"))
    old = live(nodes).where(F.col("node_type").isin(*OUTCOME_TYPES) & (F.col("created_at") < F.expr(f"timestamp'{as_of}' - interval {days} days")))
    return old.join(outcomes.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti").select("id", "node_type", "title", age.cast("long").alias("age_days"))


def outcome_prompts(pending: DataFrame, most: int) -> DataFrame:
    """Questions about the ``most`` oldest pending outcomes."""
    text = F.format_string("What came of the %s '%s', %d days old?", F.lower("node_type"), F.coalesce("title", F.lit("")), F.col("age_days"))
    return pending.orderBy(F.desc("age_days"), "id").limit(most).select("id", "age_days", text.alias("prompt"))


def apply_outcomes(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, confidence, status, outcome, n_facts) after all outcomes of each node, in the order they were recorded.

    A rating moves the confidence within 0.1 to 1; a positive one closes an active goal (achieved) or an open commitment
    (completed); a decision keeps the last text; each outcome leaves a fact.
    """
    per = outcomes.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("recorded_at", "id", "rating", "outcome_text"))).alias("o"))
    own = live(nodes).where(F.col("node_type").isin(*OUTCOME_TYPES)).join(per, "id")
    moved = F.aggregate("o", F.col("confidence"), lambda c, o: F.when(o["rating"].isin(*CONFIDENCE_DELTA), F.greatest(F.lit(0.1), F.least(F.lit(1.0), c + _pick(CONFIDENCE_DELTA, o["rating"], 0.0)))).otherwise(c))
    good, status = F.exists("o", lambda o: o["rating"] == "positive"), prop("status")
    closed = F.when(good & (F.col("node_type") == "GOAL") & (status == "active"), "achieved").when(good & (F.col("node_type") == "COMMITMENT") & (status == "open"), "completed").otherwise(status)
    last = F.when(F.col("node_type") == "DECISION", F.element_at("o", -1)["outcome_text"])
    return own.select("id", F.round(moved, 6).alias("confidence"), closed.alias("status"), last.alias("outcome"), F.size("o").cast("long").alias("n_facts"))


def outcome_facts(outcomes: DataFrame) -> DataFrame:
    """The static facts that outcomes leave: as sure as their rating."""
    return outcomes.select(F.md5(F.concat_ws("|", F.lit("outcome"), "id")).alias("id"), "node_id", F.col("outcome_text").alias("statement"), _pick(FACT_CONFIDENCE, F.col("rating"), 0.7).alias("confidence"), F.lit("static").alias("lifecycle"))


# --- actions and bridges ----------------------------------------------------------------------------------------------
def newest(rows: DataFrame, at: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(at), "id").limit(most)


def bridge_query(bridges: DataFrame, network: str | None = None, validated_only: bool = False) -> DataFrame:
    out = bridges if network is None else bridges.where((F.col("source_network") == network) | (F.col("target_network") == network))
    return out.where("validated") if validated_only else out


def bridges_of(bridges: DataFrame, ids: DataFrame) -> DataFrame:
    """Bridges that touch any of the ids, each once: an equi-join over each bridge seen from both ends."""
    ends = bridges.select("*", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end"))
    return ends.join(ids.select(F.col("id").alias("end")).distinct(), "end", "left_semi").drop("end").dropDuplicates(["id"])


def unvalidated_bridges(bridges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bridges nobody has judged, with the titles of their ends where those are known."""
    title = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("title").alias(f"{end}_title"))
    return bridges.where("not validated").join(title("source"), "source_id", "left").join(title("target"), "target_id", "left")


def new_bridges(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found pairs that are not stored in either direction, each once with its highest similarity."""
    ends = F.array_sort(F.array("source_id", "target_id"))
    best = found.withColumn("ends", ends).groupBy("ends").agg(F.max("similarity").alias("similarity"))
    return best.join(stored.select(ends.alias("ends")).distinct(), "ends", "left_anti").select(F.col("ends")[0].alias("source_id"), F.col("ends")[1].alias("target_id"), "similarity")


def judge_bridges(bridges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Bridges after verdicts (id, meaningful): judged ones count as validated."""
    v = verdicts.select("id", F.col("meaningful").alias("verdict")).dropDuplicates(["id"])
    return bridges.join(v, "id", "left").select(*(F.when(F.col("verdict").isNotNull(), F.lit(True)).otherwise(F.col("validated")).alias("validated") if c == "validated" else F.col(c) for c in bridges.columns), F.col("verdict").alias("meaningful"))


# --- proposals --------------------------------------------------------------------------------------------------------
def route_proposals(proposals: DataFrame) -> DataFrame:
    """The gate: a proposal that merges into or resembles what is there is reviewed, a sure one is approved, others wait
    for the digest. ``proposals`` has n_merges and confidence."""
    route = F.when(F.col("n_merges") > 0, "explicit").when(F.col("confidence") >= AUTO_APPROVE, "auto").otherwise("digest")
    return proposals.withColumn("route", route)


def new_captures(captures: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures that a proposal speaks of: a repeat is a duplicate; captures without one: stale, taken again)."""
    known = proposals.select(F.col("proposal_id").alias("id")).distinct()
    return captures.join(known, "id", "left_semi"), captures.join(known, "id", "left_anti")


def clamped(confidence: Column, default: float = 0.8) -> Column:
    """A confidence as sent: between 0 and 1, the default where it is no number."""
    x = confidence.try_cast("double")
    return F.when(confidence.isNull(), None).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(default)))


# --- notices ----------------------------------------------------------------------------------------------------------
def ranked_notices(notices: DataFrame, most: int, unread_only: bool = True) -> DataFrame:
    """The most urgent notices: by priority, then newest."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    out = notices.where("not read") if unread_only else notices
    return out.orderBy(F.when(rank == 0, len(PRIORITIES) + 1).otherwise(rank), F.desc_nulls_last("created_at"), "id").limit(most)


def mark_read(notices: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Read notices: the given ones, or all."""
    if ids is None:
        return notices.withColumn("read", F.lit(True))
    seen = ids.select("id", F.lit(True).alias("seen")).distinct()
    return notices.join(seen, "id", "left").withColumn("read", F.col("read") | F.coalesce("seen", F.lit(False))).drop("seen").select(*notices.columns)


def without_old(notices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Notices but for read ones older than ``days`` days."""
    old = F.col("read") & (F.col("created_at") < F.expr(f"timestamp'{as_of}' - interval {days} days"))
    return notices.where(~F.coalesce(old, F.lit(False)))


# --- stored patterns --------------------------------------------------------------------------------------------------
def expire_patterns(patterns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Active patterns that nothing confirmed for ``days`` days expire."""
    old = (F.col("status") == "active") & (F.col("last_confirmed") < F.expr(f"timestamp'{as_of}' - interval {days} days"))
    return patterns.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def patterns_of(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, pattern, subject) of the patterns whose evidence, a JSON list of ids, names the node."""
    told = patterns.select("pattern", "subject", F.explode(F.from_json("evidence", "array<string>")).alias("node_id"))
    return told.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").distinct()


# --- tables made from the graph ---------------------------------------------------------------------------------------
def outcomes_from_checks(checks: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checks of facts about decisions, goals and commitments as outcomes of those nodes."""
    rating = F.when(F.col("result") == "confirmed", "positive").when(F.col("result") == "contradicted", "negative").when(F.col("result") == "stale", "mixed").otherwise("neutral")
    of = facts.dropDuplicates(["id"]).select(F.col("id").alias("fact_id"), "node_id")
    own = nodes.where(F.col("node_type").isin(*OUTCOME_TYPES)).select(F.col("id").alias("node_id"))
    c = checks.dropDuplicates(["id"]).where("checked_at is not null")
    return c.join(of, "fact_id").join(own, "node_id", "left_semi").select("id", "node_id", rating.alias("rating"), F.col("evidence").alias("outcome_text"), F.col("checked_at").alias("recorded_at"))


def bridges_from_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between live nodes of different first networks as bridges; links stated both ways count as validated."""
    first = lambda end: live(nodes).select(F.col("id").alias(f"{end}_id"), F.get("networks", F.lit(0)).alias(f"{end}_network"))
    e = distinct_edges(edges).select("id", "source_id", "target_id", F.col("confidence").alias("similarity"), F.coalesce("bidirectional", F.lit(False)).alias("validated"), F.col("created_at").alias("discovered_at"))
    return e.join(first("source"), "source_id").join(first("target"), "target_id").where("source_network <> target_network")


def proposals_from_nodes(nodes: DataFrame) -> DataFrame:
    """The live nodes of each capture as one proposal: approved once all its nodes are, with the number of nodes whose
    title an older live node of the type has already."""
    own = live(nodes).where("source_capture_id is not null")
    w = Window.partitionBy("node_type", F.lower(F.trim("title"))).orderBy("created_at", "id")
    merged = live(nodes).where("title is not null").select("id", (F.row_number().over(w) > 1).alias("merges"))
    return (
        own.join(merged, "id", "left")
        .groupBy(F.col("source_capture_id").alias("proposal_id"))
        .agg(F.when(F.bool_and(F.coalesce("human_approved", F.lit(False))), "approved").otherwise("pending").alias("status"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("created_at").alias("created_at"), F.count("*").alias("n_nodes"), F.count_if("merges").alias("n_merges"))
    )


def notices_from_commitments(nodes: DataFrame, as_of: str) -> DataFrame:
    """A notice for each open commitment that is overdue or due within a week; read once the node is approved."""
    days = F.datediff(iso_day(prop("due_date")), F.to_date(F.lit(as_of)))
    own = live(nodes).where((F.col("node_type") == "COMMITMENT") & (prop("status") == "open")).withColumn("days", days).where("days <= 7")
    priority = F.when(F.col("days") < -30, "critical").when(F.col("days") < 0, "high").when(F.col("days") <= 1, "medium").otherwise("low")
    return own.select("id", F.when(F.col("days") < 0, "overdue").otherwise("approaching").alias("kind"), priority.alias("priority"), F.coalesce("human_approved", F.lit(False)).alias("read"), F.col("updated_at").alias("created_at"))


def with_owner(nodes: DataFrame) -> DataFrame:
    """Nodes with the owner's own node, added where it is missing."""
    have = nodes.select("id", "node_type", "title")
    one = nodes.sparkSession.createDataFrame([(OWNER, "PERSON", "You")], "id string, node_type string, title string")
    return have.unionByName(one.join(have.select("id"), "id", "left_anti"))


def owner_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, edge_category, confidence, weight) that tie nodes (id, node_type) to the owner."""
    m = F.create_map(*(F.lit(x) for kv in OWNER_EDGES.items() for x in kv))
    kind = F.coalesce(F.try_element_at(m, F.col("node_type")), F.lit("RELATED_TO"))
    category = F.create_map(*(F.lit(x) for k in {*OWNER_EDGES.values(), "RELATED_TO"} for x in (k, EDGE_RULES[k][0])))
    return nodes.select(F.lit(OWNER).alias("source_id"), F.col("id").alias("target_id"), kind.alias("edge_type"), category[kind].alias("edge_category"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("weight"))


def patched_properties(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, properties) with the members of each change (id, change: a JSON object) over the stored ones."""
    return nodes.join(changes.select("id", "change"), "id").select("id", merge_json("properties", "change").alias("properties"))
