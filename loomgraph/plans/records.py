"""Queries over record tables (outcomes, actions, bridges, proposals, notices, patterns), with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import lookup as lk
from loomgraph.operators import records as rc
from loomgraph.plans import relational as r
from loomgraph.plans.relational import AS_OF, DAY, EDGE, LIVE, SEEDS, P, seeds, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


FACT = "(SELECT DISTINCT ON (id) * FROM verified_facts)"
CHECK = "(SELECT DISTINCT ON (id) * FROM fact_checks)"
OUTCOME = f"""(SELECT c.id, f.node_id, CASE c.result WHEN 'confirmed' THEN 'positive' WHEN 'contradicted' THEN 'negative' WHEN 'stale' THEN 'mixed' ELSE 'neutral' END AS rating, c.evidence AS outcome_text, c.checked_at AS recorded_at
FROM {CHECK} c JOIN {FACT} f ON f.id = c.fact_id WHERE c.checked_at IS NOT NULL AND f.node_id IN (SELECT id FROM nodes WHERE node_type IN ('DECISION', 'GOAL', 'COMMITMENT')))"""
BRIDGE = f"""(SELECT e.id, e.source_id, e.target_id, e.confidence AS similarity, coalesce(e.bidirectional, false) AS validated, e.created_at AS discovered_at, a.networks[1] AS source_network, b.networks[1] AS target_network
FROM {EDGE} e JOIN {LIVE} a ON a.id = e.source_id JOIN {LIVE} b ON b.id = e.target_id WHERE a.networks[1] <> b.networks[1])"""
PROPOSAL = f"""(SELECT source_capture_id AS proposal_id, CASE WHEN bool_and(coalesce(human_approved, false)) THEN 'approved' ELSE 'pending' END AS status, round(avg(confidence), 6) AS confidence, min(created_at) AS created_at, count(*) AS n_nodes, count(*) FILTER (k > 1) AS n_merges
FROM (SELECT *, CASE WHEN title IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY node_type, lower(trim(title)) ORDER BY created_at NULLS FIRST, id) END AS k FROM {LIVE}) WHERE source_capture_id IS NOT NULL GROUP BY 1)"""
NOTICE = f"""(SELECT id, CASE WHEN days < 0 THEN 'overdue' ELSE 'approaching' END AS kind, CASE WHEN days < -30 THEN 'critical' WHEN days < 0 THEN 'high' WHEN days <= 1 THEN 'medium' ELSE 'low' END AS priority, coalesce(human_approved, false) AS read, updated_at AS created_at
FROM (SELECT *, date_diff('day', DATE '{AS_OF}', {DAY.format(P.format('due_date'))}) AS days FROM {LIVE} WHERE node_type = 'COMMITMENT' AND {P.format('status')} = 'open') WHERE days <= 7)"""


def outcomes(spark, d):
    return rc.outcomes_from_checks(t(spark, d, "fact_checks"), t(spark, d, "verified_facts"), t(spark, d, "nodes"))


def bridges(spark, d):
    return rc.bridges_from_edges(t(spark, d, "edges"), t(spark, d, "nodes"))


def proposals(spark, d):
    return rc.proposals_from_nodes(t(spark, d, "nodes"))


def notices(spark, d):
    return rc.notices_from_commitments(t(spark, d, "nodes"), AS_OF)


# --- outcomes ---------------------------------------------------------------------------------------------------------
@query("outcome_stats", f"SELECT network, count(*) AS total, count(*) FILTER (rating = 'positive') AS n_positive, count(*) FILTER (rating = 'negative') AS n_negative, round(avg((rating = 'positive')::INT), 6) AS positive_rate FROM {OUTCOME} o JOIN (SELECT id, unnest(networks) AS network FROM {LIVE}) n ON n.id = o.node_id GROUP BY network")
def outcome_stats(spark, d):
    return rc.outcome_stats(outcomes(spark, d), t(spark, d, "nodes"))


@query("outcomes_of_nodes", f"SELECT node_id, id, rating, row_number() OVER (PARTITION BY node_id ORDER BY recorded_at DESC, id) AS nth FROM {OUTCOME} o")
def outcomes_of_nodes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy(F.desc("recorded_at"), "id")
    return outcomes(spark, d).select("node_id", "id", "rating", F.row_number().over(w).cast("long").alias("nth"))


_PENDING = f"(SELECT id, node_type, title, date_diff('day', created_at::DATE, DATE '{AS_OF}') AS age_days FROM {LIVE} WHERE node_type IN ('DECISION', 'GOAL', 'COMMITMENT') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND id NOT IN (SELECT node_id FROM {OUTCOME} o))"


@query("outcomes_pending", f"SELECT id, age_days FROM {_PENDING} p")
def outcomes_pending(spark, d):
    return rc.pending_outcomes(t(spark, d, "nodes"), outcomes(spark, d), AS_OF).select("id", "age_days")


@query("outcome_prompts", f"SELECT id, age_days, 'What came of the ' || lower(node_type) || ' ''' || coalesce(title, '') || ''', ' || age_days::VARCHAR || ' days old?' AS prompt FROM {_PENDING} p ORDER BY age_days DESC, id LIMIT 10")
def outcome_prompts(spark, d):
    return rc.outcome_prompts(rc.pending_outcomes(t(spark, d, "nodes"), outcomes(spark, d), AS_OF), 10)


@query("outcomes_applied", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT node_id, rating, outcome_text, row_number() OVER (PARTITION BY node_id ORDER BY recorded_at, id) AS k, count(*) OVER (PARTITION BY node_id) AS n FROM {OUTCOME} x),
f AS (SELECT n.id, n.confidence::DOUBLE AS c, 0::BIGINT AS k FROM {LIVE} n WHERE n.id IN (SELECT node_id FROM o) UNION ALL SELECT f.id, CASE o.rating WHEN 'positive' THEN greatest(0.1, least(1.0, f.c + 0.1)) WHEN 'negative' THEN greatest(0.1, least(1.0, f.c - 0.15)) ELSE f.c END, f.k + 1 FROM f JOIN o ON o.node_id = f.id AND o.k = f.k + 1),
g AS (SELECT node_id, max(n) AS n, bool_or(rating = 'positive') AS good, max(CASE WHEN k = n THEN outcome_text END) AS last FROM o GROUP BY 1)
SELECT n.id, round(f.c, 6) AS confidence, CASE WHEN good AND node_type = 'GOAL' AND {P.format('status')} = 'active' THEN 'achieved' WHEN good AND node_type = 'COMMITMENT' AND {P.format('status')} = 'open' THEN 'completed' ELSE {P.format('status')} END AS status, CASE WHEN node_type = 'DECISION' THEN last END AS outcome, g.n AS n_facts
FROM {LIVE} n JOIN g ON g.node_id = n.id JOIN f ON f.id = n.id AND f.k = g.n""")
def outcomes_applied(spark, d):
    return rc.apply_outcomes(t(spark, d, "nodes"), outcomes(spark, d))


@query("outcome_facts", f"SELECT md5('outcome|' || id) AS id, node_id, outcome_text AS statement, CASE rating WHEN 'positive' THEN 0.9 WHEN 'neutral' THEN 0.7 WHEN 'negative' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM {OUTCOME} o")
def outcome_facts(spark, d):
    return rc.outcome_facts(outcomes(spark, d)).select("id", "node_id", "statement", "confidence")


# --- actions: each edge is the record of a link that was made ----------------------------------------------------------
@query("action_history", f"SELECT id, upper(edge_type) AS action_type, created_at AS executed_at FROM {EDGE} ORDER BY created_at DESC NULLS LAST, id LIMIT 50")
def action_history(spark, d):
    return rc.newest(lk.distinct_edges(t(spark, d, "edges")).select("id", F.upper("edge_type").alias("action_type"), F.col("created_at").alias("executed_at")), "executed_at", 50)


@query("actions_of_nodes", f"SELECT node_id, count(*) AS n, max(executed_at) AS last FROM (SELECT DISTINCT id, unnest([source_id, target_id]) AS node_id, created_at AS executed_at FROM {EDGE}) WHERE node_id IN (SELECT id FROM {LIVE} WHERE node_type = 'PROJECT') GROUP BY 1")
def actions_of_nodes(spark, d):
    ends = lk.distinct_edges(t(spark, d, "edges")).select("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"), "created_at")
    own = lk.live(t(spark, d, "nodes")).where("node_type = 'PROJECT'").select(F.col("id").alias("node_id"))
    return ends.join(own, "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))


@query("actions_between", f"SELECT id, created_at AS executed_at FROM {EDGE} WHERE created_at >= TIMESTAMP '2024-03-01' AND created_at <= TIMESTAMP '2024-03-15'")
def actions_between(spark, d):
    at = F.col("created_at")
    return lk.distinct_edges(t(spark, d, "edges")).where((at >= F.lit("2024-03-01").cast("timestamp")) & (at <= F.lit("2024-03-15").cast("timestamp"))).select("id", at.alias("executed_at"))


# --- bridges ----------------------------------------------------------------------------------------------------------
@query("bridges_of_network", f"SELECT id, similarity FROM {BRIDGE} b WHERE validated AND (source_network = 'ACADEMIC' OR target_network = 'ACADEMIC')")
def bridges_of_network(spark, d):
    return rc.bridge_query(bridges(spark, d), "ACADEMIC", True).select("id", "similarity")


@query("bridges_recent", f"SELECT id, discovered_at FROM {BRIDGE} b ORDER BY discovered_at DESC NULLS LAST, id LIMIT 20")
def bridges_recent(spark, d):
    return rc.newest(bridges(spark, d), "discovered_at", 20).select("id", "discovered_at")


@query("bridges_of_nodes", f"SELECT id FROM {BRIDGE} b WHERE source_id IN {SEEDS.format('PROJECT', 20)} OR target_id IN {SEEDS.format('PROJECT', 20)}")
def bridges_of_nodes(spark, d):
    return rc.bridges_of(bridges(spark, d), seeds(spark, d, "PROJECT", 20)).select("id")


@query("bridges_unvalidated", f"SELECT b.id, a.title AS source_title, c.title AS target_title FROM {BRIDGE} b LEFT JOIN nodes a ON a.id = b.source_id LEFT JOIN nodes c ON c.id = b.target_id WHERE NOT validated")
def bridges_unvalidated(spark, d):
    return rc.unvalidated_bridges(bridges(spark, d), t(spark, d, "nodes")).select("id", "source_title", "target_title")


@query("bridges_new", f"SELECT least(source_id, target_id) AS source_id, greatest(source_id, target_id) AS target_id, max(similarity) AS similarity FROM {BRIDGE} b WHERE discovered_at >= TIMESTAMP '2024-07-01' AND NOT EXISTS (SELECT 1 FROM {BRIDGE} o WHERE o.discovered_at < TIMESTAMP '2024-07-01' AND least(o.source_id, o.target_id) = least(b.source_id, b.target_id) AND greatest(o.source_id, o.target_id) = greatest(b.source_id, b.target_id)) GROUP BY 1, 2")
def bridges_new(spark, d):
    b = bridges(spark, d)
    cut = F.lit("2024-07-01").cast("timestamp")
    return rc.new_bridges(b.where(F.col("discovered_at") >= cut), b.where(F.col("discovered_at") < cut))


@query("bridges_judged", f"SELECT validated, meaningful, count(*) AS n FROM (SELECT CASE WHEN similarity >= 0.5 OR validated THEN true ELSE false END AS validated, CASE WHEN similarity >= 0.5 THEN similarity >= 0.7 END AS meaningful FROM {BRIDGE} b) GROUP BY ALL")
def bridges_judged(spark, d):
    b = bridges(spark, d)
    return rc.judge_bridges(b, b.where("similarity >= 0.5").select("id", (F.col("similarity") >= 0.7).alias("meaningful"))).groupBy("validated", "meaningful").agg(F.count("*").alias("n"))


# --- proposals --------------------------------------------------------------------------------------------------------
@query("proposals_pending", f"SELECT proposal_id, created_at, n_nodes FROM {PROPOSAL} p WHERE status = 'pending'")
def proposals_pending(spark, d):
    return proposals(spark, d).where("status = 'pending'").select("proposal_id", "created_at", "n_nodes")


_ROUTE = "CASE WHEN n_merges > 0 THEN 'explicit' WHEN confidence >= 0.85 THEN 'auto' ELSE 'digest' END"


@query("proposals_routed", f"SELECT proposal_id, status, {_ROUTE} AS route FROM {PROPOSAL} p")
def proposals_routed(spark, d):
    return rc.route_proposals(proposals(spark, d)).select("proposal_id", "status", "route")


@query("proposals_page", f"SELECT proposal_id FROM {PROPOSAL} p WHERE status = 'pending' AND {_ROUTE} = 'digest' ORDER BY created_at DESC NULLS LAST, proposal_id LIMIT 20 OFFSET 20")
def proposals_page(spark, d):
    p = rc.route_proposals(proposals(spark, d)).where("status = 'pending' and route = 'digest'")
    return p.orderBy(F.desc_nulls_last("created_at"), "proposal_id").offset(20).limit(20).select("proposal_id")


@query("proposals_by_prefix", f"SELECT proposal_id, status FROM {PROPOSAL} p WHERE proposal_id LIKE 'a%'")
def proposals_by_prefix(spark, d):
    return proposals(spark, d).where(F.col("proposal_id").startswith("a")).select("proposal_id", "status")


@query("proposals_decided", f"SELECT proposal_id, CASE WHEN status = 'pending' AND {_ROUTE} = 'auto' THEN 'approved' ELSE status END AS status, n_nodes::VARCHAR || ' nodes' AS summary FROM {PROPOSAL} p")
def proposals_decided(spark, d):
    """Status and summary as partial updates: what the gate approves, and a text for every proposal."""
    from loomgraph.operators.writes import patch

    p = rc.route_proposals(proposals(spark, d)).withColumn("summary", F.lit(None).cast("string"))
    texts = patch(p, p.select("proposal_id", F.concat(F.col("n_nodes").cast("string"), F.lit(" nodes")).alias("summary")), "proposal_id", ["summary"])
    approved = p.where("status = 'pending' and route = 'auto'").select("proposal_id", F.lit("approved").alias("status"))
    return patch(texts, approved, "proposal_id", ["status"]).select("proposal_id", "status", "summary")


@query("captures_known", f"SELECT id, id IN (SELECT proposal_id FROM {PROPOSAL} p) AS duplicate FROM captures")
def captures_known(spark, d):
    known, stale = rc.new_captures(t(spark, d, "captures").select("id"), proposals(spark, d))
    return known.withColumn("duplicate", F.lit(True)).unionByName(stale.withColumn("duplicate", F.lit(False)))


@query("capture_by_id", "SELECT id, modality, content_hash FROM captures WHERE id IN (SELECT id FROM captures ORDER BY id LIMIT 1)")
def capture_by_id(spark, d):
    c = t(spark, d, "captures")
    return c.join(c.select("id").orderBy("id").limit(1), "id", "left_semi").select("id", "modality", "content_hash")


@query("sent_confidence", "SELECT id, greatest(0.0, least(1.0, coalesce(TRY_CAST(raw AS DOUBLE), 0.8))) AS confidence FROM (SELECT DISTINCT id, json_extract_string(metadata, '$.raw_confidence') AS raw FROM verified_facts) WHERE raw IS NOT NULL")
def sent_confidence(spark, d):
    raw = t(spark, d, "verified_facts").select("id", F.get_json_object("metadata", "$.raw_confidence").alias("raw")).distinct().where("raw is not null")
    return raw.select("id", rc.clamped(F.col("raw")).alias("confidence"))


# --- notices ----------------------------------------------------------------------------------------------------------
@query("notices_unread", f"SELECT id, kind, priority FROM {NOTICE} n WHERE NOT read ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at DESC NULLS LAST, id LIMIT 50")
def notices_unread(spark, d):
    return rc.ranked_notices(notices(spark, d), 50).select("id", "kind", "priority")


@query("notices_kept", f"SELECT id, read OR priority = 'low' AS read FROM {NOTICE} n WHERE NOT coalesce((read OR priority = 'low') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY, false)")
def notices_kept(spark, d):
    n = notices(spark, d)
    return rc.without_old(rc.mark_read(n, n.where("priority = 'low'")), AS_OF).select("id", "read")


@query("notices_all_read", f"SELECT kind, count(*) AS n, true AS read FROM {NOTICE} n GROUP BY kind")
def notices_all_read(spark, d):
    return rc.mark_read(notices(spark, d)).groupBy("kind", "read").agg(F.count("*").alias("n"))


# --- nodes ------------------------------------------------------------------------------------------------------------
@query("nodes_created_at", f"SELECT id, created_at FROM nodes WHERE id IN {SEEDS.format('EVENT', 50)}")
def nodes_created_at(spark, d):
    return lk.nodes_by_ids(t(spark, d, "nodes"), seeds(spark, d, "EVENT", 50)).select("id", "created_at")


@query("raw_properties", f"SELECT id, properties FROM {LIVE} WHERE id IN {SEEDS.format('GOAL', 50)}")
def raw_properties(spark, d):
    return lk.nodes_by_ids(t(spark, d, "nodes"), seeds(spark, d, "GOAL", 50)).select("id", "properties")


@query("owner_present", f"SELECT id, node_type, title FROM nodes WHERE id <> '{lk.OWNER}' UNION ALL SELECT '{lk.OWNER}', 'PERSON', 'You'")
def owner_present(spark, d):
    return rc.with_owner(t(spark, d, "nodes").where(F.col("id") != lk.OWNER))


_KIND = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rc.OWNER_EDGES.items()) + " ELSE 'RELATED_TO' END"


@query("owner_edges_missing", f"SELECT '{lk.OWNER}' AS source_id, id AS target_id, {_KIND} AS edge_type, CASE {_KIND} WHEN 'KNOWS' THEN 'SOCIAL' WHEN 'RELATED_TO' THEN 'ASSOCIATIVE' ELSE 'PERSONAL' END AS edge_category, 0.5::DOUBLE AS weight FROM {LIVE} n WHERE id <> '{lk.OWNER}' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)")
def owner_edges_missing(spark, d):
    """Edges from the owner to the nodes that nothing else touches."""
    from loomgraph.operators.relations import unconnected

    return rc.owner_edges(unconnected(t(spark, d, "nodes"), t(spark, d, "edges"))).select("source_id", "target_id", "edge_type", "edge_category", "weight")


@query("embeddings_kept", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)")
def embeddings_kept(spark, d):
    e = t(spark, d, "embeddings")
    return e.join(e.where("label = 0").select("vec_id"), "vec_id", "left_anti").select("vec_id")


@query("facts_retired", f"SELECT f.id, CASE WHEN c.result = 'contradicted' THEN 'retired' ELSE f.status END AS status FROM {FACT} f LEFT JOIN (SELECT fact_id, arg_max(result, (checked_at, id)) AS result FROM {CHECK} WHERE checked_at IS NOT NULL GROUP BY 1) c ON c.fact_id = f.id")
def facts_retired(spark, d):
    """Facts whose last check contradicts them are retired."""
    from loomgraph.operators.writes import patch

    last = t(spark, d, "fact_checks").where("checked_at is not null").groupBy("fact_id").agg(F.max_by("result", F.struct("checked_at", "id")).alias("result"))
    gone = last.where("result = 'contradicted'").select(F.col("fact_id").alias("id"), F.lit("retired").alias("status"))
    return patch(t(spark, d, "verified_facts").dropDuplicates(["id"]).select("id", "status"), gone, "id", ["status"])


@query("watch_states", "SELECT connector_name, n_syncs, last_items, changed FROM (SELECT connector_name, count(*) AS n_syncs, arg_max(items_synced, (created_at, id)) AS last_items, arg_max(items_synced, (created_at, id)) > 0 AS changed FROM (SELECT DISTINCT * FROM sync_records) WHERE created_at IS NOT NULL GROUP BY 1)")
def watch_states(spark, d):
    """The state of each watched connector: how often it ran, and whether its last run brought anything."""
    s = t(spark, d, "sync_records").distinct().where("created_at is not null")
    last = F.max_by("items_synced", F.struct("created_at", "id"))
    return s.groupBy("connector_name").agg(F.count("*").alias("n_syncs"), last.alias("last_items"), (last > 0).alias("changed"))
