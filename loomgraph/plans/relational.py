"""Queries over lookups, joins and aggregates, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import lookup as lk
from loomgraph.operators import measures as ms
from loomgraph.operators import relations as rl
from loomgraph.runtime import table

AS_OF = "2025-06-01"
MONTHS = [f"{y}-{m:02d}-01 00:00:00" for y in (2024, 2025) for m in range(1, 13) if (y, m) <= (2025, 6)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, queries: dict = QUERIES, sqls: dict = SQL):
    def add(f):
        queries[name] = f
        if sql:
            sqls[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def seeds(spark: SparkSession, d: str, node_type: str = "PERSON", n: int = 5) -> DataFrame:
    """The live nodes of a type with the smallest ids: the arguments of the lookups below."""
    return lk.live(t(spark, d, "nodes")).where(F.col("node_type") == node_type).orderBy("id").limit(n).select("id")


def all_of(spark: SparkSession, d: str, node_type: str) -> DataFrame:
    """All live nodes of a type."""
    return lk.live(t(spark, d, "nodes")).where(F.col("node_type") == node_type).select("id")


LIVE = "(SELECT * FROM nodes WHERE NOT coalesce(deleted, false))"
EDGE = "(SELECT DISTINCT ON (id) * FROM edges)"
SEEDS = "(SELECT id FROM nodes WHERE NOT coalesce(deleted, false) AND node_type = '{0}' ORDER BY id LIMIT {1})"
ALL = "(SELECT id FROM nodes WHERE NOT coalesce(deleted, false) AND node_type = '{0}')"
SYM = "(SELECT *, source_id AS node_id, target_id AS other_id, 'outgoing' AS direction FROM {0} UNION ALL SELECT *, target_id, source_id, 'incoming' FROM {0})"
DAY = "try_strptime(nullif(regexp_extract({0}, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d')::DATE"
P = "json_extract_string(properties, '$.{0}')"


# --- lookups and filters ---------------------------------------------------------------------------------------------
@query("captures_recent", "SELECT id, modality, created_at FROM captures ORDER BY created_at DESC, id LIMIT 20 OFFSET 10")
def captures_recent(spark, d):
    return t(spark, d, "captures").orderBy(F.desc("created_at"), "id").offset(10).limit(20).select("id", "modality", "created_at")


@query("nodes_all_of", "SELECT id, node_type, title FROM nodes WHERE NOT coalesce(deleted, false) AND node_type IN ('EVENT', 'PROJECT', 'NOTE') AND list_contains(networks, 'ACADEMIC') AND confidence >= 0.5 AND created_at >= TIMESTAMP '2024-01-01'")
def nodes_all_of(spark, d):
    return lk.query_nodes(t(spark, d, "nodes"), lk.NodeFilter(node_types=("EVENT", "PROJECT", "NOTE"), networks=("ACADEMIC",), min_confidence=0.5, created_after="2024-01-01 00:00:00")).select("id", "node_type", "title")


@query("nodes_any_of", "SELECT id, node_type, created_at FROM nodes WHERE NOT coalesce(deleted, false) AND created_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-09-01' AND (list_contains(networks, 'SOCIAL') OR list_contains(networks, 'CLUBS'))")
def nodes_any_of(spark, d):
    return lk.nodes_in_range(t(spark, d, "nodes"), "2024-03-01 00:00:00", "2024-09-01 00:00:00", ("SOCIAL", "CLUBS")).select("id", "node_type", "created_at")


@query("nodes_batch", f"SELECT id, node_type, confidence FROM {LIVE} WHERE id IN {SEEDS.format('PERSON', 5)}")
def nodes_batch(spark, d):
    return lk.nodes_by_ids(t(spark, d, "nodes"), seeds(spark, d)).select("id", "node_type", "confidence")


@query("nodes_by_prefix", f"SELECT id, title FROM {LIVE} WHERE id LIKE 'a1%'")
def nodes_by_prefix(spark, d):
    return lk.live(t(spark, d, "nodes")).where(F.col("id").startswith("a1")).select("id", "title")


@query("nodes_by_capture", f"SELECT source_capture_id, count(*) AS n, count(DISTINCT node_type) AS n_types FROM {LIVE} WHERE source_capture_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def nodes_by_capture(spark, d):
    return lk.live(t(spark, d, "nodes")).where("source_capture_id is not null").groupBy("source_capture_id").agg(F.count("*").alias("n"), F.countDistinct("node_type").alias("n_types")).where("n > 1")


@query("networks_of_captures", f"SELECT DISTINCT source_capture_id, unnest(networks) AS network FROM {LIVE} WHERE source_capture_id IS NOT NULL")
def networks_of_captures(spark, d):
    return lk.live(t(spark, d, "nodes")).where("source_capture_id is not null").select("source_capture_id", F.explode("networks").alias("network")).distinct()


@query("commitments_open", f"SELECT id, title, {P.format('priority')} AS priority, {DAY.format(P.format('due_date'))} AS due FROM {LIVE} WHERE node_type = 'COMMITMENT' AND {P.format('status')} = 'open'")
def commitments_open(spark, d):
    return lk.by_status(t(spark, d, "nodes"), "COMMITMENT", "open").select("id", "title", lk.prop("priority").alias("priority"), lk.iso_day(lk.prop("due_date")).alias("due"))


@query("network_alerts", f"SELECT network, id, due, date_diff('day', due, DATE '{AS_OF}') AS days_overdue FROM (SELECT unnest(networks) AS network, id, {DAY.format(P.format('due_date'))} AS due FROM {LIVE} WHERE node_type = 'COMMITMENT' AND {P.format('status')} = 'open') WHERE due < DATE '{AS_OF}'")
def network_alerts(spark, d):
    due = ms.per_network(lk.by_status(t(spark, d, "nodes"), "COMMITMENT", "open")).select("network", "id", lk.iso_day(lk.prop("due_date")).alias("due"))
    return due.where(F.col("due") < F.to_date(F.lit(AS_OF))).withColumn("days_overdue", F.datediff(F.to_date(F.lit(AS_OF)), "due").cast("long"))


@query("nodes_faded", f"SELECT id, decay_score FROM {LIVE} WHERE decay_score < 0.3 AND id <> '{lk.OWNER}'")
def nodes_faded(spark, d):
    return lk.live(t(spark, d, "nodes")).where((F.col("decay_score") < 0.3) & (F.col("id") != lk.OWNER)).select("id", "decay_score")


@query("review_due", f"SELECT id, review_date FROM {LIVE} WHERE review_date <= TIMESTAMP '{AS_OF}'")
def review_due(spark, d):
    return lk.live(t(spark, d, "nodes")).where(F.col("review_date") <= F.lit(AS_OF).cast("timestamp")).select("id", "review_date")


@query("decisions_unresolved", f"SELECT id FROM {LIVE} WHERE node_type = 'DECISION' AND coalesce({P.format('outcome')}, '') = ''")
def decisions_unresolved(spark, d):
    return lk.live(t(spark, d, "nodes")).where((F.col("node_type") == "DECISION") & (F.coalesce(lk.prop("outcome"), F.lit("")) == "")).select("id")


@query("titles_like", f"SELECT id, title FROM {LIVE} WHERE title ILIKE '%vik%' OR coalesce({P.format('aliases')} ILIKE '%vik%', false)")
def titles_like(spark, d):
    return lk.search_titles(t(spark, d, "nodes"), "vik").select("id", "title")


@query("recently_modified", f"SELECT id, updated_at FROM {LIVE} WHERE updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND updated_at < TIMESTAMP '{AS_OF}'")
def recently_modified(spark, d):
    return lk.live(t(spark, d, "nodes")).where((F.col("updated_at") >= F.expr(f"timestamp'{AS_OF}' - interval 24 hours")) & (F.col("updated_at") < F.lit(AS_OF).cast("timestamp"))).select("id", "updated_at")


@query("effective_dates", f"SELECT id, coalesce({DAY.format(f'''CASE node_type WHEN 'EVENT' THEN {P.format('event_date')} WHEN 'DECISION' THEN {P.format('decision_date')} WHEN 'COMMITMENT' THEN {P.format('due_date')} END''')}, created_at::DATE) AS effective_date FROM {LIVE}")
def effective_dates(spark, d):
    return lk.with_effective_date(lk.live(t(spark, d, "nodes"))).select("id", "effective_date")


@query("edges_of_nodes", f"SELECT DISTINCT id, source_id, target_id FROM edges WHERE source_id IN {SEEDS.format('PERSON', 5)} OR target_id IN {SEEDS.format('PERSON', 5)}")
def edges_of_nodes(spark, d):
    return lk.edges_of(t(spark, d, "edges"), seeds(spark, d)).select("id", "source_id", "target_id")


@query("edges_incoming", f"SELECT DISTINCT id, source_id, target_id FROM edges WHERE target_id IN {SEEDS.format('ORGANIZATION', 5)}")
def edges_incoming(spark, d):
    return lk.edges_of(t(spark, d, "edges"), seeds(spark, d, "ORGANIZATION"), "incoming").select("id", "source_id", "target_id")


@query("edges_both_ways", f"SELECT DISTINCT e.id, e.source_id, e.target_id FROM edges e JOIN (SELECT source_id AS a, target_id AS b FROM edges WHERE bidirectional) p ON (e.source_id = p.a AND e.target_id = p.b) OR (e.source_id = p.b AND e.target_id = p.a)")
def edges_both_ways(spark, d):
    edges = t(spark, d, "edges")
    pairs = edges.where("bidirectional").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return lk.edges_between(edges, pairs).select("id", "source_id", "target_id").distinct()


@query("facts_filtered", "SELECT DISTINCT id, node_id, confidence FROM verified_facts WHERE status = 'active' AND lifecycle = 'dynamic' AND confidence >= 0.7")
def facts_filtered(spark, d):
    return t(spark, d, "verified_facts").where((F.col("status") == "active") & (F.col("lifecycle") == "dynamic") & (F.col("confidence") >= 0.7)).select("id", "node_id", "confidence").distinct()


@query("facts_stale", f"SELECT DISTINCT id, next_check FROM verified_facts WHERE lifecycle = 'dynamic' AND status = 'active' AND next_check <= TIMESTAMP '{AS_OF}'")
def facts_stale(spark, d):
    return t(spark, d, "verified_facts").where((F.col("lifecycle") == "dynamic") & (F.col("status") == "active") & (F.col("next_check") <= F.lit(AS_OF).cast("timestamp"))).select("id", "next_check").distinct()


@query("checks_latest", "SELECT fact_id, arg_max(result, (checked_at, id)) AS result, count(DISTINCT id) AS n_checks FROM fact_checks WHERE checked_at IS NOT NULL GROUP BY fact_id")
def checks_latest(spark, d):
    checks = t(spark, d, "fact_checks").where("checked_at is not null")
    return checks.groupBy("fact_id").agg(F.max_by("result", F.struct("checked_at", "id")).alias("result"), F.countDistinct("id").alias("n_checks"))


@query("sync_latest", "SELECT connector_name, arg_max(items_synced, (created_at, id)) AS items_synced, arg_max(errors, (created_at, id)) AS errors FROM sync_records WHERE created_at IS NOT NULL GROUP BY connector_name")
def sync_latest(spark, d):
    return lk.latest(t(spark, d, "sync_records").where("created_at is not null").select("connector_name", "items_synced", "errors", "created_at", "id"), ["connector_name"], F.struct("created_at", "id")).select("connector_name", "items_synced", "errors")


# --- joins -----------------------------------------------------------------------------------------------------------
@query("unconnected_nodes", f"SELECT n.id, n.node_type FROM {LIVE} n WHERE n.id <> '{lk.OWNER}' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)")
def unconnected_nodes(spark, d):
    return rl.unconnected(t(spark, d, "nodes"), t(spark, d, "edges")).select("id", "node_type")


for _kind in ("GOAL", "PROJECT"):

    @query(f"stalled_{_kind.lower()}s", f"SELECT id, title FROM {LIVE} n WHERE node_type = '{_kind}' AND {P.format('status')} = 'active' AND id NOT IN (SELECT source_id FROM edges WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY AND source_id IS NOT NULL) AND id NOT IN (SELECT target_id FROM edges WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY AND target_id IS NOT NULL)")
    def stalled(spark, d, kind=_kind):
        return rl.stalled(t(spark, d, "nodes"), t(spark, d, "edges"), kind, AS_OF, 200).select("id", "title")


@query("isolated_concepts", f"SELECT c.id FROM {LIVE} c WHERE c.node_type = 'CONCEPT' AND c.id NOT IN (SELECT s.node_id FROM {SYM.format('edges')} s JOIN {LIVE} o ON o.id = s.other_id WHERE o.node_type IN ('EVENT', 'PROJECT', 'COMMITMENT') AND s.node_id IS NOT NULL)")
def isolated_concepts(spark, d):
    return rl.without_neighbour(t(spark, d, "nodes"), t(spark, d, "edges"), "CONCEPT", ("EVENT", "PROJECT", "COMMITMENT")).select("id")


@query("person_edges", f"SELECT s.node_id AS seed_id, s.id AS edge_id, upper(s.edge_type) AS edge_type, s.direction, o.id AS other_id, o.node_type AS other_type FROM {SYM.format(EDGE)} s JOIN {LIVE} o ON o.id = s.other_id WHERE s.node_id IN {ALL.format('PERSON')}")
def person_edges(spark, d):
    return rl.neighbours(all_of(spark, d, "PERSON"), t(spark, d, "edges"), t(spark, d, "nodes")).select("seed_id", "edge_id", "edge_type", "direction", "other_id", "other_type")


@query("temporal_neighbours", f"SELECT s.node_id AS seed_id, s.id AS edge_id, upper(s.edge_type) AS edge_type, s.direction, o.id AS other_id FROM {SYM.format(EDGE)} s JOIN {LIVE} o ON o.id = s.other_id WHERE upper(s.edge_type) IN ('TRIGGERED', 'PRECEDED_BY', 'EVOLVED_INTO') AND s.node_id IN {ALL.format('EVENT')}")
def temporal_neighbours(spark, d):
    return rl.neighbours(all_of(spark, d, "EVENT"), t(spark, d, "edges"), t(spark, d, "nodes"), rl.TEMPORAL_TYPES).select("seed_id", "edge_id", "edge_type", "direction", "other_id")


@query("causes_backward", f"SELECT s.target_id AS seed_id, s.id AS edge_id, o.id AS other_id FROM {EDGE} s JOIN {LIVE} o ON o.id = s.source_id WHERE upper(s.edge_type) = 'TRIGGERED' AND s.target_id IN {ALL.format('EVENT')}")
def causes_backward(spark, d):
    return rl.neighbours(all_of(spark, d, "EVENT"), t(spark, d, "edges"), t(spark, d, "nodes"), ("TRIGGERED",), "incoming").select("seed_id", "edge_id", "other_id")


@query("strongest_ties", f"SELECT e.source_id, e.target_id, max(e.weight) AS weight, max(e.confidence) AS confidence FROM edges e JOIN {LIVE} a ON a.id = e.source_id AND a.node_type = 'PERSON' JOIN {LIVE} b ON b.id = e.target_id AND b.node_type = 'PERSON' GROUP BY 1, 2 ORDER BY weight DESC NULLS LAST, confidence DESC NULLS LAST, source_id, target_id LIMIT 25")
def strongest_ties(spark, d):
    return rl.strongest_ties(t(spark, d, "edges"), t(spark, d, "nodes")).orderBy(F.desc_nulls_last("weight"), F.desc_nulls_last("confidence"), "source_id", "target_id").limit(25).select("source_id", "target_id", "weight", "confidence")


@query("shared_connections", f"WITH s AS (SELECT * FROM {SEEDS.format('PERSON', 2)}) SELECT other_id AS id, count(DISTINCT node_id) AS n_seeds FROM {SYM.format('edges')} WHERE node_id IN (SELECT id FROM s) AND other_id NOT IN (SELECT id FROM s) GROUP BY other_id HAVING count(DISTINCT node_id) = (SELECT count(*) FROM s)")
def shared_connections(spark, d):
    return rl.shared_neighbours(t(spark, d, "edges"), seeds(spark, d, "PERSON", 2))


@query("flywheel_positions", f"WITH near AS (SELECT DISTINCT s.node_id, s.other_id FROM {SYM.format('edges')} s JOIN {LIVE} p ON p.id = s.node_id WHERE p.node_type = 'POSITION' AND s.other_id IS NOT NULL) SELECT x.node_id AS a, y.node_id AS b, count(*) AS n_common FROM near x JOIN near y ON x.other_id = y.other_id AND x.node_id < y.node_id GROUP BY 1, 2")
def flywheel_positions(spark, d):
    return rl.common_neighbour_counts(t(spark, d, "edges"), lk.live(t(spark, d, "nodes")).where("node_type = 'POSITION'").select("id"))


@query("goal_support", f"WITH c AS (SELECT node_id, count(*) AS n FROM {SYM.format(EDGE)} WHERE upper(edge_type) IN ('PART_OF', 'SUBTASK_OF', 'RELATED_TO') GROUP BY 1) SELECT g.id, coalesce(c.n, 0) AS n_support FROM {LIVE} g LEFT JOIN c ON c.node_id = g.id WHERE g.node_type = 'GOAL' AND {P.format('status')} = 'active'")
def goal_support(spark, d):
    return rl.support_counts(t(spark, d, "nodes"), t(spark, d, "edges"), "GOAL", ("PART_OF", "SUBTASK_OF", "RELATED_TO")).select("id", "n_support")


@query("person_commitments", f"SELECT DISTINCT s.node_id AS id, c.id AS commitment_id FROM {SYM.format('edges')} s JOIN {LIVE} p ON p.id = s.node_id AND p.node_type = 'PERSON' JOIN {LIVE} c ON c.id = s.other_id AND c.node_type = 'COMMITMENT' WHERE json_extract_string(c.properties, '$.status') = 'open'")
def person_commitments(spark, d):
    return rl.neighbours_with_due(t(spark, d, "nodes"), t(spark, d, "edges"), "PERSON").where("status = 'open'").select("id", "commitment_id")


@query("merged_edges", f"""WITH m AS (SELECT id AS gone_id, first_value(id) OVER (ORDER BY id) AS kept_id FROM {SEEDS.format('PERSON', 5)}),
moved AS (SELECT e.id, coalesce(a.kept_id, e.source_id) AS source_id, coalesce(b.kept_id, e.target_id) AS target_id, e.edge_type, e.weight, e.created_at FROM {EDGE} e LEFT JOIN m a ON a.gone_id = e.source_id LEFT JOIN m b ON b.gone_id = e.target_id)
SELECT id, source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY weight DESC NULLS LAST, created_at ASC NULLS LAST, id) AS r FROM moved WHERE source_id <> target_id) WHERE r = 1""")
def merged_edges(spark, d):
    five = seeds(spark, d)
    merges = five.select(F.col("id").alias("gone_id")).crossJoin(F.broadcast(five.agg(F.min("id").alias("kept_id"))))
    return rl.merge_entities(lk.distinct_edges(t(spark, d, "edges")), merges).select("id", "source_id", "target_id")


@query("export_edges", f"SELECT e.id, coalesce(nullif(e.confidence, 0), 0.5) AS confidence, coalesce(nullif(e.weight, 0), 1.0) AS weight FROM {EDGE} e WHERE e.source_id IN (SELECT id FROM {LIVE}) AND e.target_id IN (SELECT id FROM {LIVE})")
def export_edges(spark, d):
    ids = lk.live(t(spark, d, "nodes")).select("id")
    e = lk.distinct_edges(t(spark, d, "edges")).join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return e.select("id", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)).alias("confidence"), F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"))


# --- aggregates ------------------------------------------------------------------------------------------------------
@query("graph_stats", f"SELECT 'nodes' AS measure, 'all' AS name, count(*) AS n FROM {LIVE} UNION ALL SELECT 'node_type', node_type, count(*) FROM {LIVE} GROUP BY 2 UNION ALL SELECT 'network', network, count(*) FROM (SELECT unnest(networks) AS network FROM {LIVE}) GROUP BY 2 UNION ALL SELECT 'edge_type', upper(edge_type), count(*) FROM {EDGE} GROUP BY 2")
def graph_stats(spark, d):
    return ms.graph_stats(t(spark, d, "nodes"), t(spark, d, "edges"))


@query("network_type_counts", f"SELECT network, node_type, count(*) AS n FROM (SELECT unnest(networks) AS network, node_type FROM {LIVE}) GROUP BY ALL")
def network_type_counts(spark, d):
    return ms.per_network(lk.live(t(spark, d, "nodes"))).groupBy("network", "node_type").agg(F.count("*").alias("n"))


@query("degrees", "SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, count(*) AS degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) WHERE id IS NOT NULL GROUP BY id")
def degrees(spark, d):
    return ms.degrees(t(spark, d, "edges"))


@query("commitment_stats", f"SELECT network, count(*) AS total, count(*) FILTER (st = 'open') AS n_open, count(*) FILTER (st = 'completed') AS n_completed, count(*) FILTER (st = 'open' AND due < DATE '{AS_OF}') AS n_overdue, round(count(*) FILTER (st = 'completed') / count(*), 6) AS completion_rate FROM (SELECT unnest(networks) AS network, {P.format('status')} AS st, {DAY.format(P.format('due_date'))} AS due FROM {LIVE} WHERE node_type = 'COMMITMENT') GROUP BY network")
def commitment_stats(spark, d):
    return ms.commitment_stats(t(spark, d, "nodes"), AS_OF)


@query("staleness", f"SELECT network, count(*) FILTER (decay_score < 0.3) AS n_stale, count(*) AS n FROM (SELECT unnest(networks) AS network, decay_score FROM {LIVE}) GROUP BY network")
def staleness(spark, d):
    return ms.per_network(lk.live(t(spark, d, "nodes"))).groupBy("network").agg(F.count_if(F.col("decay_score") < 0.3).alias("n_stale"), F.count("*").alias("n"))


_SNAP = ", ".join(f"(TIMESTAMP '{m}')" for m in MONTHS)


@query("network_health", f"""WITH own AS (SELECT unnest(networks) AS network, node_type, created_at, decay_score, {P.format('status')} AS st, {DAY.format(P.format('due_date'))} AS due FROM {LIVE}),
agg AS (SELECT network, snapshot, count(*) FILTER (node_type = 'COMMITMENT') AS nc, count(*) FILTER (node_type = 'COMMITMENT' AND st = 'completed') AS nd, count(*) FILTER (node_type = 'COMMITMENT' AND st = 'open') AS no_, count(*) FILTER (node_type = 'COMMITMENT' AND st = 'open' AND due < snapshot::DATE) AS nl, count(*) FILTER (decay_score < 0.3) AS n_stale, count(*) AS nn
  FROM own JOIN (VALUES {_SNAP}) v(snapshot) ON created_at < snapshot GROUP BY network, snapshot),
r AS (SELECT *, CASE WHEN nc = 0 THEN 1.0 ELSE nd / nc END AS c, CASE WHEN no_ = 0 THEN 0.0 ELSE nl / no_ END AS a, (n_stale > 0.5 * nn)::INT + (nl > 10)::INT AS flags FROM agg),
s AS (SELECT network, snapshot, round(c, 6) AS completion_rate, round(a, 6) AS alert_ratio, n_stale, CASE WHEN c < 0.4 OR a > 0.3 OR flags >= 2 THEN 'falling_behind' WHEN c < 0.7 OR a >= 0.1 THEN 'needs_attention' ELSE 'on_track' END AS status FROM r),
l AS (SELECT *, lag(completion_rate) OVER w AS bc, lag(alert_ratio) OVER w AS ba FROM s WINDOW w AS (PARTITION BY network ORDER BY snapshot))
SELECT network, snapshot, completion_rate, alert_ratio, n_stale, status, CASE WHEN bc IS NULL THEN 'stable' WHEN completion_rate > bc + 0.05 AND alert_ratio < ba THEN 'up' WHEN completion_rate < bc - 0.05 OR alert_ratio > ba + 0.05 THEN 'down' ELSE 'stable' END AS momentum FROM l""")
def network_health(spark, d):
    return ms.network_health(t(spark, d, "nodes"), MONTHS)


@query("health_latest", f"""SELECT network, max(created_at) AS newest, count(*) AS n FROM (SELECT unnest(networks) AS network, created_at FROM {LIVE}) GROUP BY network""")
def health_latest(spark, d):
    return ms.per_network(lk.live(t(spark, d, "nodes"))).groupBy("network").agg(F.max("created_at").alias("newest"), F.count("*").alias("n"))


_PEOPLE = f"(SELECT n.id, n.networks, coalesce(g.degree, 0) AS degree, date_diff('day', n.updated_at::DATE, DATE '{AS_OF}') AS idle_days, CASE WHEN updated_at IS NULL THEN 'unknown' WHEN date_diff('day', n.updated_at::DATE, DATE '{AS_OF}') < 30 THEN 'active' WHEN date_diff('day', n.updated_at::DATE, DATE '{AS_OF}') < 90 THEN 'fading' ELSE 'cold' END AS band FROM {LIVE} n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM {EDGE} UNION ALL SELECT target_id FROM {EDGE}) GROUP BY id) g ON g.id = n.id WHERE n.node_type = 'PERSON' AND n.id <> '{lk.OWNER}')"


@query("people_directory", f"SELECT id, degree, idle_days, band FROM {_PEOPLE}")
def people_directory(spark, d):
    return ms.people_stats(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF).select("id", "degree", F.col("idle_days").cast("long").alias("idle_days"), "band")


@query("people_statistics", f"SELECT band, count(*) AS n, round(avg(degree), 6) AS mean_degree, count(*) FILTER (degree = 0) AS n_disconnected FROM {_PEOPLE} GROUP BY band")
def people_statistics(spark, d):
    return ms.people_stats(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.count_if(F.col("degree") == 0).alias("n_disconnected"))


@query("edge_type_summary", f"SELECT node_id AS id, upper(edge_type) AS edge_type, direction, count(*) AS n FROM {SYM.format(EDGE)} WHERE node_id IN {ALL.format('PERSON')} GROUP BY ALL")
def edge_type_summary(spark, d):
    both = lk.symmetric(lk.distinct_edges(t(spark, d, "edges"))).join(all_of(spark, d, "PERSON").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return both.groupBy(F.col("node_id").alias("id"), F.upper("edge_type").alias("edge_type"), "direction").agg(F.count("*").alias("n"))


@query("position_neighbours", f"SELECT s.node_id AS id, o.node_type AS other_type, count(*) AS n FROM (SELECT DISTINCT node_id, other_id FROM {SYM.format('edges')}) s JOIN {LIVE} p ON p.id = s.node_id AND p.node_type = 'POSITION' JOIN {LIVE} o ON o.id = s.other_id GROUP BY 1, 2")
def position_neighbours(spark, d):
    return ms.neighbour_type_counts(t(spark, d, "nodes"), t(spark, d, "edges"), "POSITION")


@query("grade_rollup", f"SELECT code, round(sum(points * credits) / sum(credits), 6) AS gpa, count(*) AS n FROM (SELECT substr({P.format('code')}, 1, 2) AS code, {P.format('credits')}::DOUBLE AS credits, CASE {P.format('grade')} WHEN 'A+' THEN 4.0 WHEN 'A' THEN 4.0 WHEN 'A-' THEN 3.7 WHEN 'B+' THEN 3.3 WHEN 'B' THEN 3.0 WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'D' THEN 1.0 WHEN 'F' THEN 0.0 END AS points FROM {LIVE} WHERE node_type = 'COURSE') WHERE points IS NOT NULL GROUP BY ROLLUP (code)")
def grade_rollup(spark, d):
    points = F.create_map(*(F.lit(x) for kv in {"A+": 4.0, "A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "D": 1.0, "F": 0.0}.items() for x in kv))
    c = lk.live(t(spark, d, "nodes")).where("node_type = 'COURSE'").select(F.substring(lk.prop("code"), 1, 2).alias("code"), lk.prop("credits").cast("double").alias("credits"), points[lk.prop("grade")].alias("points")).where("points is not null")
    return c.rollup("code").agg(F.round(F.sum(F.col("points") * F.col("credits")) / F.sum("credits"), 6).alias("gpa"), F.count("*").alias("n"))


@query("weekly_digest", f"SELECT node_type, network, count(*) AS n FROM (SELECT node_type, unnest(networks) AS network FROM {LIVE} WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at < TIMESTAMP '{AS_OF}') GROUP BY CUBE (node_type, network)")
def weekly_digest(spark, d):
    week = lk.live(t(spark, d, "nodes")).where((F.col("created_at") >= F.expr(f"timestamp'{AS_OF}' - interval 7 days")) & (F.col("created_at") < F.lit(AS_OF).cast("timestamp")))
    return ms.per_network(week).cube("node_type", "network").agg(F.count("*").alias("n"))


@query("telemetry", f"SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM (SELECT count(*) AS n_nodes FROM {LIVE}), (SELECT count(DISTINCT id) AS n_edges FROM edges)")
def telemetry(spark, d):
    n = lk.live(t(spark, d, "nodes")).agg(F.count("*").alias("n_nodes"))
    e = t(spark, d, "edges").agg(F.countDistinct("id").alias("n_edges"))
    return n.crossJoin(e).withColumn("density", F.round(2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9))


@query("network_pair_bridging", f"""WITH ns AS (SELECT id, unnest(networks) AS network FROM {LIVE}), c AS (SELECT a.network AS x, b.network AS y, count(DISTINCT e.id) AS n FROM {EDGE} e JOIN ns a ON a.id = e.source_id JOIN ns b ON b.id = e.target_id WHERE a.network <> b.network GROUP BY 1, 2) SELECT least(x, y) AS network_a, greatest(x, y) AS network_b, sum(n)::BIGINT AS n_edges FROM c GROUP BY 1, 2""")
def network_pair_bridging(spark, d):
    ns = ms.per_network(lk.live(t(spark, d, "nodes"))).select("id", "network")
    e = lk.distinct_edges(t(spark, d, "edges")).select(F.col("id").alias("edge_id"), "source_id", "target_id")
    c = e.join(ns.select(F.col("id").alias("source_id"), F.col("network").alias("x")), "source_id").join(ns.select(F.col("id").alias("target_id"), F.col("network").alias("y")), "target_id").where("x <> y")
    return c.groupBy("x", "y").agg(F.countDistinct("edge_id").alias("n")).groupBy(F.least("x", "y").alias("network_a"), F.greatest("x", "y").alias("network_b")).agg(F.sum("n").alias("n_edges"))


@query("confidence_bands", f"SELECT node_type, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (decay_score >= 0.7) AS fresh, count(*) FILTER (decay_score < 0.4) AS faded FROM {LIVE} GROUP BY node_type")
def confidence_bands(spark, d):
    c, s = F.col("confidence"), F.col("decay_score")
    return lk.live(t(spark, d, "nodes")).groupBy("node_type").agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.count_if(s >= 0.7).alias("fresh"), F.count_if(s < 0.4).alias("faded"))


@query("top_by_type", f"SELECT node_type, id, access_count FROM (SELECT node_type, id, access_count, row_number() OVER (PARTITION BY node_type ORDER BY access_count DESC NULLS LAST, id) AS r FROM {LIVE}) WHERE r <= 3")
def top_by_type(spark, d):
    w = Window.partitionBy("node_type").orderBy(F.desc_nulls_last("access_count"), "id")
    return lk.live(t(spark, d, "nodes")).withColumn("r", F.row_number().over(w)).where("r <= 3").select("node_type", "id", "access_count")
