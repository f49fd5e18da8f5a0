"""Queries over composite views, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.operators import lookup as lk
from loomgraph.operators import measures as ms
from loomgraph.operators import views as vw
from loomgraph.plans import graphs as gq
from loomgraph.plans import relational as r
from loomgraph.plans.relational import AS_OF, DAY, EDGE, LIVE, SEEDS, SYM, P, seeds, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


@query("entity_profiles", f"""WITH s AS (SELECT id FROM {LIVE} WHERE node_type = 'PROJECT'), l AS (SELECT node_id, count(DISTINCT other_id) AS n_neighbours, count(DISTINCT upper(edge_type)) AS n_edge_types, arg_max(other_id, (coalesce(weight, -1.0), other_id)) AS strongest FROM {SYM.format(EDGE)} WHERE other_id IN (SELECT id FROM {LIVE}) GROUP BY 1),
f AS (SELECT node_id, count(*) AS n_facts, round(avg(confidence), 6) AS fact_confidence FROM (SELECT DISTINCT ON (id) * FROM verified_facts) GROUP BY 1)
SELECT s.id, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(n_edge_types, 0) AS n_edge_types, strongest, coalesce(n_facts, 0) AS n_facts, fact_confidence FROM s LEFT JOIN l ON l.node_id = s.id LEFT JOIN f ON f.node_id = s.id""")
def entity_profiles(spark, d):
    return vw.profile(lk.live(t(spark, d, "nodes")).where("node_type = 'PROJECT'"), t(spark, d, "nodes"), t(spark, d, "edges"), t(spark, d, "verified_facts"))


@query("entity_comparison", f"""WITH e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges WHERE upper(edge_type) = 'KNOWS' AND source_id <> target_id), n AS (SELECT DISTINCT node_id, other_id FROM {SYM.format('edges')} WHERE other_id IS NOT NULL),
m AS (SELECT a, b, other_id, sum(side) AS sides FROM (SELECT a, b, n.other_id, 1 AS side FROM e JOIN n ON n.node_id = e.a UNION ALL SELECT a, b, n.other_id, 2 FROM e JOIN n ON n.node_id = e.b) GROUP BY 1, 2, 3)
SELECT a, b, count(*) FILTER (sides = 3) AS shared, count(*) FILTER (sides = 1) AS only_a, count(*) FILTER (sides = 2) AS only_b FROM m GROUP BY 1, 2""")
def entity_comparison(spark, d):
    e = t(spark, d, "edges")
    pairs = e.where("upper(edge_type) = 'KNOWS' and source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return vw.compare(pairs, e)


@query("unlinked_siblings", f"""WITH o AS (SELECT id, source_capture_id AS c, count(*) OVER (PARTITION BY source_capture_id) AS n FROM {LIVE} WHERE source_capture_id IS NOT NULL), s AS (SELECT * FROM o WHERE n > 1)
SELECT c AS source_capture_id, id FROM s WHERE NOT EXISTS (SELECT 1 FROM {SYM.format('edges')} e JOIN s x ON x.id = e.other_id WHERE e.node_id = s.id AND x.c = s.c AND x.id <> s.id)""")
def unlinked_siblings(spark, d):
    return vw.unlinked_siblings(t(spark, d, "nodes"), t(spark, d, "edges"))


@query("filtered_neighbourhood", f"WITH n AS ({gq.SQL['neighbourhood_2']}) SELECT n.id, hop, node_type FROM n JOIN {LIVE} x ON x.id = n.id WHERE node_type IN ('PERSON', 'EVENT', 'PROJECT') AND (list_contains(networks, 'ACADEMIC') OR list_contains(networks, 'SOCIAL'))")
def filtered_neighbourhood(spark, d):
    reached = g.neighbourhood(t(spark, d, "edges"), seeds(spark, d, "PROJECT", 10), 2)
    return vw.filtered_neighbourhood(reached, t(spark, d, "nodes"), ("PERSON", "EVENT", "PROJECT"), ("ACADEMIC", "SOCIAL"))


@query("hub_scores")
def hub_scores(spark, d):
    nodes, links = t(spark, d, "nodes"), gq.links(spark, d)
    ranks = g.pagerank(nodes, t(spark, d, "edges"), gq.ROUNDS)
    deg = g.degree_centrality(nodes, links)
    between = g.normalised_betweenness(nodes, links, gq.SOURCES)
    return deg.join(ranks, "id").join(between, "id").select("id", F.round(vw.hub_score(F.col("centrality"), F.col("betweenness"), F.col("rank")), 9).alias("score"))


@query("title_changes", f"SELECT id, 'title' AS field, title AS old, json_extract_string(properties, '$.name') AS new FROM {LIVE} WHERE node_type IN ('PERSON', 'ORGANIZATION') AND title IS DISTINCT FROM json_extract_string(properties, '$.name')")
def title_changes(spark, d):
    own = lk.live(t(spark, d, "nodes")).where("node_type in ('PERSON', 'ORGANIZATION')")
    return vw.changed(own.select("id", "title"), own.select("id", lk.prop("name").alias("title")), "id", ["title"])


@query("date_mentions", r"""SELECT id, unnest(list_distinct(regexp_extract_all(lower(raw_content), '\b(today|tomorrow|yesterday|next (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week)|in [0-9]+ days|end of the month)\b', 1))) AS mention FROM captures WHERE raw_content IS NOT NULL""")
def date_mentions(spark, d):
    return t(spark, d, "captures").where("raw_content is not null").select("id", F.explode(vw.date_references(F.col("raw_content"))).alias("mention"))


@query("json_captures", "SELECT id, json_extract_string(raw_content, '$.note') AS note FROM captures WHERE starts_with(trim(raw_content), '{') AND json_valid(raw_content)")
def json_captures(spark, d):
    c = t(spark, d, "captures").where(F.trim("raw_content").startswith("{")).select("id", vw.first_json(F.col("raw_content")).alias("doc")).where("doc is not null")
    return c.select("id", F.get_json_object("doc", "$.note").alias("note"))


@query("upcoming", f"SELECT id, node_type, due FROM (SELECT id, node_type, coalesce({DAY.format(P.format('due_date'))}, {DAY.format(P.format('event_date'))}, {DAY.format(P.format('date'))}, {DAY.format(P.format('target_date'))}) AS due FROM {LIVE} WHERE node_type IN ('COMMITMENT', 'EVENT', 'GOAL', 'ELECTION')) WHERE due <= DATE '{AS_OF}' + 30 AND due >= DATE '{AS_OF}'")
def upcoming(spark, d):
    day = F.to_date(F.lit(AS_OF))
    return vw.dated(t(spark, d, "nodes")).where((F.col("due") >= day) & (F.col("due") <= F.date_add(day, 30))).select("id", "node_type", "due")


@query("edge_sessions", f"WITH e AS (SELECT node_id, id, direction, created_at::DATE AS day FROM {SYM.format(EDGE)} WHERE created_at IS NOT NULL AND node_id IS NOT NULL), f AS (SELECT *, CASE WHEN lag(day) OVER w IS NULL OR date_diff('day', lag(day) OVER w, day) > 30 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY node_id ORDER BY day, id, direction)), x AS (SELECT node_id, sum(fresh) OVER (PARTITION BY node_id ORDER BY day, id, direction) AS run FROM f) SELECT node_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT node_id, run, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1")
def edge_sessions(spark, d):
    return vw.sessions_of_edges(t(spark, d, "edges"), 30)


@query("mutual_connections", f"WITH s AS (SELECT min(id) AS a, max(id) AS b FROM {SEEDS.format('PERSON', 30)}) SELECT DISTINCT x.other_id AS id FROM s, {SYM.format('edges')} x JOIN {SYM.format('edges')} y ON x.other_id = y.other_id WHERE x.node_id = s.a AND y.node_id = s.b AND x.other_id NOT IN (s.a, s.b)")
def mutual_connections(spark, d):
    s = seeds(spark, d, "PERSON", 30)
    two = s.agg(F.min("id").alias("a"), F.max("id").alias("b")).select(F.explode(F.array("a", "b")).alias("id"))
    from loomgraph.operators.relations import shared_neighbours

    return shared_neighbours(t(spark, d, "edges"), two).select("id")


@query("embedding_texts")
def embedding_texts(spark, d):
    return vw.embedding_text(t(spark, d, "nodes"))


@query("review_queue", f"SELECT id, date_diff('day', review_date::DATE, DATE '{AS_OF}') AS days_overdue FROM {LIVE} WHERE review_date <= TIMESTAMP '{AS_OF}' ORDER BY days_overdue DESC, id LIMIT 50")
def review_queue(spark, d):
    days = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("review_date")).cast("long")
    due = lk.live(t(spark, d, "nodes")).where(F.col("review_date") <= F.lit(AS_OF).cast("timestamp"))
    return due.select("id", days.alias("days_overdue")).orderBy(F.desc("days_overdue"), "id").limit(50)


@query("idle_relationships", f"SELECT id, idle_days, CASE WHEN role IN ('supervisor', 'founder') THEN 'close' WHEN role IS NULL THEN 'acquaintance' ELSE 'regular' END AS tier FROM (SELECT id, {P.format('role')} AS role, date_diff('day', updated_at::DATE, DATE '{AS_OF}') AS idle_days FROM {LIVE} WHERE node_type = 'PERSON' AND id <> '{lk.OWNER}') WHERE idle_days > CASE WHEN role IN ('supervisor', 'founder') THEN 7 WHEN role IS NULL THEN 30 ELSE 14 END")
def idle_relationships(spark, d):
    people = ms.people_stats(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF).select("id", F.col("idle_days").cast("long").alias("idle_days"))
    role = t(spark, d, "nodes").select("id", lk.prop("role").alias("role"))
    tier = F.when(F.col("role").isin("supervisor", "founder"), "close").when(F.col("role").isNull(), "acquaintance").otherwise("regular")
    limit = F.when(tier == "close", 7).when(tier == "regular", 14).otherwise(30)
    return people.join(role, "id").select("id", "idle_days", tier.alias("tier"), limit.alias("most")).where("idle_days > most").drop("most")


@query("sync_health", "SELECT connector_name, count(*) AS n, sum(errors)::BIGINT AS errors, sum(items_synced)::BIGINT AS items, round(sum(errors) / nullif(sum(items_synced), 0), 6) AS error_rate FROM (SELECT DISTINCT * FROM sync_records) GROUP BY 1")
def sync_health(spark, d):
    s = t(spark, d, "sync_records").distinct()
    return s.groupBy("connector_name").agg(F.count("*").alias("n"), F.sum("errors").alias("errors"), F.sum("items_synced").alias("items"), F.round(F.try_divide(F.sum("errors"), F.sum("items_synced")), 6).alias("error_rate"))
