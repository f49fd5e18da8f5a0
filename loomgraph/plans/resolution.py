"""Queries over entity resolution, with their oracle SQL: nodes of the second half are proposed to the first half."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import lookup as lk
from loomgraph.operators import resolution as rs
from loomgraph.plans import relational as r
from loomgraph.plans.relational import LIVE, SYM, P, t

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUT = "2024-07-01"


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


def halves(spark, d):
    """(proposed, existing): live people, projects and courses created from CUT on, and all live nodes from before."""
    n = lk.live(t(spark, d, "nodes"))
    cut = F.lit(CUT).cast("timestamp")
    return n.where(F.col("node_type").isin("ORGANIZATION", "PROJECT", "CONCEPT") & (F.col("created_at") >= cut)), n.where(F.col("created_at") < cut)


_NAMES = f"list_filter([title] || CASE WHEN starts_with({P.format('aliases')}, '[') THEN from_json({P.format('aliases')}, '[\"VARCHAR\"]') WHEN {P.format('aliases')} IS NULL THEN [] ELSE [{P.format('aliases')}] END, lambda x: trim(x) <> '')"
_SIM = """CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN wx[1] = wy[1] AND (len(wx) = 1) <> (len(wy) = 1) THEN 0.85 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.7, least(length(x), length(y)) / greatest(length(x), length(y))) ELSE 0.6 * len(list_intersect(list_distinct(wx), list_distinct(wy))) / len(list_distinct(wx || wy)) END"""
_CTE = f"""WITH nw AS MATERIALIZED (SELECT * FROM {LIVE} WHERE node_type IN ('ORGANIZATION', 'PROJECT', 'CONCEPT') AND created_at >= TIMESTAMP '{CUT}'), od AS MATERIALIZED (SELECT * FROM {LIVE} WHERE created_at < TIMESTAMP '{CUT}'),
nn AS (SELECT id, node_type, lower(trim(title)) AS x, regexp_split_to_array(lower(trim(title)), '\\s+') AS wx FROM nw WHERE title IS NOT NULL), oo AS (SELECT DISTINCT id, node_type, lower(trim(name)) AS y, regexp_split_to_array(lower(trim(name)), '\\s+') AS wy FROM (SELECT id, node_type, unnest({_NAMES}) AS name FROM od WHERE id <> '{lk.OWNER}' AND title IS NOT NULL)),
met AS (SELECT DISTINCT n.id AS new_id, o.id AS old_id FROM nn n JOIN oo o ON n.node_type = o.node_type AND n.id <> o.id AND (n.x = o.y OR n.wx[1] = o.wy[1])),
nm AS (SELECT new_id, old_id, max({_SIM}) AS exact_name FROM met JOIN nn n ON n.id = new_id JOIN oo o ON o.id = old_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT DISTINCT node_id, other_id FROM {SYM.format('edges')} WHERE node_id <> other_id),
sh AS (SELECT m.new_id, m.old_id, count(b.other_id) / count(*) AS shared FROM met m JOIN near a ON a.node_id = m.new_id LEFT JOIN near b ON b.node_id = m.old_id AND b.other_id = a.other_id GROUP BY 1, 2),
sg AS (SELECT nm.new_id, nm.old_id, exact_name, coalesce(len(list_intersect(list_distinct(n.networks), list_distinct(o.networks))) / nullif(greatest(len(n.networks), len(o.networks)), 0), 0.0) AS same_network,
  CASE WHEN abs(floor((epoch_us(n.created_at) - epoch_us(o.created_at)) / 86400000000.0)) <= 7 THEN 1 - abs(floor((epoch_us(n.created_at) - epoch_us(o.created_at)) / 86400000000.0)) / 7 ELSE 0.0 END AS temporal_proximity, coalesce(shared, 0.0) AS shared_relationships
  FROM nm JOIN nw n ON n.id = nm.new_id JOIN od o ON o.id = nm.old_id LEFT JOIN sh ON sh.new_id = nm.new_id AND sh.old_id = nm.old_id),
cb AS (SELECT *, CASE WHEN exact_name >= 1 THEN 1.0 ELSE (0.95 * exact_name + 0.15 * same_network + 0.10 * temporal_proximity + 0.20 * shared_relationships) / (0.95 + 0.80 + 0.15 + 0.10 + 0.20) END AS combined FROM sg)"""


@query("resolution_candidates", _CTE + " SELECT new_id, old_id, round(exact_name, 6) AS exact_name FROM nm")
def resolution_candidates(spark, d):
    return rs.candidates(*halves(spark, d)).select("new_id", "old_id", F.round("exact_name", 6).alias("exact_name"))


@query("resolution_signals", _CTE + " SELECT new_id, old_id, round(same_network, 6) AS same_network, round(temporal_proximity, 6) AS temporal_proximity, round(shared_relationships, 6) AS shared_relationships FROM sg")
def resolution_signals(spark, d):
    s = rs.signals(*halves(spark, d), t(spark, d, "edges"))
    return s.select("new_id", "old_id", *(F.round(c, 6).alias(c) for c in ("same_network", "temporal_proximity", "shared_relationships")))


@query("resolution_scores", _CTE + " SELECT new_id, old_id, round(combined, 6) AS combined FROM cb")
def resolution_scores(spark, d):
    return rs.combined(rs.signals(*halves(spark, d), t(spark, d, "edges"))).select("new_id", "old_id", F.round("combined", 6).alias("combined"))


@query("resolution_decisions", _CTE + ", b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(combined, 9) DESC, old_id) AS r FROM cb) SELECT n.id AS new_id, CASE WHEN combined >= 0.4 THEN old_id END AS old_id, CASE WHEN combined >= 0.85 THEN 'merge' WHEN combined >= 0.4 THEN 'defer' ELSE 'create' END AS outcome FROM nw n LEFT JOIN b ON b.new_id = n.id AND r = 1")
def resolution_decisions(spark, d):
    new, old = halves(spark, d)
    return rs.decisions(new, rs.combined(rs.signals(new, old, t(spark, d, "edges")))).select("new_id", "old_id", "outcome")


@query("resolution_vectors", """WITH s AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 50 = 7),
k AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(s, 9) DESC, old_id) AS r FROM s) SELECT new_id, old_id, round(CASE WHEN s >= 0.92 THEN s ELSE s * 0.5 END, 6) AS embedding_similarity FROM k WHERE r <= 5""")
def resolution_vectors(spark, d):
    """The five nearest older vectors of one label, with the signal they give."""
    from loomgraph.operators import vectors as vx

    e = t(spark, d, "embeddings")
    hits = vx.search(e, e.where("vec_id % 50 = 7"), 5, older_of_label=True)
    return hits.select(F.col("query_id").alias("new_id"), F.col("id").alias("old_id"), F.round(rs.embedding_score(F.col("score")), 6).alias("embedding_similarity"))
