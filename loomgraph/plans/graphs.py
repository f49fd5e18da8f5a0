"""Queries over graph algorithms, with their oracle SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.operators import lookup as lk
from loomgraph.plans import relational as r
from loomgraph.plans.relational import LIVE, SEEDS, SYM, seeds, t

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROUNDS = 8
SOURCES = 100


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


LINKS = f"(SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, coalesce(max(weight), 1.0) AS weight FROM edges WHERE source_id <> target_id AND source_id IN (SELECT id FROM {LIVE}) AND target_id IN (SELECT id FROM {LIVE}) GROUP BY 1, 2)"
NEAR = f"(SELECT a AS id, b AS nbr, weight FROM {LINKS} UNION ALL SELECT b, a, weight FROM {LINKS})"


def links(spark, d):
    return g.simple_links(t(spark, d, "nodes"), t(spark, d, "edges"))


@query("simple_links", f"SELECT a, b, weight FROM {LINKS}")
def simple_links(spark, d):
    return links(spark, d)


@query("degree_centrality", f"SELECT n.id, coalesce(c.degree, 0) AS degree, round(coalesce(c.degree, 0) / ((SELECT count(*) FROM {LIVE}) - 1), 9) AS centrality FROM {LIVE} n LEFT JOIN (SELECT id, count(*) AS degree FROM {NEAR} GROUP BY id) c USING (id)")
def degree_centrality(spark, d):
    return g.degree_centrality(t(spark, d, "nodes"), links(spark, d))


@query("neighbourhood_2", f"WITH sym AS (SELECT DISTINCT node_id, other_id FROM {SYM.format('edges')} WHERE other_id IS NOT NULL), s AS (SELECT id FROM {SEEDS.format('PROJECT', 10)}), h1 AS (SELECT DISTINCT other_id AS id FROM sym WHERE node_id IN (SELECT id FROM s) AND other_id NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT other_id AS id FROM sym WHERE node_id IN (SELECT id FROM h1) AND other_id NOT IN (SELECT id FROM s) AND other_id NOT IN (SELECT id FROM h1)) SELECT id, 0::INT AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def neighbourhood_2(spark, d):
    return g.neighbourhood(t(spark, d, "edges"), seeds(spark, d, "PROJECT", 10), 2)


@query("shortest_hops", f"""WITH RECURSIVE near AS MATERIALIZED (SELECT id, nbr FROM {NEAR}), s AS (SELECT id FROM {SEEDS.format('PERSON', 1)}),
w AS (SELECT id, 0 AS hops FROM s UNION SELECT near.nbr, w.hops + 1 FROM w JOIN near USING (id) WHERE w.hops < 4) SELECT id, min(hops)::INT AS hops FROM w GROUP BY id""")
def shortest_hops(spark, d):
    return g.shortest_paths(links(spark, d), seeds(spark, d, "PERSON", 1), 4).select("id", "hops")


@query("shortest_paths")
def shortest_paths(spark, d):
    return g.shortest_paths(links(spark, d), seeds(spark, d, "PERSON", 1), 6).select("id", "hops", F.concat_ws(",", "path").alias("path"))


@query("cheapest_costs", f"""WITH RECURSIVE near AS MATERIALIZED (SELECT id, nbr, 1 / greatest(weight, 0.01) AS step FROM {NEAR}), s AS (SELECT id FROM {SEEDS.format('PERSON', 1)}),
w AS (SELECT id, 0.0::DOUBLE AS cost, 0 AS k FROM s UNION ALL SELECT id, min(cost), k + 1 FROM (SELECT near.nbr AS id, w.cost + near.step AS cost, w.k AS k FROM w JOIN near USING (id) UNION ALL SELECT id, cost, k FROM w) WHERE k < 40 GROUP BY id, k) SELECT id, round(min(cost), 6) AS cost FROM w GROUP BY id""")
def cheapest_costs(spark, d):
    return g.cheapest_costs(links(spark, d), seeds(spark, d, "PERSON", 1)).select("id", F.round("cost", 6).alias("cost"))


@query("three_paths")
def three_paths(spark, d):
    two = seeds(spark, d, "GOAL", 2)
    low = two.agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return g.k_paths(links(spark, d), low.select("id"), low.select(F.col("other").alias("id")), 3).select(F.concat_ws(",", "path").alias("path"), "cost")


@query("three_paths_aside")
def three_paths_aside(spark, d):
    """The same paths where the owner is not to be passed."""
    two = seeds(spark, d, "GOAL", 2)
    low = two.agg(F.min("id").alias("id"), F.max("id").alias("other"))
    owner = spark.createDataFrame([(lk.OWNER,)], "id string")
    return g.k_paths(links(spark, d), low.select("id"), low.select(F.col("other").alias("id")), 3, without=owner).select(F.concat_ws(",", "path").alias("path"), "cost")


_FLOW = f"""flow AS MATERIALIZED (SELECT s, x, w / sum(w) OVER (PARTITION BY s) AS share FROM (SELECT s, x, coalesce(max(weight), 1.0) AS w FROM (SELECT source_id AS s, target_id AS x, weight FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges WHERE bidirectional) WHERE s <> x AND s IN (SELECT id FROM {LIVE}) AND x IN (SELECT id FROM {LIVE}) GROUP BY s, x)),
n AS (SELECT count(*) AS n FROM {LIVE}), r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank, id IN (SELECT s FROM flow) AS has_out FROM {LIVE}, n)"""


def _rank_sql(rounds: int) -> str:
    steps = [
        f"r{k} AS MATERIALIZED (SELECT r.id, r.has_out, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank) FILTER (NOT has_out), 0) FROM r{k - 1}) / n) AS rank FROM r{k - 1} r CROSS JOIN n LEFT JOIN (SELECT x AS id, sum(rank * share) AS got FROM flow JOIN r{k - 1} ON r{k - 1}.id = flow.s GROUP BY x) g ON g.id = r.id)"
        for k in range(1, rounds + 1)
    ]
    return f"WITH {_FLOW}, {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _rank_sql(ROUNDS))
def pagerank(spark, d):
    return g.pagerank(t(spark, d, "nodes"), t(spark, d, "edges"), ROUNDS).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_order")
def pagerank_order(spark, d):
    return g.ordinal_rank(g.pagerank(t(spark, d, "nodes"), t(spark, d, "edges"), ROUNDS).select("id", F.round("rank", 9).alias("score")), "score").select("id", "rank")


def _lpa_sql(rounds: int) -> str:
    steps = [f"l{k} AS MATERIALIZED (SELECT id, label FROM (SELECT near.id, l.label, row_number() OVER (PARTITION BY near.id ORDER BY count(*) DESC, l.label) AS r FROM near JOIN l{k - 1} l ON l.id = near.nbr GROUP BY near.id, l.label) WHERE r = 1)" for k in range(1, rounds + 1)]
    return f"WITH near AS MATERIALIZED (SELECT id, nbr FROM {NEAR}), l0 AS (SELECT DISTINCT id, id AS label FROM near), {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query("label_communities", _lpa_sql(5))
def label_communities(spark, d):
    return g.label_propagation(links(spark, d), 5)


@query("connected_components", f"""WITH RECURSIVE near AS MATERIALIZED (SELECT id, nbr FROM {NEAR}), w AS (SELECT id, min(nbr) AS m FROM near GROUP BY id),
l AS (SELECT id, least(id, m) AS label, 0 AS k FROM w UNION ALL SELECT id, min(label), k + 1 FROM (SELECT near.id, l.label, l.k FROM near JOIN l ON l.id = near.nbr UNION ALL SELECT id, label, k FROM l) WHERE k < 25 GROUP BY id, k) SELECT id, min(label) AS label FROM l GROUP BY id""")
def connected_components(spark, d):
    return g.components(links(spark, d)).select("id", "label")


@query("community_profile", f"""WITH {_lpa_sql(5)[5:].rsplit(' SELECT id, label', 1)[0]}, m AS (SELECT l5.label, n.node_type, n.confidence FROM l5 JOIN nodes n ON n.id = l5.id) SELECT label, count(*) AS n, count(DISTINCT node_type) AS n_types, round(avg(confidence), 6) AS mean_confidence FROM m GROUP BY label HAVING count(*) >= 3""")
def community_profile(spark, d):
    labels = g.label_propagation(links(spark, d), 5)
    return labels.join(lk.live(t(spark, d, "nodes")).select("id", "node_type", "confidence"), "id").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("node_type").alias("n_types"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).where("n >= 3")


@query("predicted_links", f"""WITH near AS MATERIALIZED (SELECT id, nbr FROM {NEAR}), deg AS (SELECT id, count(*) AS k FROM near GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS n_common, sum(CASE WHEN m.k > 1 THEN 1 / ln(m.k) END) AS adamic FROM near x JOIN near y ON x.nbr = y.nbr AND x.id < y.id JOIN deg m ON m.id = x.nbr GROUP BY 1, 2)
SELECT p.a, p.b, n_common, round(0.6 * coalesce(adamic, 0) + 0.4 * n_common / greatest(sqrt(da.k::DOUBLE * db.k), 1.0), 6) AS score FROM p JOIN deg da ON da.id = p.a JOIN deg db ON db.id = p.b WHERE NOT EXISTS (SELECT 1 FROM {LINKS} l WHERE l.a = p.a AND l.b = p.b)""")
def predicted_links(spark, d):
    return g.link_scores(links(spark, d))


@query("structural_anomalies", f"""WITH d AS (SELECT n.id, n.confidence, coalesce(c.degree, 0) AS degree FROM {LIVE} n LEFT JOIN (SELECT id, count(*) AS degree FROM {NEAR} GROUP BY id) c USING (id)), m AS (SELECT avg(degree) AS mean FROM d)
SELECT 'orphan' AS kind, id FROM d WHERE degree = 0 UNION ALL SELECT 'isolated', id FROM d, m WHERE confidence >= 0.8 AND degree <= 1 AND degree < 0.3 * mean UNION ALL SELECT 'dense', id FROM d, m WHERE degree >= greatest(3 * mean, 5.0)""")
def structural_anomalies(spark, d):
    return g.structural_anomalies(t(spark, d, "nodes"), links(spark, d))


@query("betweenness")
def betweenness(spark, d):
    """From the reference's number of sources, scaled to all and normalised; exact below that number of nodes."""
    return g.normalised_betweenness(t(spark, d, "nodes"), links(spark, d), SOURCES).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("cut_links")
def cut_links(spark, d):
    return g.cut_links(links(spark, d))


@query("causal_chains", f"""WITH RECURSIVE step AS MATERIALIZED (SELECT DISTINCT source_id AS id, target_id AS nxt FROM edges WHERE upper(edge_type) IN ('TRIGGERED', 'EVOLVED_INTO') AND target_id IS NOT NULL),
c AS (SELECT id AS seed_id, id, 0 AS depth, [id] AS path FROM {LIVE} WHERE node_type = 'DECISION' UNION ALL SELECT c.seed_id, s.nxt, c.depth + 1, list_append(c.path, s.nxt) FROM c JOIN step s ON s.id = c.id WHERE c.depth < 5 AND NOT list_contains(c.path, s.nxt)) SELECT seed_id, id, depth::INT AS depth, array_to_string(path, ',') AS path FROM c WHERE depth > 0""")
def causal_chains(spark, d):
    s = lk.live(t(spark, d, "nodes")).where("node_type = 'DECISION'").select("id")
    return g.chains(t(spark, d, "edges"), s, ("TRIGGERED", "EVOLVED_INTO"), 5).select("seed_id", "id", "depth", F.concat_ws(",", "path").alias("path"))


@query("reach_of_owner", f"""WITH RECURSIVE near AS MATERIALIZED (SELECT id, nbr FROM {NEAR}), w AS (SELECT '{lk.OWNER}' AS id, 0 AS hops UNION SELECT near.nbr, w.hops + 1 FROM w JOIN near USING (id) WHERE w.hops < 4) SELECT hops, count(*) AS n FROM (SELECT id, min(hops)::INT AS hops FROM w GROUP BY id) GROUP BY hops""")
def reach_of_owner(spark, d):
    own = spark.createDataFrame([(lk.OWNER,)], "id string")
    return g.shortest_paths(links(spark, d), own, 4).groupBy("hops").agg(F.count("*").alias("n"))
