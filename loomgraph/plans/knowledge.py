"""Queries over rules, retrieval, detectors and writes, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ontology as on
from loomgraph.operators import lookup as lk
from loomgraph.operators import measures as ms
from loomgraph.operators import patterns as pt
from loomgraph.operators import vectors as vx
from loomgraph.operators import writes as wr
from loomgraph.plans import graphs as gq
from loomgraph.plans import records as rq
from loomgraph.plans import relational as r
from loomgraph.plans.relational import AS_OF, EDGE, LIVE, P, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


def _list(x):
    return "NULL::VARCHAR[]" if x is None else "[" + ", ".join(f"'{v}'" for v in x) + "]"


RULES = "(VALUES " + ", ".join(f"('{k}', '{v[0]}', {_list(v[1])}, {_list(v[2])}, {repr(v[3]) if v[3] else 'NULL'})" for k, v in on.EDGE_RULES.items()) + ") r(type, category, sources, targets, cardinality)"


@query("edge_rule_breaks", f"""SELECT broken, edge_type, count(*) AS n FROM (SELECT upper(e.edge_type) AS edge_type, CASE WHEN r.category IS NULL THEN 'unknown_type' WHEN s.node_type IS NULL THEN 'no_source' WHEN x.node_type IS NULL THEN 'no_target' WHEN NOT (r.sources IS NULL OR list_contains(r.sources, s.node_type)) THEN 'source_type' WHEN NOT (r.targets IS NULL OR list_contains(r.targets, x.node_type)) THEN 'target_type' WHEN e.edge_category <> r.category THEN 'category' END AS broken
FROM {EDGE} e LEFT JOIN {RULES} ON r.type = upper(e.edge_type) LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes x ON x.id = e.target_id) WHERE broken IS NOT NULL GROUP BY ALL""")
def edge_rule_breaks(spark, d):
    j = on.judged_edges(lk.distinct_edges(t(spark, d, "edges")), t(spark, d, "nodes").select("id", "node_type"))
    return j.where("broken is not null").groupBy("broken", F.upper("edge_type").alias("edge_type")).agg(F.count("*").alias("n"))


@query("cardinality_breaks", f"SELECT type AS edge_type, id, count(*) AS n FROM (SELECT DISTINCT r.type, CASE WHEN cardinality = 'MANY_TO_ONE' THEN source_id ELSE target_id END AS id, CASE WHEN cardinality = 'MANY_TO_ONE' THEN target_id ELSE source_id END AS partner FROM edges e JOIN {RULES} ON r.type = upper(e.edge_type) WHERE cardinality IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1")
def cardinality_breaks(spark, d):
    return on.cardinality_breaks(t(spark, d, "edges"))


@query("valid_edge_types", f"SELECT s.node_type AS source_type, x.node_type AS target_type, r.type AS edge_type FROM (SELECT DISTINCT node_type FROM nodes) s, (SELECT DISTINCT node_type FROM nodes) x, {RULES} WHERE (r.sources IS NULL OR list_contains(r.sources, s.node_type)) AND (r.targets IS NULL OR list_contains(r.targets, x.node_type))")
def valid_edge_types(spark, d):
    kinds = t(spark, d, "nodes").select("node_type").distinct()
    rules = on.edge_rules(spark)
    a = F.broadcast(rules).join(kinds.select(F.col("node_type").alias("source_type")), F.col("sources").isNull() | F.array_contains("sources", F.col("source_type")))
    return a.join(F.broadcast(kinds.select(F.col("node_type").alias("target_type"))), F.col("targets").isNull() | F.array_contains("targets", F.col("target_type"))).select("source_type", "target_type", "edge_type")


@query("nodes_by_interface", f"SELECT 'SCHEDULABLE' AS interface, id FROM {LIVE} WHERE node_type IN ('EVENT', 'COMMITMENT', 'GOAL') UNION ALL SELECT 'TRACKABLE', id FROM {LIVE} WHERE node_type IN ('COMMITMENT', 'GOAL', 'PROJECT', 'POSITION', 'COURSE')")
def nodes_by_interface(spark, d):
    kinds = {k: [i for i, ts in on.INTERFACES.items() if k in ts] for k in {x for ts in on.INTERFACES.values() for x in ts}}
    names = F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return lk.live(t(spark, d, "nodes")).select("id", F.explode(F.try_element_at(names, F.col("node_type"))).alias("interface"))


@query("value_checks", f"SELECT id, coalesce(regexp_full_match({P.format('currency')}, '[A-Z]{{3}}'), false) AS currency_ok, coalesce(TRY_CAST({P.format('amount')} AS DOUBLE) BETWEEN 0 AND 1, false) AS share_ok FROM {LIVE} WHERE node_type = 'FINANCIAL_ITEM'")
def value_checks(spark, d):
    ok = lambda kind, m: F.coalesce(on.valid_value(kind, lk.prop(m)), F.lit(False))
    return lk.live(t(spark, d, "nodes")).where("node_type = 'FINANCIAL_ITEM'").select("id", ok("CURRENCY_CODE", "currency").alias("currency_ok"), ok("PERCENTAGE", "amount").alias("share_ok"))


# --- retrieval -------------------------------------------------------------------------------------------------------
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query("dense_search", f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS k FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE k <= 10")
def dense_search(spark, d):
    e = t(spark, d, "embeddings")
    return vx.search(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("label_bridges", f"SELECT query_id, id, query_label, label, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label::INT AS query_label, e.label::INT AS label, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS k FROM embeddings q JOIN embeddings e ON e.label <> q.label WHERE q.vec_id % 100 = 0 AND {_COS} >= 0.2) WHERE k <= 20")
def label_bridges(spark, d):
    e = t(spark, d, "embeddings")
    return vx.search(e, e.where("vec_id % 100 = 0"), 20, 0.2, True).select("query_id", "id", "query_label", "label", F.round("score", 6).alias("score"))


SEARCHES = {"budget": ["budget", "invoice", "printing"], "people": ["secretary", "volunteer", "landlord"], "place": ["library", "greenhouse"]}
_Q = "(VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in SEARCHES.items() for w in ws) + ") w(query, term)"


def _searches(spark):
    return spark.createDataFrame([(k, w) for k, ws in SEARCHES.items() for w in ws], "query string, term string")


_BM = f"""words AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0) AS ws FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words), tf AS MATERIALIZED (SELECT doc_id, n_words, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM {_Q}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT w.query, doc_id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / st.mean))) AS score FROM tf JOIN df USING (term) CROSS JOIN st JOIN {_Q} ON w.term = tf.term GROUP BY 1, 2)"""


@query("bm25", f"WITH {_BM} SELECT query, doc_id, round(score, 6) AS score FROM bm")
def bm25(spark, d):
    return vx.bm25(t(spark, d, "documents"), _searches(spark), "doc_id", "text").select("query", "doc_id", F.round("score", 6).alias("score"))


#: Each search stands for a text and a vector: that of the document with this number.
SEARCH_VECTORS = {"budget": 11, "people": 23, "place": 42}
_QV = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in SEARCH_VECTORS.items()) + ") v(query, vec_id)"
_HYBRID = f"""WITH {_BM}, dn AS (SELECT v.query, e.vec_id AS doc_id, {_COS} AS score FROM {_QV} JOIN embeddings q ON q.vec_id = v.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id),
a AS (SELECT query, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS v FROM dn WINDOW w AS (PARTITION BY query)),
b AS (SELECT query, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS v FROM bm WINDOW w AS (PARTITION BY query)),
hy AS (SELECT query, doc_id, 0.5 * coalesce(a.v, 0) + 0.5 * coalesce(b.v, 0) AS score FROM a FULL JOIN b USING (query, doc_id))"""


def _hybrid(spark, d):
    docs, e = t(spark, d, "documents"), t(spark, d, "embeddings")
    names = spark.createDataFrame(list(SEARCH_VECTORS.items()), "query string, query_id long")
    near = vx.search(e, e.where(F.col("vec_id").isin(*SEARCH_VECTORS.values())), 1 << 30).join(F.broadcast(names), "query_id").select("query", F.col("id").alias("doc_id"), "score")
    return vx.fuse(near, vx.bm25(docs, _searches(spark), "doc_id", "text"), ["query", "doc_id"])


@query("hybrid_search", f"{_HYBRID} SELECT query, doc_id, round(score, 6) AS score FROM hy")
def hybrid_search(spark, d):
    """Cosine to the search's vector and BM25 to its words, each scaled to 0..1 and added by halves, for every document."""
    return _hybrid(spark, d).select("query", "doc_id", F.round("score", 6).alias("score"))


@query("hybrid_top", f"{_HYBRID} SELECT query, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS k FROM hy) WHERE k <= 10")
def hybrid_top(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return _hybrid(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 10").select("query", "doc_id")


@query("filtered_search", f"SELECT query_id, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS k FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 AND e.label IN (1, 2)) WHERE k <= 5")
def filtered_search(spark, d):
    """The nearest rows among those of two labels: the filter comes before the search."""
    e = t(spark, d, "embeddings")
    return vx.search(e.where("label in (1, 2)"), e.where("vec_id % 100 = 0"), 5).select("query_id", "id")


_TERMS = ("vik", "grant", "council", "library")


@query("multi_search", "WITH q AS (SELECT unnest(['vik', 'grant', 'council', 'library']) AS term), m AS (SELECT n.id, max(CASE WHEN lower(title) = term THEN 0.5 WHEN starts_with(lower(title), term) THEN 0.4 WHEN starts_with(term, lower(title)) THEN 0.35 ELSE 0.25 END) AS title_score, any_value(confidence) AS c, any_value(decay_score) AS s, any_value(access_count) AS k FROM {LIVE} n JOIN q ON contains(lower(title), term) OR starts_with(term, lower(title)) GROUP BY n.id) SELECT id, round(title_score + 0.25 * coalesce(c, 0) + 0.15 * coalesce(nullif(s, 0), 0.5) + 0.10 * least(coalesce(k, 0) / 100.0, 1.0), 6) AS score FROM m".replace("{LIVE}", LIVE))
def multi_search(spark, d):
    """Several searches at once: each node with its best match and what else speaks for it."""
    terms = spark.createDataFrame([(x,) for x in _TERMS], "term string")
    title = F.lower("title")
    n = lk.live(t(spark, d, "nodes")).where("title is not null").select("id", title.alias("t"), "confidence", "decay_score", "access_count")
    m = n.join(F.broadcast(terms), F.contains("t", "term") | F.startswith("term", "t"))
    hit = F.when(F.col("t") == F.col("term"), 0.5).when(F.startswith("t", "term"), 0.4).when(F.startswith("term", "t"), 0.35).otherwise(0.25)
    best = m.groupBy("id", "confidence", "decay_score", "access_count").agg(F.max(hit).alias("hit"))
    score = F.col("hit") + 0.25 * F.coalesce("confidence", F.lit(0.0)) + 0.15 * F.coalesce(F.nullif("decay_score", F.lit(0.0)), F.lit(0.5)) + 0.10 * F.least(F.coalesce("access_count", F.lit(0)) / 100.0, F.lit(1.0))
    return best.select("id", F.round(score, 6).alias("score"))


@query("retrieval_gate", f"WITH {_BM}, k AS (SELECT query, count(*) AS n, max(score) AS top FROM bm GROUP BY query) SELECT query, n, CASE WHEN n >= 3 AND top >= 0.5 THEN 'sufficient' ELSE 'poor' END AS verdict FROM k")
def retrieval_gate(spark, d):
    s = vx.bm25(t(spark, d, "documents"), _searches(spark), "doc_id", "text").groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return s.select("query", "n", F.when((F.col("n") >= 3) & (F.col("top") >= 0.5), "sufficient").otherwise("poor").alias("verdict"))


# --- detectors -------------------------------------------------------------------------------------------------------
_CONF = "round(least(0.95, 0.25 + 0.30 * least({0} / 20.0, 1.0) + 0.4 * {1}), 6)"
_NETS = f"(SELECT *, unnest(networks) AS network FROM {LIVE})"


@query("pattern_concentration", f"WITH b AS (SELECT network, count(*) AS n FROM {_NETS} GROUP BY 1), s AS (SELECT network, n, n / sum(n) OVER () AS v FROM b) SELECT 'network_concentration' AS pattern, network AS subject, round(v, 6) AS value, {_CONF.format('n', 'v')} AS confidence FROM s WHERE v > 0.15")
def pattern_concentration(spark, d):
    return pt.network_concentration(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_completion", f"WITH s AS ({r.SQL['commitment_stats']}) SELECT 'low_completion' AS pattern, network AS subject, completion_rate AS value, {_CONF.format('total', '(1 - completion_rate)')} AS confidence FROM s WHERE total >= 2 AND completion_rate < 0.4")
def pattern_completion(spark, d):
    return pt.low_completion(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_hubs", f"WITH g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM {EDGE} UNION ALL SELECT target_id FROM {EDGE}) WHERE id IS NOT NULL GROUP BY id), m AS (SELECT avg(degree) AS mean FROM g) SELECT 'hub' AS pattern, id AS subject, round(degree / mean, 6) AS value, {_CONF.format('degree', '1.0')} AS confidence FROM g, m WHERE degree > 10 * mean")
def pattern_hubs(spark, d):
    return pt.hubs(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_silence", f"WITH s AS (SELECT network, max(created_at) AS last, count(*) AS n FROM {_NETS} WHERE created_at < TIMESTAMP '{AS_OF}' GROUP BY 1) SELECT 'network_silence' AS pattern, network AS subject, date_diff('day', last::DATE, DATE '{AS_OF}')::DOUBLE AS value, {_CONF.format('n', '0.3')} AS confidence FROM s WHERE date_diff('day', last::DATE, DATE '{AS_OF}') >= 1")
def pattern_silence(spark, d):
    return pt.network_silence(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


_TURN = r.SQL["network_health"].replace(r._SNAP, ", ".join(f"(TIMESTAMP '{m}')" for m in pt.months_before(AS_OF)))


@query("pattern_turning", f"WITH h AS (SELECT network, momentum, lag(momentum) OVER (PARTITION BY network ORDER BY snapshot) AS before, snapshot FROM ({_TURN})), x AS (SELECT momentum, count(*) AS n FROM h WHERE snapshot = TIMESTAMP '{AS_OF}' AND before IS NOT NULL AND momentum IN ('up', 'down') AND momentum <> before GROUP BY 1 HAVING count(*) >= 2) SELECT 'networks_turning' AS pattern, momentum AS subject, n::DOUBLE AS value, {_CONF.format('n * 5', "CASE momentum WHEN 'down' THEN 0.8 ELSE 0.7 END")} AS confidence FROM x")
def pattern_turning(spark, d):
    return pt.networks_turning(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_outcomes", f"WITH s AS (SELECT *, n_negative / total AS bad, n_positive / total AS good FROM ({rq.SQL['outcome_stats']}) WHERE total >= 3) SELECT 'outcomes_negative' AS pattern, network AS subject, round(bad, 6) AS value, {_CONF.format('total', 'bad')} AS confidence FROM s WHERE bad > 0.5 UNION ALL SELECT 'outcomes_positive', network, round(good, 6), {_CONF.format('total', 'good')} FROM s WHERE bad <= 0.5 AND good > 0.8")
def pattern_outcomes(spark, d):
    from loomgraph.operators.records import outcome_stats

    return pt.outcome_rates(outcome_stats(rq.outcomes(spark, d), t(spark, d, "nodes")))


_AGE = f"floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0)"


@query("pattern_goals", f"WITH g AS (SELECT *, id IN (SELECT source_id FROM edges WHERE source_id IS NOT NULL UNION SELECT target_id FROM edges WHERE target_id IS NOT NULL) AS touched FROM {LIVE} WHERE node_type = 'GOAL' AND {P.format('status')} = 'active'), n AS (SELECT count(*) AS n, count(*) FILTER (NOT touched) AS lonely, count(*) FILTER (coalesce({P.format('milestones')}, '[]') = '[]') AS bare, count(*) FILTER (coalesce(TRY_CAST({P.format('progress')} AS DOUBLE), 0) = 0 AND {_AGE} >= 14) AS still FROM g) SELECT 'goals_disconnected' AS pattern, 'GOAL' AS subject, lonely::DOUBLE AS value, {_CONF.format('lonely', '0.6')} AS confidence FROM n WHERE lonely > 0 UNION ALL SELECT 'goals_without_milestones', 'GOAL', bare::DOUBLE, {_CONF.format('n', '(bare / n)')} FROM n WHERE bare > 0 UNION ALL SELECT 'goals_at_zero', 'GOAL', still::DOUBLE, {_CONF.format('still', '0.7')} FROM n WHERE still > 0")
def pattern_goals(spark, d):
    return pt.goal_alignment(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_scope", f"WITH c AS (SELECT *, coalesce({P.format('status')}, 'open') AS st, {P.format('due_date')} AS due FROM {LIVE} WHERE node_type = 'COMMITMENT'), n AS (SELECT count(*) AS n, count(*) FILTER (st = 'open' AND coalesce(due, '') = '') AS k FROM c), b AS (SELECT network, count(*) AS n, count(*) FILTER (st = 'open' AND {r.DAY.format('due')} < DATE '{AS_OF}') AS late FROM (SELECT *, unnest(networks) AS network FROM c) GROUP BY 1), u AS (SELECT count(*) AS k, max(n) AS top, arg_max(network, (n, network)) AS network FROM b) SELECT 'commitments_undated' AS pattern, 'COMMITMENT' AS subject, round(k / n, 6) AS value, {_CONF.format('n', '(k / n)')} AS confidence FROM n WHERE k > 0 UNION ALL SELECT 'commitments_overdue', network, late::DOUBLE, {_CONF.format('late', '0.8')} FROM b WHERE late >= 2 UNION ALL SELECT 'commitments_uneven', network, top::DOUBLE, {_CONF.format('top', '0.5')} FROM u WHERE k >= 2 AND k < 9 AND top >= 3")
def pattern_scope(spark, d):
    return pt.commitment_scope(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_ideas", f"WITH i AS (SELECT * FROM {LIVE} WHERE node_type = 'IDEA'), n AS (SELECT count(*) AS n, count(*) FILTER (coalesce({P.format('maturity')}, 'seed') = 'seed' AND {_AGE} >= 30) AS k FROM i), b AS (SELECT count(*) AS k, arg_max(network, (m, network)) AS network FROM (SELECT network, count(*) AS m FROM (SELECT unnest(networks) AS network FROM i) GROUP BY 1)) SELECT 'ideas_at_seed' AS pattern, 'IDEA' AS subject, k::DOUBLE AS value, {_CONF.format('n', '(k / n)')} AS confidence FROM n WHERE k > 0 UNION ALL SELECT 'ideas_gathered', network, b.k::DOUBLE, {_CONF.format('n.n', '0.5')} FROM b, n WHERE n.n >= 3 AND b.k BETWEEN 1 AND 2")
def pattern_ideas(spark, d):
    return pt.idea_maturity(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_positions", f"WITH p AS (SELECT * FROM {LIVE} WHERE node_type = 'POSITION'), b AS (SELECT s.node_id AS id, count(*) AS n, count(*) FILTER ({P.format('status')} = 'overdue') AS late FROM (SELECT DISTINCT node_id, other_id FROM {r.SYM.format('edges')}) s JOIN p ON p.id = s.node_id JOIN (SELECT id AS cid, properties AS cp FROM {LIVE} WHERE node_type = 'COMMITMENT') c ON c.cid = s.other_id GROUP BY 1 HAVING count(*) FILTER ({P.format('status')} = 'overdue') >= 2), k AS (SELECT id, json_array_length({P.format('blockers')}) AS k FROM p WHERE {P.format('blockers')} IS NOT NULL) SELECT 'position_overdue' AS pattern, id AS subject, late::DOUBLE AS value, {_CONF.format('n', '(late / n)')} AS confidence FROM b UNION ALL SELECT 'position_blocked', id, k::DOUBLE, {_CONF.format('k', '0.7')} FROM k WHERE k >= 2".replace("FILTER (json_extract_string(properties", "FILTER (json_extract_string(cp"))
def pattern_positions(spark, d):
    return pt.position_health(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_flywheels", f"SELECT 'flywheel' AS pattern, a || '|' || b AS subject, n_common::DOUBLE AS value, {_CONF.format('n_common', 'least(1.0, n_common / 5)')} AS confidence FROM ({r.SQL['flywheel_positions']}) WHERE n_common >= 2")
def pattern_flywheels(spark, d):
    return pt.flywheels(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_rivalry", f"SELECT 'rivalry' AS pattern, upper(edge_type) AS subject, count(*)::DOUBLE AS value, {_CONF.format('count(*)', "CASE upper(edge_type) WHEN 'OPPOSES' THEN 0.5 ELSE 0.6 END")} AS confidence FROM {EDGE} WHERE upper(edge_type) IN ('COMPETES_WITH', 'OPPOSES') GROUP BY upper(edge_type)")
def pattern_rivalry(spark, d):
    return pt.rivalry(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("pattern_communities", f"WITH l AS MATERIALIZED ({gq.SQL['label_communities']}), b AS (SELECT label, count(*) AS size FROM l GROUP BY 1), x AS (SELECT sum(size)::BIGINT AS n, count(*) AS k, count(*) FILTER (size = 1) AS single FROM b) SELECT 'communities_single' AS pattern, 'GRAPH' AS subject, single::DOUBLE AS value, {_CONF.format('single', '0.4')} AS confidence FROM x WHERE single >= 3 UNION ALL SELECT 'community_dominant', label, round(size / n, 6), {_CONF.format('n', '(size / n)')} FROM b, x WHERE size / n > 0.6 AND size >= 5 UNION ALL SELECT 'communities', 'GRAPH', k::DOUBLE, {_CONF.format('n', '0.3')} FROM x WHERE k >= 2")
def pattern_communities(spark, d):
    return pt.community_shape(gq.label_communities(spark, d))


@query("pattern_evidence", f"SELECT id AS node_id, 'ideas_at_seed' AS pattern, network AS subject FROM (SELECT id, unnest(networks) AS network FROM {LIVE} WHERE node_type = 'IDEA' AND coalesce({P.format('maturity')}, 'seed') = 'seed' AND {_AGE} >= 30)")
def pattern_evidence(spark, d):
    """Stored patterns by network with their evidence as a JSON list, and the nodes they name."""
    from loomgraph.operators.records import patterns_of

    ideas = lk.live(t(spark, d, "nodes")).where("node_type = 'IDEA'").where((F.coalesce(lk.prop("maturity"), F.lit("seed")) == "seed") & pt._old(30, AS_OF))
    stored = ms.per_network(ideas).groupBy(F.col("network").alias("subject")).agg(F.to_json(F.collect_list("id")).alias("evidence")).withColumn("pattern", F.lit("ideas_at_seed"))
    return patterns_of(stored, ideas.select("id"))


@query("patterns_expired", f"SELECT network AS subject, CASE WHEN max(created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'expired' ELSE 'active' END AS status FROM {_NETS} WHERE created_at < TIMESTAMP '{AS_OF}' GROUP BY 1")
def patterns_expired(spark, d):
    """A stored pattern for each network, last confirmed by its newest node: 30 days without one expire it."""
    from loomgraph.operators.records import expire_patterns

    n = ms.per_network(lk.live(t(spark, d, "nodes")).where(F.col("created_at") < F.lit(AS_OF).cast("timestamp")))
    stored = n.groupBy(F.col("network").alias("subject")).agg(F.max("created_at").alias("last_confirmed")).withColumn("status", F.lit("active"))
    return expire_patterns(stored, AS_OF).select("subject", "status")


@query("diagnosis", f"SELECT node_type, count(*) AS n, count(*) >= CASE node_type WHEN 'PERSON' THEN 3 WHEN 'COMMITMENT' THEN 2 ELSE 1 END AS enough FROM (SELECT node_type, unnest(networks) AS network FROM {LIVE}) WHERE node_type IN ('COMMITMENT', 'GOAL', 'DECISION', 'IDEA', 'PERSON') GROUP BY 1")
def diagnosis(spark, d):
    """Whether there are enough rows of each kind for the detectors."""
    n = ms.per_network(lk.live(t(spark, d, "nodes"))).where("node_type in ('COMMITMENT', 'GOAL', 'DECISION', 'IDEA', 'PERSON')").groupBy("node_type").agg(F.count("*").alias("n"))
    return n.withColumn("enough", F.col("n") >= F.when(F.col("node_type") == "PERSON", 3).when(F.col("node_type") == "COMMITMENT", 2).otherwise(1))


@query("patterns_all")
def patterns_all(spark, d):
    return pt.detect_all(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("patterns_reconciled")
def patterns_reconciled(spark, d):
    nodes, edges = t(spark, d, "nodes"), t(spark, d, "edges")
    before = pt.detect_all(nodes, edges, "2025-03-01").withColumn("status", F.lit("active"))
    return pt.reconcile(before, pt.detect_all(nodes, edges, AS_OF))


# --- writes ----------------------------------------------------------------------------------------------------------
@query("captures_appended", "WITH old AS (SELECT * FROM captures WHERE created_at < TIMESTAMP '2024-07-01'), new AS (SELECT * FROM captures WHERE created_at >= TIMESTAMP '2024-07-01' OR created_at IS NULL) SELECT id, content_hash FROM old UNION ALL SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS r FROM new) n WHERE (content_hash IS NULL OR r = 1) AND NOT EXISTS (SELECT 1 FROM old WHERE old.content_hash = n.content_hash)")
def captures_appended(spark, d):
    c = t(spark, d, "captures").select("id", "content_hash", "created_at")
    old = F.coalesce(F.col("created_at") < F.lit("2024-07-01").cast("timestamp"), F.lit(False))
    return wr.append_new(c.where(old), c.where(~old), "content_hash").select("id", "content_hash")


@query("nodes_upserted", f"SELECT id, coalesce(decay_score * CASE WHEN access_count > 10 THEN 0.5 ELSE 1 END, decay_score) AS decay_score FROM {LIVE} WHERE updated_at IS NOT NULL")
def nodes_upserted(spark, d):
    n = lk.live(t(spark, d, "nodes")).where("updated_at is not null").select("id", "decay_score", "access_count", "updated_at")
    return wr.upsert(n, n.where("access_count > 10").withColumn("decay_score", F.col("decay_score") * 0.5), ["id"], "updated_at").select("id", "decay_score")


@query("nodes_deleted", f"SELECT count(*) FILTER (gone) AS n_deleted, count(*) AS n FROM (SELECT coalesce(deleted, false) OR node_type = 'IDEA' AS gone FROM nodes)")
def nodes_deleted(spark, d):
    n = t(spark, d, "nodes")
    return wr.soft_delete(n, n.where("node_type = 'IDEA'").select("id")).agg(F.count_if("deleted").alias("n_deleted"), F.count("*").alias("n"))


@query("status_merged", f"SELECT id, 'archived' AS status, {P.format('priority')} AS priority FROM {LIVE} WHERE node_type = 'COMMITMENT'")
def status_merged(spark, d):
    n = lk.live(t(spark, d, "nodes")).where("node_type = 'COMMITMENT'").withColumn("change", F.lit('{"status": "archived"}'))
    return n.withColumn("properties", wr.merge_json("properties", "change")).select("id", lk.prop("status").alias("status"), lk.prop("priority").alias("priority"))


@query("proposals_committed")
def proposals_committed(spark, d):
    """Each capture with two or more nodes, proposed again as one batch with links from its first node."""
    n = lk.live(t(spark, d, "nodes")).where("source_capture_id is not null").select("source_capture_id", F.struct(F.col("id").alias("temp_id"), "node_type", "title", "confidence").alias("n"))
    g = n.groupBy(F.col("source_capture_id").alias("proposal_id")).agg(F.array_sort(F.collect_list("n")).alias("nodes_to_create")).where(F.size("nodes_to_create") >= 2)
    edges = F.transform(F.slice("nodes_to_create", F.lit(2), F.size("nodes_to_create")), lambda x: F.struct(F.get("nodes_to_create", F.lit(0))["temp_id"].alias("source_id"), x["temp_id"].alias("target_id"), F.when(x["node_type"] == "COMMITMENT", "COMMITTED_TO").otherwise("RELATED_TO").alias("edge_type")))
    return wr.commit_proposals(t(spark, d, "nodes"), g.withColumn("edges_to_create", edges))[2]


@query("access_log_folded", f"SELECT id, access_count, last_accessed FROM {LIVE} WHERE access_count > 0")
def access_log_folded(spark, d):
    log = lk.live(t(spark, d, "nodes")).where("access_count > 0").select("id", F.col("last_accessed").alias("accessed_at"), F.explode(F.sequence(F.lit(1), "access_count")).alias("k"))
    return log.groupBy("id").agg(F.count("*").cast("int").alias("access_count"), F.max("accessed_at").alias("last_accessed"))


@query("networks_unlisted", f"SELECT n.network, coalesce(c.n, 0) AS n FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in ms.NETWORKS)}) n(network) LEFT JOIN (SELECT network, count(*) AS n FROM {_NETS} WHERE node_type = 'METRIC' GROUP BY 1) c USING (network)")
def networks_unlisted(spark, d):
    c = ms.per_network(lk.live(t(spark, d, "nodes")).where("node_type = 'METRIC'")).groupBy("network").agg(F.count("*").alias("n"))
    return ms.all_networks(c).select("network", F.coalesce("n", F.lit(0)).alias("n"))
