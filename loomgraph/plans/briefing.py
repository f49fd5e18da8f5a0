"""Composite reports (gaps, briefing, watch lists, roadmaps, exports) and texts of questions, with their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.operators import lookup as lk
from loomgraph.operators import measures as ms
from loomgraph.operators import records as rc
from loomgraph.plans import compositions as cq
from loomgraph.plans import graphs as gq
from loomgraph.plans import knowledge as kq
from loomgraph.plans import records as rq
from loomgraph.plans import relational as r
from loomgraph.plans.relational import AS_OF, DAY, EDGE, LIVE, P, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


def _part(section: str, df: DataFrame, item: str = "id") -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"))


def _sections(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (_part(k, df, item) for k, (df, item) in parts.items()))


def _union(parts: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS section, {item}::VARCHAR AS item FROM ({sql}) s{n}" for n, (k, (sql, item)) in enumerate(parts.items()))


# --- gaps and briefing ------------------------------------------------------------------------------------------------
_GAPS = {"orphaned": (r.SQL["unconnected_nodes"], "id"), "stalled_goals": (r.SQL["stalled_goals"], "id"), "dead_end_projects": (r.SQL["stalled_projects"], "id"), "isolated_concepts": (r.SQL["isolated_concepts"], "id"), "unresolved_decisions": (r.SQL["decisions_unresolved"], "id")}


def _gaps(spark, d) -> DataFrame:
    names = {"orphaned": "unconnected_nodes", "stalled_goals": "stalled_goals", "dead_end_projects": "stalled_projects", "isolated_concepts": "isolated_concepts", "unresolved_decisions": "decisions_unresolved"}
    return _sections({k: (r.QUERIES[q](spark, d), "id") for k, q in names.items()})


@query("gaps", _union(_GAPS))
def gaps(spark, d):
    """All gaps of the graph in one table."""
    return _gaps(spark, d)


@query("gap_summary", f"SELECT section, count(*) AS n FROM ({_union(_GAPS)}) GROUP BY 1")
def gap_summary(spark, d):
    return _gaps(spark, d).groupBy("section").agg(F.count("*").alias("n"))


_SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"
_WINS = f"SELECT id FROM {LIVE} WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND created_at < TIMESTAMP '{AS_OF}' AND {P.format('status')} IN ('completed', 'achieved', 'done')"


@query("wins", _WINS)
def wins(spark, d):
    """What was created of late and is done already."""
    at = F.col("created_at")
    return lk.live(t(spark, d, "nodes")).where((at >= F.expr(f"timestamp'{AS_OF}' - interval 30 days")) & (at < F.lit(AS_OF).cast("timestamp")) & lk.prop("status").isin("completed", "achieved", "done")).select("id")


_BRIEF = {
    "health": (f"SELECT network FROM ({r.SQL['network_health']}) WHERE snapshot = TIMESTAMP '{AS_OF}' AND status <> 'on_track'", "network"),
    "momentum_up": (f"SELECT network FROM ({r.SQL['network_health']}) WHERE snapshot = TIMESTAMP '{AS_OF}' AND momentum = 'up'", "network"),
    "overdue": (f"SELECT id FROM {rq.NOTICE} n WHERE kind = 'overdue'", "id"),
    "approaching": (f"SELECT id FROM {rq.NOTICE} n WHERE kind = 'approaching'", "id"),
    "decaying_close": (f"SELECT id FROM ({cq.SQL['idle_relationships']}) WHERE tier = 'close'", "id"),
    "stale_facts": (r.SQL["facts_stale"], "id"),
    "new_bridges": (f"SELECT id FROM {rq.BRIDGE} b WHERE discovered_at >= {_SINCE} AND discovered_at < TIMESTAMP '{AS_OF}'", "id"),
    "pending_outcomes": (rq.SQL["outcomes_pending"], "id"),
    "wins": (_WINS, "id"),
    "reviews": (f"SELECT id FROM {LIVE} WHERE review_date <= TIMESTAMP '{AS_OF}'", "id"),
}


def _briefing(spark, d) -> DataFrame:
    now, since = F.lit(AS_OF).cast("timestamp"), F.expr(f"timestamp'{AS_OF}' - interval 24 hours")
    health = ms.network_health(t(spark, d, "nodes"), r.MONTHS).where(F.col("snapshot") == F.lit(AS_OF).cast("timestamp_ntz"))
    notices, at = rq.notices(spark, d), F.col("discovered_at")
    return _sections(
        {
            "health": (health.where("status <> 'on_track'"), "network"),
            "momentum_up": (health.where("momentum = 'up'"), "network"),
            "overdue": (notices.where("kind = 'overdue'"), "id"),
            "approaching": (notices.where("kind = 'approaching'"), "id"),
            "decaying_close": (cq.idle_relationships(spark, d).where("tier = 'close'"), "id"),
            "stale_facts": (r.facts_stale(spark, d), "id"),
            "new_bridges": (rq.bridges(spark, d).where((at >= since) & (at < now)), "id"),
            "pending_outcomes": (rq.outcomes_pending(spark, d), "id"),
            "wins": (wins(spark, d), "id"),
            "reviews": (lk.live(t(spark, d, "nodes")).where(F.col("review_date") <= now), "id"),
        }
    )


@query("briefing", _union(_BRIEF))
def briefing(spark, d):
    """The daily briefing as rows of section and item."""
    return _briefing(spark, d)


@query("briefing_summary", f"SELECT section, count(*) AS n FROM ({_union(_BRIEF)}) GROUP BY 1")
def briefing_summary(spark, d):
    return _briefing(spark, d).groupBy("section").agg(F.count("*").alias("n"))


@query("urgent", _union({k: _BRIEF[k] for k in ("overdue", "decaying_close", "stale_facts")}))
def urgent(spark, d):
    return _briefing(spark, d).where(F.col("section").isin("overdue", "decaying_close", "stale_facts"))


@query("last_briefing", f"SELECT max(created_at) AS last FROM {rq.NOTICE} n WHERE NOT read")
def last_briefing(spark, d):
    return rq.notices(spark, d).where("not read").agg(F.max("created_at").alias("last"))


@query("pattern_warnings", f"SELECT pattern, subject FROM (SELECT * FROM ({kq.SQL['pattern_completion']}) a UNION ALL SELECT * FROM ({kq.SQL['pattern_scope']}) b) WHERE confidence >= 0.5 ORDER BY confidence DESC, pattern, subject LIMIT 5")
def pattern_warnings(spark, d):
    """The surest warnings among the detected patterns."""
    p = kq.pattern_completion(spark, d).unionByName(kq.pattern_scope(spark, d)).where("confidence >= 0.5")
    return p.orderBy(F.desc("confidence"), "pattern", "subject").limit(5).select("pattern", "subject")


@query("commitments_of_capture_due", f"SELECT id, source_capture_id FROM (SELECT id, source_capture_id, created_at, date_diff('day', created_at::DATE, {DAY.format(P.format('due_date'))}) AS days FROM {LIVE} WHERE node_type = 'COMMITMENT' AND source_capture_id IS NOT NULL) WHERE days BETWEEN 0 AND 7")
def commitments_of_capture_due(spark, d):
    """Commitments that fall due within a week of the capture they came with."""
    days = F.datediff(lk.iso_day(lk.prop("due_date")), F.to_date("created_at"))
    return lk.live(t(spark, d, "nodes")).where("node_type = 'COMMITMENT' and source_capture_id is not null").where(days.between(0, 7)).select("id", "source_capture_id")


# --- domain views -----------------------------------------------------------------------------------------------------
@query("course_roadmap", f"SELECT c.id, {P.format('code')} AS code, coalesce(nullif({P.format('status')}, ''), 'planned') AS status, count(DISTINCT e.target_id) AS n_next FROM {LIVE} c LEFT JOIN edges e ON e.source_id = c.id AND upper(e.edge_type) = 'PREREQUISITE_OF' WHERE c.node_type = 'COURSE' GROUP BY ALL".replace("json_extract_string(properties", "json_extract_string(c.properties"))
def course_roadmap(spark, d):
    """Courses with what they open."""
    nxt = t(spark, d, "edges").where("upper(edge_type) = 'PREREQUISITE_OF'").groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("n_next"))
    c = lk.live(t(spark, d, "nodes")).where("node_type = 'COURSE'").select("id", lk.prop("code").alias("code"), F.coalesce(F.nullif(lk.prop("status"), F.lit("")), F.lit("planned")).alias("status"))
    return c.join(nxt, "id", "left").select("id", "code", "status", F.coalesce("n_next", F.lit(0)).alias("n_next"))


@query("elections", f"SELECT x.id, count(DISTINCT CASE WHEN upper(e.edge_type) = 'CANDIDATE_IN' THEN s.id END) AS n_candidates, count(DISTINCT CASE WHEN upper(e.edge_type) = 'ENDORSES' THEN s.id END) AS n_endorsements, count(DISTINCT s.id) AS n_sources FROM {LIVE} x LEFT JOIN edges e ON e.target_id = x.id LEFT JOIN {LIVE} s ON s.id = e.source_id WHERE x.node_type = 'ELECTION' GROUP BY x.id")
def elections(spark, d):
    """Elections with the candidates and endorsements that point to them."""
    n = lk.live(t(spark, d, "nodes"))
    e = t(spark, d, "edges").select(F.col("target_id").alias("id"), "source_id", F.upper("edge_type").alias("kind")).join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    by = e.groupBy("id").agg(F.countDistinct(F.when(F.col("kind") == "CANDIDATE_IN", F.col("source_id"))).alias("n_candidates"), F.countDistinct(F.when(F.col("kind") == "ENDORSES", F.col("source_id"))).alias("n_endorsements"), F.countDistinct("source_id").alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.where("node_type = 'ELECTION'").select("id").join(by, "id", "left").select("id", zero("n_candidates"), zero("n_endorsements"), zero("n_sources"))


@query("endorsement_graph", f"SELECT DISTINCT e.target_id AS election_id, s.id, s.node_type, upper(e.edge_type) AS edge_type FROM edges e JOIN {LIVE} x ON x.id = e.target_id AND x.node_type = 'ELECTION' JOIN {LIVE} s ON s.id = e.source_id")
def endorsement_graph(spark, d):
    n = lk.live(t(spark, d, "nodes"))
    e = t(spark, d, "edges").select(F.col("target_id").alias("election_id"), F.col("source_id").alias("id"), F.upper("edge_type").alias("edge_type")).distinct()
    return e.join(n.where("node_type = 'ELECTION'").select(F.col("id").alias("election_id")), "election_id", "left_semi").join(n.select("id", "node_type"), "id").select("election_id", "id", "node_type", "edge_type")


@query("visual_nodes", f"SELECT id, CASE WHEN coalesce(title, '') = '' THEN node_type ELSE substr(title, 1, 30) END AS label, CASE WHEN id = '{lk.OWNER}' THEN 45 ELSE greatest(14, floor(coalesce(nullif(decay_score, 0), 0.5) * 30 + 10)::BIGINT) END AS size FROM {LIVE}")
def visual_nodes(spark, d):
    """Nodes as a drawing needs them: label and size."""
    label = F.when(F.coalesce("title", F.lit("")) == "", F.col("node_type")).otherwise(F.substring("title", 1, 30))
    size = F.when(F.col("id") == lk.OWNER, F.lit(45).cast("long")).otherwise(F.greatest(F.lit(14).cast("long"), F.floor(F.coalesce(F.nullif("decay_score", F.lit(0.0)), F.lit(0.5)) * 30 + 10)))
    return lk.live(t(spark, d, "nodes")).select("id", label.alias("label"), size.alias("size"))


_SAY = {"KNOWS": "knows", "PART_OF": "is part of", "CONTAINS": "contains", "SUBTASK_OF": "is a subtask of", "MEMBER_OF": "is a member of", "COMMITTED_TO": "is committed to", "RESPONSIBLE_FOR": "is responsible for", "DECIDED": "decided", "TRIGGERED": "triggered", "PRECEDED_BY": "came after", "DERIVED_FROM": "comes from", "REPORTS_TO": "reports to"}


@query("edge_sentences", f"SELECT e.id, coalesce(a.title, a.node_type) || ' ' || CASE upper(e.edge_type) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in _SAY.items())} ELSE lower(replace(e.edge_type, '_', ' ')) END || ' ' || coalesce(b.title, b.node_type) AS sentence FROM {EDGE} e JOIN {LIVE} a ON a.id = e.source_id JOIN {LIVE} b ON b.id = e.target_id")
def edge_sentences(spark, d):
    """Each edge as a sentence; types without a phrase of their own are read out."""
    phrases = F.create_map(*(F.lit(x) for kv in _SAY.items() for x in kv))
    end = lambda s: lk.live(t(spark, d, "nodes")).select(F.col("id").alias(f"{s}_id"), F.coalesce("title", "node_type").alias(s))
    say = F.coalesce(F.try_element_at(phrases, F.upper("edge_type")), F.lower(F.regexp_replace("edge_type", "_", " ")))
    e = lk.distinct_edges(t(spark, d, "edges")).select("id", "source_id", "target_id", "edge_type")
    return e.join(end("source"), "source_id").join(end("target"), "target_id").select("id", F.concat("source", F.lit(" "), say, F.lit(" "), "target").alias("sentence"))


@query("graph_summary", f"SELECT 'degree' AS measure, id AS name, rank FROM (SELECT id, row_number() OVER (ORDER BY centrality DESC, id) AS rank FROM ({gq.SQL['degree_centrality']})) WHERE rank <= 10 UNION ALL SELECT 'pagerank', id, rank FROM (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS rank FROM ({gq.SQL['pagerank']})) WHERE rank <= 10 UNION ALL SELECT kind, 'n', count(*) FROM ({gq.SQL['structural_anomalies']}) GROUP BY kind")
def graph_summary(spark, d):
    """The ten best connected and the ten highest ranked nodes, and how many anomalies there are."""

    def top(df: DataFrame, measure: str, score: str) -> DataFrame:
        best = df.orderBy(F.desc(score), "id").limit(10)
        return best.select(F.lit(measure).alias("measure"), F.col("id").alias("name"), F.row_number().over(_ten(score)).cast("long").alias("rank"))

    anomalies = gq.structural_anomalies(spark, d).groupBy(F.col("kind").alias("measure")).agg(F.count("*").alias("rank")).select("measure", F.lit("n").alias("name"), "rank")
    return top(gq.degree_centrality(spark, d), "degree", "centrality").unionByName(top(gq.pagerank(spark, d), "pagerank", "rank")).unionByName(anomalies)


def _ten(score: str):
    from pyspark.sql import Window

    # over ten rows: the limit before it bounds the one partition
    return Window.orderBy(F.desc(score), "id")


# --- texts ------------------------------------------------------------------------------------------------------------
_QUERY = "(SELECT id, node_type, CASE WHEN abs(hash_k) % 3 = 0 THEN 'What is the status of ' || title || '?' WHEN abs(hash_k) % 3 = 1 THEN 'Tell me about ' || title ELSE 'i decided on ' || title || ' today' END AS q FROM (SELECT id, node_type, title, length(title) AS hash_k FROM {0} WHERE title IS NOT NULL))".format(LIVE)


def _queries(spark, d) -> DataFrame:
    k = F.length("title") % 3
    q = F.when(k == 0, F.concat(F.lit("What is the status of "), "title", F.lit("?"))).when(k == 1, F.concat(F.lit("Tell me about "), "title")).otherwise(F.concat(F.lit("i decided on "), "title", F.lit(" today")))
    return lk.live(t(spark, d, "nodes")).where("title is not null").select("id", "node_type", q.alias("q"))


def _sum_sql(kind: str) -> str:
    weight, marks = tx.SIGNALS[kind]
    return "(" + " + ".join(f"CASE WHEN contains(x, '{m}') THEN {weight} ELSE 0 END" for m in marks) + ")"


_STATE = " OR ".join(f"contains(x, '{w}')" for w in tx.ABOUT_STATE)


@query("query_kinds", f"""WITH a AS (SELECT id, lower(q) AS x FROM {_QUERY} z), b AS (SELECT id, {_sum_sql('council')} AS cl, {_sum_sql('research')} + CASE WHEN contains(x, 'what is') AND NOT ({_STATE}) THEN 1.5 ELSE 0 END + CASE WHEN contains(x, 'compare') THEN 0.5 ELSE 0 END AS rs, {_sum_sql('analysis')} + CASE WHEN contains(x, 'what is') AND ({_STATE}) THEN 1.5 ELSE 0 END + CASE WHEN contains(x, 'compare') THEN 0.5 ELSE 0 END AS an, {_sum_sql('capture')} AS cp FROM a),
c AS (SELECT id, cl, rs, CASE WHEN an > 0 AND an = rs THEN an + 0.1 ELSE an END AS an, CASE WHEN an > 0 THEN cp * 0.5 ELSE cp END AS cp FROM b) SELECT id, CASE WHEN greatest(cp, rs, an, cl) = 0 THEN 'analysis' WHEN greatest(cp, rs, an, cl) = cp THEN 'capture' WHEN greatest(cp, rs, an, cl) = rs THEN 'research' WHEN greatest(cp, rs, an, cl) = an THEN 'analysis' ELSE 'council' END AS kind FROM c""")
def query_kinds(spark, d):
    return _queries(spark, d).select("id", tx.query_kind(F.col("q")).alias("kind"))


@query("query_names")
def query_names(spark, d):
    """Names, focus and intent of questions; their words are checked against plain Python in the tests."""
    q = F.col("q")
    return _queries(spark, d).select("id", F.array_join(tx.entity_names(q), "|").alias("names"), tx.question_focus(q).alias("focus"), tx.dossier_intent(q).alias("intent"))


@query("queries_sent_out")
def queries_sent_out(spark, d):
    """Captures as they may be sent to a search: without addresses, numbers, sums and dates."""
    return t(spark, d, "captures").where("raw_content is not null").select("id", tx.without_private(F.col("raw_content")).alias("text"))


@query("anonymous_context", f"SELECT id, node_type, CASE WHEN node_type <> 'PERSON' THEN substr(coalesce(content, ''), 1, 100) END AS summary FROM {LIVE}")
def anonymous_context(spark, d):
    """Nodes as context for the outside: no content of people, a hundred characters of the others."""
    return lk.live(t(spark, d, "nodes")).select("id", "node_type", F.when(F.col("node_type") != "PERSON", F.substring(F.coalesce("content", F.lit("")), 1, 100)).alias("summary"))


_ORG, _ROLE = P.format("organization"), P.format("role")


@query("watch_phrases", f"SELECT id, concat_ws(' ', '\"' || coalesce(title, '') || '\"', '\"' || coalesce(nullif({_ORG}, ''), nullif({_ROLE}, '')) || '\"', 'LinkedIn') AS phrase FROM {LIVE} WHERE node_type = 'PERSON'")
def watch_phrases(spark, d):
    return lk.live(t(spark, d, "nodes")).where("node_type = 'PERSON'").select("id", tx.search_phrase(F.col("title"), lk.prop("organization"), lk.prop("role")).alias("phrase"))


@query("page_profiles", f"SELECT id, {_ROLE} AS role, {_ORG} AS organisation FROM {LIVE} WHERE node_type = 'PERSON' AND regexp_matches({_ROLE}, '^[A-Za-z]+( [A-Za-z]+)*$') AND regexp_matches({_ORG}, '^[A-Za-z]+( [A-Za-z]+)*$') AND regexp_matches(title, '^[A-Za-z ]+$')")
def page_profiles(spark, d):
    """Role and organisation read back from page titles."""
    p = lk.live(t(spark, d, "nodes")).where(F.col("node_type") == "PERSON").where(lk.prop("role").rlike("^[A-Za-z]+( [A-Za-z]+)*$") & lk.prop("organization").rlike("^[A-Za-z]+( [A-Za-z]+)*$") & F.col("title").rlike("^[A-Za-z ]+$"))
    page = F.concat("title", F.lit(" - "), lk.prop("role"), F.lit(" at "), lk.prop("organization"), F.lit(" | LinkedIn"))
    return p.select("id", tx.profile_of(page).alias("p")).select("id", F.trim("p.role").alias("role"), "p.organisation")


@query("entities_named", f"SELECT c.id AS capture_id, n.id FROM (SELECT id, unnest(list_distinct(regexp_extract_all(raw_content, '\\b([A-Z][a-z]+)\\b', 1))) AS word FROM captures WHERE raw_content IS NOT NULL) c JOIN {LIVE} n ON lower(n.title) = lower(c.word)")
def entities_named(spark, d):
    """Nodes whose whole title a capture names by a capitalised word."""
    from loomgraph.functions.scores import capitalised

    words = t(spark, d, "captures").where("raw_content is not null").select(F.col("id").alias("capture_id"), F.explode(capitalised(F.col("raw_content"))).alias("word"))
    titles = lk.live(t(spark, d, "nodes")).select("id", F.lower("title").alias("key"))
    return words.withColumn("key", F.lower("word")).join(titles, "key").select("capture_id", "id")


_OWN = f"""WITH RECURSIVE near AS MATERIALIZED (SELECT id, nbr FROM {gq.NEAR}), w AS (SELECT '{lk.OWNER}' AS id, 0 AS hops UNION SELECT near.nbr, w.hops + 1 FROM w JOIN near USING (id) WHERE w.hops < 4)"""


@query("owner_links_made", f"{_OWN} SELECT '{lk.OWNER}' AS source_id, id AS target_id, {rq._KIND} AS edge_type, 0.5::DOUBLE AS weight FROM {LIVE} WHERE id <> '{lk.OWNER}' AND id NOT IN (SELECT id FROM w)")
def owner_links_made(spark, d):
    """Edges that tie every live node to the owner that has no way of four links to them: by type, from the owner."""
    from loomgraph.operators import graph as g

    near = g.shortest_paths(gq.links(spark, d), spark.createDataFrame([(lk.OWNER,)], "id string"), 4).select("id")
    return rc.owner_edges(lk.live(t(spark, d, "nodes")).where(F.col("id") != lk.OWNER).join(near, "id", "left_anti")).select("source_id", "target_id", "edge_type", "weight")


# --- values of captures -----------------------------------------------------------------------------------------------
_DOW = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MENTION = r"\b(today|tomorrow|yesterday|next (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week)|in [0-9]+ days|end of the month)\b"


@query(
    "date_values",
    f"""SELECT id, mention, CASE WHEN mention = 'today' THEN day WHEN mention = 'tomorrow' THEN day + 1 WHEN mention = 'yesterday' THEN day - 1 WHEN mention = 'next week' THEN day + 7 WHEN mention = 'end of the month' THEN last_day(day) WHEN starts_with(mention, 'in ') THEN day + TRY_CAST(regexp_extract(mention, '([0-9]+)', 1) AS INT)
ELSE day + (((CASE substr(mention, 6) {' '.join(f"WHEN '{w}' THEN {k}" for k, w in enumerate(_DOW))} END - (isodow(day) - 1) + 6) % 7) + 1)::INT END::DATE AS day FROM (SELECT id, created_at::DATE AS day, unnest(list_distinct(regexp_extract_all(lower(raw_content), '{_MENTION}', 1))) AS mention FROM captures WHERE raw_content IS NOT NULL AND created_at IS NOT NULL)""",
)
def date_values(spark, d):
    """The days that captures speak of, counted from the day they were made."""
    from loomgraph.operators.views import date_references

    m = t(spark, d, "captures").where("raw_content is not null and created_at is not null").select("id", F.to_date("created_at").alias("day"), F.explode(date_references(F.col("raw_content"))).alias("mention"))
    day, mention = F.col("day"), F.col("mention")
    wanted = F.array_position(F.array(*map(F.lit, _DOW)), F.substring(mention, 6, 10)).cast("int") - 1
    ahead = F.pmod(wanted - F.weekday(day) + 6, F.lit(7)) + 1
    value = (
        F.when(mention == "today", day)
        .when(mention == "tomorrow", F.date_add(day, 1))
        .when(mention == "yesterday", F.date_sub(day, 1))
        .when(mention == "next week", F.date_add(day, 7))
        .when(mention == "end of the month", F.last_day(day))
        .when(mention.startswith("in "), F.date_add(day, F.regexp_extract(mention, "([0-9]+)", 1).try_cast("int")))
        .otherwise(F.date_add(day, ahead.cast("int")))
    )
    return m.select("id", "mention", value.alias("day"))


@query("money_values", r"SELECT id, count(*) AS n, round(sum(TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE)), 2) AS total FROM (SELECT id, unnest(regexp_extract_all(raw_content, '(\$[0-9][0-9,]*(?:\.[0-9]+)?)', 1)) AS amount FROM captures WHERE raw_content IS NOT NULL) GROUP BY id")
def money_values(spark, d):
    """Sums of money in captures as numbers."""
    from loomgraph.functions.scores import money

    a = t(spark, d, "captures").where("raw_content is not null").select("id", F.explode(money(F.col("raw_content"))).alias("amount"))
    return a.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.regexp_replace("amount", "[$,]", "").try_cast("double")), 2).alias("total"))


@query("capture_context", f"WITH n AS ({SQL['entities_named']}) SELECT capture_id, id, 0 AS hop FROM n UNION ALL SELECT DISTINCT n.capture_id, e.other_id, 1 FROM n JOIN {r.SYM.format('edges')} e ON e.node_id = n.id JOIN {LIVE} o ON o.id = e.other_id WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.capture_id = n.capture_id AND m.id = e.other_id)")
def capture_context(spark, d):
    """What a capture names, and what stands next to it."""
    from loomgraph.operators.views import context
    from loomgraph.runtime import write_stage

    named = write_stage(entities_named(spark, d), "context-named").df
    ends = lk.symmetric(t(spark, d, "edges")).select(F.col("node_id").alias("id"), "other_id").join(named.select("id").distinct(), "id", "left_semi").distinct()
    near = write_stage(ends.join(lk.live(t(spark, d, "nodes")).select(F.col("id").alias("other_id")), "other_id", "left_semi"), "context-near").df
    return named.select("capture_id", "id", F.lit(0).alias("hop")).unionByName(context(named, near).withColumn("hop", F.lit(1)))


@query("node_value_breaks", f"SELECT node_type, 'currency' AS member, count(*) AS n FROM {LIVE} WHERE {P.format('currency')} IS NOT NULL AND NOT regexp_full_match({P.format('currency')}, '[A-Z]{{3}}') GROUP BY 1 UNION ALL SELECT node_type, 'url', count(*) FROM {LIVE} WHERE {P.format('url')} IS NOT NULL AND NOT regexp_matches({P.format('url')}, '^https?://\\S+$') GROUP BY 1 UNION ALL SELECT node_type, 'website', count(*) FROM {LIVE} WHERE {P.format('website')} IS NOT NULL AND NOT regexp_matches({P.format('website')}, '^https?://\\S+$') GROUP BY 1")
def node_value_breaks(spark, d):
    """Members whose value is not of the type declared for it, by type of node."""
    from loomgraph.functions import ontology as on

    kinds = {"currency": "CURRENCY_CODE", "url": "URL", "website": "URL"}
    bad = F.array_compact(F.array(*(F.when(lk.prop(m).isNotNull() & ~F.coalesce(on.valid_value(k, lk.prop(m)), F.lit(False)), m) for m, k in kinds.items())))
    return lk.live(t(spark, d, "nodes")).select("node_type", F.explode(bad).alias("member")).groupBy("node_type", "member").agg(F.count("*").alias("n"))
