"""Queries over scores, time and facts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import scores as sc
from loomgraph.operators import facts as fx
from loomgraph.operators import horizon as hz
from loomgraph.operators import lookup as lk
from loomgraph.operators import measures as ms
from loomgraph.operators import relations as rl
from loomgraph.operators import temporal as tm
from loomgraph.plans import relational as r
from loomgraph.plans.relational import AS_OF, DAY, EDGE, LIVE, SYM, P, t

QUERIES: dict = {}
SQL: dict[str, str] = {}
FACT = "(SELECT DISTINCT ON (id) * FROM verified_facts)"
CHECK = "(SELECT DISTINCT ON (id) * FROM fact_checks)"
_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.NETWORK_DECAY.items()) + f" ELSE {sc.DEFAULT_DECAY} END"


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


def now():
    return F.lit(AS_OF).cast("timestamp")


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$"


def _instant(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches(trim({x}), '{_ISO}') THEN NULL WHEN regexp_matches(trim({x}), '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN TRY_CAST(trim({x}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST(trim({x}) AS TIMESTAMP) END"


_OWN = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {P.format(v)}" for k, v in sc.DATE_FIELDS.items()) + " END"
_KNOWN = "[" + ", ".join(f"'{n}'" for n in sc.NETWORK_DECAY) + "]"
_RELEVANCE = f"""CASE WHEN (node_type = 'COMMITMENT' AND lower(st) = 'open') OR (node_type IN ('GOAL', 'PROJECT') AND lower(st) = 'active') OR own > TIMESTAMP '{AS_OF}' THEN 1.0
ELSE exp(-({_CASE.format('net')}) / (1 + ln(1 + coalesce(access_count, 0))) * greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(greatest(last_accessed, own, created_at))) / 86400000000.0)) END"""


@query("relevance_decay", f"SELECT id, round({_RELEVANCE}, 6) AS score FROM (SELECT *, {P.format('status')} AS st, {_instant(_OWN)} AS own, list_filter(networks, lambda n: list_contains({_KNOWN}, n))[1] AS net FROM {LIVE}) WHERE id <> '{lk.OWNER}' AND created_at IS NOT NULL")
def relevance_decay(spark, d):
    return lk.live(t(spark, d, "nodes")).where((F.col("id") != lk.OWNER) & F.col("created_at").isNotNull()).select("id", F.round(sc.relevance(now()), 6).alias("score"))


_TIE = "CASE upper(edge_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.TIE_SHARES.items()) + f" ELSE {sc.DEFAULT_TIE_SHARE} END"


@query("tie_strengths", f"""WITH p AS (SELECT id FROM {LIVE} WHERE node_type = 'PERSON'), near AS (SELECT DISTINCT node_id, other_id FROM {SYM.format('edges')} WHERE node_id <> other_id),
e AS (SELECT * FROM {EDGE} WHERE source_id IN (SELECT id FROM p) AND target_id IN (SELECT id FROM p)), k AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE source_id <> target_id),
s AS (SELECT a, b, count(*) AS n FROM k JOIN near x ON x.node_id = a JOIN near y ON y.node_id = b AND y.other_id = x.other_id GROUP BY 1, 2)
SELECT id, coalesce(n, 0) AS n_shared, round(greatest(0.0, least(1.0, 0.25 * least(coalesce(weight, 1.0), 1.0) + 0.15 * least(coalesce(confidence, 0.5), 1.0) + 0.20 * {_TIE} + 0.25 * coalesce(exp(-0.693 * greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0) / 35.0), 0.0) + 0.15 * ln(1.0 + least(coalesce(n, 0), 5)) / ln(6.0))), 3) AS strength FROM e LEFT JOIN s ON s.a = source_id AND s.b = target_id""")
def tie_strengths(spark, d):
    return rl.tie_strengths(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF).select("id", "n_shared", "strength")


_DATED = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {P.format(v)}" for k, v in sc.DATE_FIELDS.items() if k in hz.OPEN_STATUSES) + " END"
_HEALTH = r.SQL["network_health"]
ITEMS = f"""items AS MATERIALIZED (SELECT *, (epoch_us(due_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000.0 AS lft, trunc((epoch_us(due_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000.0)::BIGINT AS days FROM (SELECT *, {_instant(_DATED)} AS due_at FROM {LIVE}
WHERE (node_type = 'COMMITMENT' AND {P.format('status')} IN ('open', 'overdue')) OR (node_type IN ('GOAL', 'PROJECT') AND {P.format('status')} = 'active') OR node_type IN ('EVENT', 'DECISION'))),
health AS MATERIALIZED (SELECT network, status FROM ({_HEALTH}) WHERE snapshot = TIMESTAMP '{AS_OF}'), up AS MATERIALIZED (SELECT source_id AS child, min(target_id) AS parent FROM edges WHERE upper(edge_type) = 'SUBTASK_OF' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
way AS (SELECT id, id AS pos, [id] AS seen, 0 AS depth, false AS done FROM items UNION ALL SELECT w.id, u.parent, list_append(w.seen, u.parent), w.depth + 1, list_contains(w.seen, u.parent) FROM way w JOIN up u ON u.child = w.pos WHERE w.depth < 5 AND NOT w.done), deep AS (SELECT id, max(depth) AS depth FROM way GROUP BY id),
waits AS (SELECT target_id AS id, count(DISTINCT id) AS n FROM edges WHERE upper(edge_type) = 'SUBTASK_OF' GROUP BY 1), worst AS (SELECT i.id, max(CASE h.status WHEN 'falling_behind' THEN 1.0 WHEN 'needs_attention' THEN 0.6 ELSE 0.2 END) AS worst FROM (SELECT id, unnest(networks) AS network FROM items) i LEFT JOIN health h USING (network) GROUP BY 1),
scored AS (SELECT i.id, i.node_type, i.networks, i.days, CASE WHEN days IS NULL THEN 'undated' WHEN lft < 0 THEN 'overdue' WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'tomorrow' WHEN days <= 7 THEN 'this_week' WHEN days <= 14 THEN 'next_week' WHEN days <= 30 THEN 'this_month' ELSE 'later' END AS bucket,
 0.35 * coalesce(1 / (1 + exp(days / 3.0)), 0.3) + 0.15 * CASE WHEN waits.n > 0 THEN ln(1 + waits.n) / ln(11) ELSE 0 END + 0.20 * coalesce(worst, 0.2) + 0.10 * (1 - coalesce(decay_score, 1.0)) + 0.20 * least(depth * 0.2, 1.0) AS priority FROM items i LEFT JOIN waits USING (id) LEFT JOIN worst USING (id) LEFT JOIN deep USING (id))"""


@query("horizon", f"WITH RECURSIVE {ITEMS} SELECT id, node_type, bucket, round(priority, 6) AS priority FROM scored")
def horizon(spark, d):
    return hz.scored(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF).select("id", "node_type", "bucket", F.round("priority", 6).alias("priority"))


@query("horizon_load", f"WITH RECURSIVE {ITEMS} SELECT network, count(*) AS n_items, count(*) FILTER (bucket = 'overdue') AS n_overdue FROM (SELECT unnest(networks) AS network, bucket FROM scored) GROUP BY 1")
def horizon_load(spark, d):
    return hz.network_load(hz.scored(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF))


@query("blocked_items", f"SELECT DISTINCT e.target_id AS id, e.source_id AS blocked_id FROM edges e JOIN {LIVE} g ON g.id = e.target_id AND g.node_type IN ('GOAL', 'PROJECT', 'COMMITMENT') JOIN {LIVE} c ON c.id = e.source_id WHERE upper(e.edge_type) = 'SUBTASK_OF'")
def blocked_items(spark, d):
    ids = lk.live(t(spark, d, "nodes")).where("node_type in ('GOAL', 'PROJECT', 'COMMITMENT')").select("id")
    return hz.blocked_by(ids, t(spark, d, "edges"), t(spark, d, "nodes"))


@query("impact_previews", f"WITH RECURSIVE {ITEMS}, b AS (SELECT target_id AS id, count(DISTINCT source_id) AS n FROM edges WHERE upper(edge_type) = 'SUBTASK_OF' AND source_id IN (SELECT id FROM {LIVE}) GROUP BY 1), s AS (SELECT id, max(CASE status WHEN 'falling_behind' THEN 2 WHEN 'needs_attention' THEN 1 ELSE 0 END) AS k FROM (SELECT id, unnest(networks) AS network FROM items) JOIN health USING (network) GROUP BY 1) SELECT id, coalesce(b.n, 0) AS n_unblocked, CASE s.k WHEN 2 THEN 'falling_behind' WHEN 1 THEN 'needs_attention' WHEN 0 THEN 'on_track' END AS worst_status FROM items LEFT JOIN b USING (id) LEFT JOIN s USING (id) WHERE node_type IN ('COMMITMENT', 'GOAL')")
def impact_previews(spark, d):
    return hz.impact(t(spark, d, "nodes"), t(spark, d, "edges"), AS_OF)


@query("question_answers", f"""WITH o AS (SELECT id AS other_id, node_type AS k, coalesce({P.format('status')}, {P.format('progress')}, {P.format('state')}, {P.format('phase')}) IS NOT NULL AS told, lower(concat_ws(' ', title, coalesce(content, ''))) AS x FROM {LIVE})
SELECT focus_id, id, round(max(s), 6) AS score FROM (SELECT e.node_id AS focus_id, o.other_id AS id, CASE WHEN k = 'COMMITMENT' THEN 0.4 ELSE 0 END + CASE WHEN upper(e.edge_type) = 'COMMITTED_TO' THEN 0.3 ELSE 0 END + CASE WHEN told THEN 0.5 ELSE 0 END + 0.2 * least(contains(x, 'commitments')::INT + contains(x, 'status')::INT, 3) AS s FROM {SYM.format('edges')} e JOIN o ON o.other_id = e.other_id WHERE e.node_id IN (SELECT id FROM {LIVE} WHERE node_type = 'PERSON')) WHERE s > 0 GROUP BY 1, 2""")
def question_answers(spark, d):
    """What stands next to each person, for a question about the status of their commitments."""
    people = lk.live(t(spark, d, "nodes")).where("node_type = 'PERSON'").select("id")
    return hz.answers(people, t(spark, d, "nodes"), t(spark, d, "edges"), ("commitments", "status"), ("COMMITMENT",), ("COMMITTED_TO",), True).select("focus_id", "id", F.round("score", 6).alias("score"))


@query("deadlines_near", f"SELECT id, CASE WHEN days <= 1 THEN 1 WHEN days <= 3 THEN 3 WHEN days <= 7 THEN 7 END AS within_days FROM (SELECT id, date_diff('day', DATE '{AS_OF}', {DAY.format(P.format('due_date'))}) AS days FROM {LIVE} WHERE node_type = 'COMMITMENT' AND {P.format('status')} = 'open') WHERE days BETWEEN 0 AND 7")
def deadlines_near(spark, d):
    left = F.datediff(lk.iso_day(lk.prop("due_date")), F.to_date(F.lit(AS_OF)))
    return lk.by_status(t(spark, d, "nodes"), "COMMITMENT", "open").select("id", sc.tightest_window(left).alias("within_days")).where("within_days is not null")


@query("name_scores", f"""WITH p AS (SELECT id, lower(trim(title)) AS x, regexp_split_to_array(lower(trim(title)), '\\s+') AS w FROM {LIVE} WHERE node_type = 'ORGANIZATION' AND title IS NOT NULL)
SELECT a.id AS a, b.id AS b, round(CASE WHEN a.x = '' OR b.x = '' THEN 0.0 WHEN a.x = b.x THEN 1.0 WHEN a.w[1] = b.w[1] AND (len(a.w) = 1) <> (len(b.w) = 1) THEN 0.85 WHEN contains(a.x, b.x) OR contains(b.x, a.x) THEN greatest(0.7, least(length(a.x), length(b.x)) / greatest(length(a.x), length(b.x))) ELSE 0.6 * len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(a.w || b.w)) END, 6) AS score FROM p a JOIN p b ON (a.w[1] = b.w[1] OR (a.w[-1] = b.w[-1] AND a.w[1][1:2] = b.w[1][1:2])) AND a.id < b.id""")
def name_scores(spark, d):
    """Names that begin with one word, or end with one and begin with the same two letters."""
    p = lk.live(t(spark, d, "nodes")).where("node_type = 'ORGANIZATION' and title is not null").withColumn("w", F.split(F.trim(F.lower("title")), r"\s+"))
    blocks = F.array(F.concat(F.lit("first|"), F.get("w", F.lit(0))), F.concat_ws("|", F.element_at("w", -1), F.substring(F.get("w", F.lit(0)), 1, 2)))
    side = lambda i, x: p.select(F.col("id").alias(i), F.col("title").alias(x), F.explode(blocks).alias("block"))
    pairs = side("a", "x").join(side("b", "y"), "block").where("a < b").select("a", "b", "x", "y").distinct()
    return pairs.select("a", "b", F.round(sc.name_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query("capture_signals", "SELECT id, CASE WHEN length(raw_content) = 0 THEN 'und' WHEN length(regexp_replace(raw_content, '[^\\x00-\\x7F]', '', 'g')) / length(raw_content) > 0.9 THEN 'en' ELSE 'und' END AS language, len(regexp_extract_all(raw_content, '(\\$[0-9][0-9,]*(?:\\.[0-9]+)?)', 1)) AS n_amounts, sha256(raw_content) AS hash FROM captures WHERE raw_content IS NOT NULL")
def capture_signals(spark, d):
    c = F.col("raw_content")
    return t(spark, d, "captures").where(c.isNotNull()).select("id", sc.ascii_language(c).alias("language"), F.size(sc.money(c)).cast("long").alias("n_amounts"), F.sha2(c, 256).alias("hash"))


@query("hash_audit", "SELECT CASE WHEN content_hash IS NULL THEN 'missing' WHEN lower(regexp_replace(content_hash, '^sha256:', '')) = sha256(raw_content) THEN 'right' ELSE 'other' END AS verdict, count(*) AS n FROM captures GROUP BY 1")
def hash_audit(spark, d):
    same = F.lower(F.regexp_replace("content_hash", "^sha256:", "")) == F.sha2("raw_content", 256)
    return t(spark, d, "captures").groupBy(F.when(F.col("content_hash").isNull(), "missing").when(same, "right").otherwise("other").alias("verdict")).agg(F.count("*").alias("n"))


@query("review_schedule", f"""WITH RECURSIVE q AS (SELECT fact_id, list(CASE result WHEN 'confirmed' THEN 5 WHEN 'inconclusive' THEN 3 ELSE 1 END ORDER BY checked_at, id) AS qs FROM {CHECK} WHERE fact_id IS NOT NULL AND checked_at IS NOT NULL GROUP BY fact_id),
f AS (SELECT fact_id, qs, 0 AS i, 0 AS reps, 0::BIGINT AS days, 2.5::DOUBLE AS easy FROM q
 UNION ALL SELECT fact_id, qs, i + 1, CASE WHEN qs[i + 1] < 3 THEN 0 ELSE reps + 1 END, CASE WHEN qs[i + 1] < 3 OR reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE round(days * easy)::BIGINT END, greatest(1.3, easy + 0.1 - (5 - qs[i + 1]) * (0.08 + (5 - qs[i + 1]) * 0.02)) FROM f WHERE i < len(qs))
SELECT fact_id, reps::INT AS repetitions, days AS interval_days, round(easy, 6) AS easiness FROM f WHERE i = len(qs)""")
def review_schedule(spark, d):
    quality = F.when(F.col("result") == "confirmed", 5).when(F.col("result") == "inconclusive", 3).otherwise(1)
    checks = t(spark, d, "fact_checks").dropDuplicates(["id"]).where("fact_id is not null and checked_at is not null")
    lists = checks.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("checked_at", "id", quality.alias("q")))), lambda x: x["q"]).alias("qs"))
    s = sc.review_fold(F.col("qs"))
    return lists.select("fact_id", s.alias("s")).select("fact_id", "s.repetitions", "s.interval_days", F.round("s.easiness", 6).alias("easiness"))


@query("present_signals", f"SELECT id, round(CASE WHEN w > 0 THEN v / w END, 6) AS score FROM (SELECT id, CASE WHEN confidence IS NULL THEN 0 ELSE 0.5 END + CASE WHEN decay_score IS NULL THEN 0 ELSE 0.3 END + CASE WHEN access_count IS NULL THEN 0 ELSE 0.2 END AS w, coalesce(confidence * 0.5, 0) + coalesce(decay_score * 0.3, 0) + coalesce(least(access_count / 100.0, 1.0) * 0.2, 0) AS v FROM {LIVE})")
def present_signals(spark, d):
    s = sc.weighted_present({"confidence": (F.col("confidence"), 0.5), "decay": (F.col("decay_score"), 0.3), "access": (F.least(F.col("access_count") / 100.0, F.lit(1.0)), 0.2)})
    return lk.live(t(spark, d, "nodes")).select("id", F.round(s, 6).alias("score"))


# --- time ------------------------------------------------------------------------------------------------------------
_DAYS = f"(SELECT created_at::DATE AS day, count(*) AS n FROM {LIVE} WHERE created_at IS NOT NULL GROUP BY 1)"


@query("anomalous_days", f"SELECT day, n, round((n - m) / s, 6) AS score FROM {_DAYS}, (SELECT avg(n) AS m, stddev_pop(n) AS s FROM {_DAYS}) WHERE n > m + 2.0 * s AND n > 3")
def anomalous_days(spark, d):
    return tm.anomalous_days(tm.daily_counts(lk.live(t(spark, d, "nodes"))))


@query("activity_bursts", f"""WITH RECURSIVE a AS (SELECT day, row_number() OVER (ORDER BY day) AS pos, sum(n) OVER f AS total, max(day) OVER f AS last_day, count(*) OVER f AS k FROM {_DAYS} WINDOW f AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
h AS (SELECT * FROM a WHERE k = 7 AND total / 7.0 > (SELECT sum(n) / count(*) FROM {_DAYS}) * 1.2),
g AS (SELECT min(pos) AS pos FROM h UNION ALL SELECT (SELECT min(h.pos) FROM h WHERE h.pos >= g.pos + 7) FROM g WHERE g.pos IS NOT NULL)
SELECT h.day, h.last_day, h.total::BIGINT AS total FROM h JOIN g USING (pos)""")
def activity_bursts(spark, d):
    return tm.burst_windows(tm.daily_counts(lk.live(t(spark, d, "nodes"))), 7, 1.2)


@query("activity_shift", f"SELECT network, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS prior FROM (SELECT unnest(networks) AS network, created_at FROM {LIVE}) WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND created_at < TIMESTAMP '{AS_OF}' GROUP BY network")
def activity_shift(spark, d):
    return tm.recent_against_prior(ms.per_network(lk.live(t(spark, d, "nodes"))), "network", "created_at", AS_OF, 30)


@query("weekday_peaks", f"SELECT wd, n, node_type FROM (SELECT isodow(created_at) - 1 AS wd, node_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY isodow(created_at)) ::BIGINT AS n, row_number() OVER (PARTITION BY isodow(created_at) ORDER BY count(*) DESC, node_type) AS k FROM {LIVE} WHERE created_at IS NOT NULL GROUP BY isodow(created_at), node_type) WHERE k = 1")
def weekday_peaks(spark, d):
    w = Window.partitionBy("wd").orderBy(F.desc("c"), "node_type")
    g = lk.live(t(spark, d, "nodes")).where("created_at is not null").groupBy(F.weekday("created_at").cast("long").alias("wd"), "node_type").agg(F.count("*").alias("c"))
    return g.select("wd", F.sum("c").over(Window.partitionBy("wd")).alias("n"), "node_type", F.row_number().over(w).alias("k")).where("k = 1").drop("k")


@query("concurrent_nodes", f"SELECT a.id AS anchor_id, b.id FROM {LIVE} a JOIN {LIVE} b ON b.id <> a.id AND abs(epoch_us(b.created_at) - epoch_us(a.created_at)) <= 48 * 3600000000 WHERE a.node_type = 'DECISION' AND NOT coalesce(len(list_intersect(a.networks, b.networks)) > 0, false)")
def concurrent_nodes(spark, d):
    n = lk.live(t(spark, d, "nodes"))
    return tm.concurrent(n.where("node_type = 'DECISION'"), n, 48)


@query("user_sessions", "SELECT user_id, session, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 240 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session")
def user_sessions(spark, d):
    return tm.sessions(t(spark, d, "events"), "user_id", "ts", 240)


@query("last_signup_value", "SELECT p.event_id, (SELECT arg_max(s.value, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts) AS as_of_value FROM events p WHERE p.event_type = 'purchase'")
def last_signup_value(spark, d):
    e = t(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return tm.as_of_join(left, e.where("event_type = 'signup'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "as_of_value")


@query("timeline", f"SELECT 'node' AS kind, id, created_at AS happened_at FROM {LIVE} WHERE created_at >= TIMESTAMP '2025-03-01' AND created_at < TIMESTAMP '2025-04-01' UNION ALL SELECT 'check', id, checked_at FROM {CHECK} WHERE checked_at >= TIMESTAMP '2025-03-01' AND checked_at < TIMESTAMP '2025-04-01'")
def timeline(spark, d):
    span = lambda c: (F.col(c) >= F.lit("2025-03-01").cast("timestamp")) & (F.col(c) < F.lit("2025-04-01").cast("timestamp"))
    a = lk.live(t(spark, d, "nodes")).where(span("created_at")).select(F.lit("node").alias("kind"), "id", F.col("created_at").alias("happened_at"))
    return a.unionByName(t(spark, d, "fact_checks").dropDuplicates(["id"]).where(span("checked_at")).select(F.lit("check").alias("kind"), "id", F.col("checked_at").alias("happened_at")))


# --- facts -----------------------------------------------------------------------------------------------------------
@query("facts_repeated", f"SELECT id, first_id FROM (SELECT id, first_value(id) OVER (PARTITION BY node_id, lower(trim(statement)) ORDER BY created_at NULLS LAST, id) AS first_id FROM {FACT} WHERE node_id IS NOT NULL AND statement IS NOT NULL) WHERE id <> first_id")
def facts_repeated(spark, d):
    return fx.duplicate_facts(t(spark, d, "verified_facts"))


_STOP = "[" + ", ".join(f"'{w}'" for w in fx.STOPWORDS) + "]"


@query("facts_contradicting", f"WITH w AS (SELECT id, node_id, lower(trim(statement)) AS key, list_filter(list_distinct(list_filter(string_split_regex(lower(statement), '[^a-z0-9]+'), lambda x: length(x) > 1)), lambda x: NOT list_contains({_STOP}, x)) AS ws FROM {FACT} WHERE node_id IS NOT NULL AND statement IS NOT NULL AND status = 'active') SELECT a.id AS a, b.id AS b, len(list_intersect(a.ws, b.ws))::INT AS n_common FROM w a JOIN w b ON a.node_id = b.node_id AND a.id < b.id AND a.key <> b.key WHERE len(list_intersect(a.ws, b.ws)) >= greatest(3.0, 0.5 * least(len(a.ws), len(b.ws)))")
def facts_contradicting(spark, d):
    return fx.possible_contradictions(t(spark, d, "verified_facts"))


@query("facts_faded", f"""SELECT id, confidence AS old_confidence, c AS new_confidence, CASE WHEN c < 0.4 THEN 'stale' ELSE 'active' END AS new_status FROM (SELECT id, confidence, round(greatest(0.0, confidence * power(0.9, greatest(1, floor(days / CASE WHEN recheck_interval_days > 0 THEN recheck_interval_days ELSE 90 END) + 1))), 4) AS c
FROM (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(next_check)) / 86400000000.0 AS days FROM {FACT} WHERE lifecycle = 'dynamic' AND status = 'active') WHERE days >= 0)""")
def facts_faded(spark, d):
    return fx.faded_confidence(t(spark, d, "verified_facts"), AS_OF)


@query("check_history", f"SELECT id, fact_id, row_number() OVER w AS number, coalesce(lag(result) OVER w <> result, false) AS changed FROM {CHECK} WHERE fact_id IS NOT NULL AND checked_at IS NOT NULL WINDOW w AS (PARTITION BY fact_id ORDER BY checked_at, id)")
def check_history(spark, d):
    return fx.check_history(t(spark, d, "fact_checks"))


_SOURCES = "CASE proposed_by " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fx.SOURCE_WEIGHTS.items()) + " ELSE 0.8 END"


@query("calibrated_confidence", f"SELECT id, round(greatest(0, least(1, confidence * {_SOURCES})), 6) AS confidence FROM {LIVE} WHERE confidence IS NOT NULL")
def calibrated_confidence(spark, d):
    w = sc.lookup(fx.SOURCE_WEIGHTS, F.coalesce("proposed_by", F.lit("")), 0.8)
    return lk.live(t(spark, d, "nodes")).where("confidence is not null").select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * w)), 6).alias("confidence"))


@query("network_keywords", "SELECT id, network, n FROM (SELECT id, unnest([{'network': 'ACADEMIC', 'n': k('exam|lecture|course|thesis')}, {'network': 'FINANCIAL', 'n': k('budget|invoice|cost|fees')}, {'network': 'CLUBS', 'n': k('club|member|committee')}], recursive := true) FROM x) WHERE n > 0".replace("FROM x", "FROM (SELECT id, lower(raw_content) AS c FROM captures WHERE raw_content IS NOT NULL)").replace("k('", "len(regexp_extract_all(c, '").replace("')}", "'))}"))
def network_keywords(spark, d):
    words = {"ACADEMIC": "exam|lecture|course|thesis", "FINANCIAL": "budget|invoice|cost|fees", "CLUBS": "club|member|committee"}
    count = lambda w: F.regexp_count(F.lower("raw_content"), F.lit(w)).cast("long")
    hits = F.array(*(F.struct(F.lit(k).alias("network"), count(w).alias("n")) for k, w in words.items()))
    return t(spark, d, "captures").where("raw_content is not null").select("id", F.explode(hits).alias("h")).select("id", "h.*").where("n > 0")


@query("neighbour_recency", f"SELECT s.node_id AS id, max(s.created_at) AS last_edge, count(DISTINCT s.other_id) AS n_neighbours FROM {SYM.format('edges')} s JOIN {LIVE} n ON n.id = s.node_id WHERE n.node_type = 'PERSON' GROUP BY 1")
def neighbour_recency(spark, d):
    own = lk.live(t(spark, d, "nodes")).where("node_type = 'PERSON'").select(F.col("id").alias("node_id"))
    return lk.symmetric(t(spark, d, "edges")).join(own, "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.max("created_at").alias("last_edge"), F.countDistinct("other_id").alias("n_neighbours"))
