"""Scores as Column expressions: relevance decay, ties, urgency, names, review intervals, text signals."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay rate of each network, half-life factors, and the shares of the tie score.
NETWORK_DECAY = {"ACADEMIC": 0.05, "PROFESSIONAL": 0.03, "FINANCIAL": 0.02, "HEALTH": 0.05, "PERSONAL_GROWTH": 0.04, "SOCIAL": 0.07, "VENTURES": 0.03, "GOVERNANCE": 0.04, "CLUBS": 0.04}
DEFAULT_DECAY = 0.01
HALF_LIFE_DAYS, LN2 = 35.0, 0.693
# The property that holds a type's date, the statuses that keep a node fresh, and how much an edge type ties.
DATE_FIELDS = {"EVENT": "event_date", "COMMITMENT": "due_date", "DECISION": "decision_date", "GOAL": "target_date", "PROJECT": "target_date", "PERSON": "last_interaction"}
ACTIVE_STATUSES = {"COMMITMENT": ("open",), "GOAL": ("active",), "PROJECT": ("active",)}
TIE_SHARES = {
    "COLLABORATES_WITH": 1.0,
    "REPORTS_TO": 0.9,
    "COMMITTED_TO": 0.85,
    "RESPONSIBLE_FOR": 0.8,
    "DECIDED": 0.75,
    "INTRODUCED_BY": 0.7,
    "KNOWS": 0.6,
    "RELATED_TO": 0.5,
    "BRIDGES": 0.5,
    "MEMBER_OF": 0.45,
    "PART_OF": 0.4,
    "SIMILAR_TO": 0.35,
    "DERIVED_FROM": 0.3,
}
DEFAULT_TIE_SHARE = 0.3
#: An ISO date, or date and time with or without an offset.
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"
#: All characters of the category Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def lookup(values: Mapping[str, float], key: Column, default: float | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), F.lit(default)) if default is not None else F.try_element_at(m, key)


def micros(at: Column) -> Column:
    """Microseconds since 1970, for timestamps with or without a zone."""
    return F.unix_micros(at.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with fractions."""
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000)


def decay(anchor: Column, as_of: Column, rate: Column, access_count: Column) -> Column:
    """exp(-rate / (1 + ln(1 + accesses)) * days since the anchor); a future anchor gives 1."""
    slowed = rate / (1 + F.log1p(F.coalesce(access_count, F.lit(0))))
    return F.exp(-slowed * F.greatest(F.lit(0.0), days_between(as_of, anchor)))


def by_type(values: Mapping[str, Column], node_type: str = "node_type") -> Column:
    return F.coalesce(*(F.when(F.col(node_type) == k, v) for k, v in values.items()))


def iso_instant(value: Column) -> Column:
    """The instant of an ISO text, UTC if it names no offset, else null."""
    text = F.trim(value)
    return F.when(text.rlike(ISO), text.try_cast("timestamp"))


def relevance(as_of: Column) -> Column:
    """Relevance of a node: 1 while its status keeps it active or its own date lies ahead, else the decay since the latest
    of last access, own date and creation, at the rate of its first known network."""
    status = F.lower(F.get_json_object("properties", "$.status"))
    active = reduce(Column.__or__, ((F.col("node_type") == k) & status.isin(*v) for k, v in ACTIVE_STATUSES.items()))
    own = iso_instant(by_type({k: F.get_json_object("properties", f"$.{v}") for k, v in DATE_FIELDS.items()}))
    known = F.filter("networks", lambda n: n.isin(*NETWORK_DECAY))
    rate = lookup(NETWORK_DECAY, F.coalesce(F.get(known, F.lit(0)), F.lit("")), DEFAULT_DECAY)
    anchor = F.greatest(F.col("last_accessed").cast("timestamp"), own, F.col("created_at").cast("timestamp"))
    return F.when(F.coalesce(active, F.lit(False)) | F.coalesce(own > as_of, F.lit(False)), 1.0).otherwise(decay(anchor, as_of, rate, F.col("access_count")))


def recency(updated_at: Column, as_of: Column) -> Column:
    return F.coalesce(F.exp(-LN2 * F.greatest(F.lit(0.0), days_between(as_of, updated_at)) / HALF_LIFE_DAYS), F.lit(0.0))


def shared_score(n: Column) -> Column:
    return F.log(1.0 + F.least(n, F.lit(5))) / F.log(F.lit(6.0))


def tie_strength(weight: Column, confidence: Column, type_share: Column, recent: Column, n_shared: Column) -> Column:
    s = 0.25 * F.least(weight, F.lit(1.0)) + 0.15 * F.least(confidence, F.lit(1.0)) + 0.20 * type_share + 0.25 * recent + 0.15 * shared_score(n_shared)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def urgency(days_left: Column) -> Column:
    """Logistic in the days left; 0.3 without a day."""
    return F.coalesce(1 / (1 + F.exp(days_left / 3.0)), F.lit(0.3))


def due_bucket(days_left: Column) -> Column:
    return (
        F.when(days_left.isNull(), "undated").when(days_left < 0, "overdue").when(days_left < 1, "today").when(days_left < 2, "tomorrow")
        .when(days_left <= 7, "week").when(days_left <= 14, "fortnight").when(days_left <= 30, "month").otherwise("later")
    )


def tightest_window(days_left: Column, windows: tuple[int, ...] = (1, 3, 7)) -> Column:
    first, *rest = windows
    out = F.when(days_left <= first, first)
    for w in rest:
        out = out.when(days_left <= w, w)
    return F.when(days_left >= 0, out)


def strip_spaces(text: Column) -> Column:
    """Without the space characters (category Zs) at either end; F.trim knows only U+0020."""
    return F.btrim(text, F.lit(SPACES))


def name_form(name: Column) -> Column:
    """What names are compared by: struct(text, words)."""
    text = strip_spaces(F.lower(name))
    return F.struct(text.alias("text"), F.split(text, r"\s+").alias("words"))


def form_similarity(a: Column, b: Column) -> Column:
    """``name_similarity`` of two forms."""
    x, y, wx, wy = a["text"], b["text"], a["words"], b["words"]
    first = (wx[0] == wy[0]) & ((F.size(wx) == 1) != (F.size(wy) == 1))
    share = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    contained = F.contains(x, y) | F.contains(y, x)
    jaccard = F.size(F.array_intersect(wx, wy)) / F.size(F.array_union(wx, wy))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(first, 0.85).when(contained, F.greatest(F.lit(0.7), share)).otherwise(0.6 * jaccard)


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal; 0.85 if one is a single word and the other begins with it; for containment the share of lengths, 0.7 at
    least; else 0.6 of the words' Jaccard index. An empty name is like none."""
    return form_similarity(name_form(a), name_form(b))


def overlap_share(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def weighted_present(signals: Mapping[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the signals that are present; a null signal doesn't count, a zero does."""
    total = reduce(Column.__add__, (F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals.values()))
    value = reduce(Column.__add__, (F.coalesce(s * w, F.lit(0.0)) for s, w in signals.values()))
    return F.when(total > 0, value / total)


def review_fold(reviews: Column) -> Column:
    """Spaced repetition over an array of qualities (0 to 5) in order: struct(repetitions, interval_days, easiness).

    Below 3 a review starts again; the first two intervals are 1 and 6 days, later ones grow by the easiness.
    """
    start = F.struct(F.lit(0).alias("repetitions"), F.lit(0).cast("long").alias("interval_days"), F.lit(2.5).alias("easiness"))

    def step(s: Column, q: Column) -> Column:
        easy = F.greatest(F.lit(1.3), s["easiness"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        reps = F.when(q < 3, 0).otherwise(s["repetitions"] + 1)
        days = F.when((q < 3) | (s["repetitions"] == 0), F.lit(1)).when(s["repetitions"] == 1, F.lit(6)).otherwise(F.round(s["interval_days"] * s["easiness"]).cast("long"))
        return F.struct(reps.cast("int").alias("repetitions"), days.cast("long").alias("interval_days"), easy.alias("easiness"))

    return F.aggregate(reviews, start, step)


def ascii_language(text: Column) -> Column:
    """'en' if more than nine tenths of the characters are ASCII, else 'und'."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.when(F.length(text) == 0, "und").when(plain / F.length(text) > 0.9, "en").otherwise("und")


def money(text: Column) -> Column:
    """Amounts written with a dollar sign."""
    return F.regexp_extract_all(text, F.lit(r"(\$[0-9][0-9,]*(?:\.[0-9]+)?)"), 1)


def capitalised(text: Column) -> Column:
    """Words that begin with a capital letter, each once, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+)\b"), 1))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
