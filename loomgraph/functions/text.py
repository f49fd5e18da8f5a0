"""Short texts as Column expressions: what a question is about, what it asks for, and what must not leave the house."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no name or focus, marks of intents with their weights, and patterns of private details.
NO_NAMES = ("What", "How", "Who", "Where", "When", "Why", "Which", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can", "Could", "Should", "Would", "Will", "The", "A", "An", "My", "His", "Her", "Their", "Our", "Its", "That", "This", "Tell", "Show", "Give", "Get", "Has", "Have", "Had")
NO_FOCUS = ("what", "how", "who", "where", "when", "why", "which", "is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "would", "will", "the", "a", "an", "of", "in", "on", "for", "to", "with", "about", "from", "my", "his", "her", "their", "our", "its", "that", "this", "tell", "show", "give", "get", "has", "have", "had", "me", "i", "you", "we", "they", "he", "she", "it")
QUESTION_WORDS = ("what", "how", "who", "where", "when", "why", "which", "does", "do", "is", "are", "can", "has", "have")
FOCUS_WORDS = ("status", "investigation", "commitment", "commitments", "decision", "decisions", "goal", "goals", "progress", "outcome", "outcomes", "pattern", "patterns", "responsible", "working", "involved", "budget", "timeline", "deadline", "project", "projects", "task", "tasks", "role", "plan", "plans")
SIGNALS = {
    "council": (2.0, ("complex decision", "weigh options", "major decision", "all things considered", "comprehensive analysis", "help me decide", "big picture")),
    "analysis": (1.5, ("analyze", "recommend", "prioritize", "assess", "evaluate", "should i", "what should", "how am i doing", "status", "health of", "progress on", "summary of", "briefing")),
    "research": (1.5, ("how does", "explain", "look up", "search for", "find information", "research", "what are the latest", "is it true", "fact check")),
    "capture": (1.0, ("i did", "i met", "i went", "i bought", "i decided", "i learned", "i read", "i heard", "happened today", "note to self", "remember that", "i promised", "i owe")),
}
ABOUT_STATE = ("status", "progress", "health", "state of")
PRIVATE = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ""),
    (r"\b(?:\+?1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b", ""),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", ""),
    (r"\$[0-9,]+(?:\.[0-9]{2})?(?:\s*(?:k|K|million|billion|M|B))?", "a sum of money"),
    (r"(?i)\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s+[0-9]{4})\b", "recently"),
)


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def entity_names(query: Column) -> Column:
    """Capitalised words that are likely names, without punctuation and possessive, in order."""
    clean = F.transform(F.split(query, r"(?U)\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"""[.,;:!?'"]+$""", ""), "['’]s$", ""))
    return F.filter(clean, lambda w: w.rlike(r"^\p{Lu}.") & ~F.array_contains(_words(NO_NAMES), w))


def question_focus(query: Column) -> Column:
    """The words of a question that are neither function words nor names, null if none is left."""
    text = F.regexp_replace(F.lower(F.trim(F.regexp_replace(query, r"[?!.]+$", ""))), "['’]s\\b", "")
    names = F.transform(entity_names(query), F.lower)
    left = F.filter(F.split(text, r"(?U)\s+"), lambda w: (w != "") & ~F.array_contains(_words(NO_FOCUS), w) & ~F.array_contains(names, w))
    return F.nullif(F.array_join(left, " "), F.lit(""))


def dossier_intent(query: Column) -> Column:
    """'explore', 'profile' or 'question': what a question about entities wants."""
    words = F.split(F.lower(query), r"(?U)\s+")
    asks = F.arrays_overlap(words, _words(QUESTION_WORDS)) | F.contains(query, F.lit("?"))
    explore = query.rlike(r"(?i)\bpath\s+between\b|\bconnections?\s+between\b|\bhow\s+(?:are|is)\s+\w+\s+(?:and|&)\s+\w+\s+(?:connected|related|linked)\b")
    profile = query.rlike(r"(?i)^(?:who\s+is\b|tell\s+me\s+about\b|show\s+me\b|details?\s+(?:on|for|about)\b)")
    question = (asks & F.arrays_overlap(words, _words(FOCUS_WORDS))) | (F.contains(query, F.lit("?")) & question_focus(query).isNotNull())
    return F.when(explore, "explore").when(profile, "profile").when(question, "question").otherwise("profile")


def _sum(query: Column, kind: str) -> Column:
    weight, marks = SIGNALS[kind]
    return reduce(Column.__add__, (F.when(F.contains(query, F.lit(m)), weight).otherwise(0.0) for m in marks))


def query_kind(query: Column) -> Column:
    """'capture', 'research', 'analysis' or 'council': the kind whose marks weigh most; analysis without any."""
    q = F.lower(query)
    what_is, state = F.contains(q, F.lit("what is")), reduce(Column.__or__, (F.contains(q, F.lit(w)) for w in ABOUT_STATE))
    compare = F.when(F.contains(q, F.lit("compare")), 0.5).otherwise(0.0)
    research = _sum(q, "research") + F.when(what_is & ~state, 1.5).otherwise(0.0) + compare
    analysis = _sum(q, "analysis") + F.when(what_is & state, 1.5).otherwise(0.0) + compare
    capture = _sum(q, "capture") * F.when(analysis > 0, 0.5).otherwise(1.0)
    analysis = analysis + F.when((analysis > 0) & (analysis == research), 0.1).otherwise(0.0)
    council = _sum(q, "council")
    top = F.greatest(capture, research, analysis, council)
    return F.when(top == 0, "analysis").when(top == capture, "capture").when(top == research, "research").when(top == analysis, "analysis").otherwise("council")


def without_private(text: Column) -> Column:
    """A query fit to be sent out: addresses, numbers, sums and dates gone or made general."""
    out = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), PRIVATE, text)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def search_phrase(name: Column, organisation: Column, role: Column) -> Column:
    """A person's name and organisation, or else role, in quotes."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" ", quoted(F.coalesce(name, F.lit(""))), quoted(F.coalesce(blank(organisation), blank(role))), F.lit("LinkedIn"))


def profile_of(title: Column) -> Column:
    """struct(role, organisation) of a page title 'Name - Role at Organisation'."""
    rest = F.trim(F.regexp_extract(title, r"^[^-–|]+[-–|]\s*([^|–]+)", 1))
    has = F.contains(rest, F.lit(" at "))
    return F.struct(F.nullif(F.when(has, F.substring_index(rest, " at ", 1)).otherwise(rest), F.lit("")).alias("role"), F.when(has, F.trim(F.regexp_extract(rest, r" at (.+)$", 1))).alias("organisation"))
