"""Composite views of the graph: profiles, comparisons, captures' inner links, reachability, text signals."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.operators.lookup import distinct_edges, live, prop, symmetric
from loomgraph.runtime import ship_package


def profile(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each seed (id): neighbours, strongest neighbour, edge types, facts and mean confidence of them.

    Each part is aggregated by the seed before the join, so no part multiplies another.
    """
    own = seeds.select("id").distinct()
    near = symmetric(distinct_edges(edges)).join(own.withColumnRenamed("id", "node_id"), "node_id", "left_semi").join(live(nodes).select(F.col("id").alias("other_id")), "other_id", "left_semi")
    links = near.groupBy(F.col("node_id").alias("id")).agg(
        F.countDistinct("other_id").alias("n_neighbours"), F.countDistinct(F.upper("edge_type")).alias("n_edge_types"), F.max_by("other_id", F.struct(F.coalesce("weight", F.lit(-1.0)), "other_id")).alias("strongest")
    )
    stated = facts.dropDuplicates(["id"]).join(own.withColumnRenamed("id", "node_id"), "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_facts"), F.round(F.avg("confidence"), 6).alias("fact_confidence"))
    return own.join(links, "id", "left").join(stated, "id", "left").select("id", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), F.coalesce("n_edge_types", F.lit(0)).alias("n_edge_types"), "strongest", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "fact_confidence")


def compare(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, shared, only_a, only_b): sizes of the neighbours of both, of one and of the other.

    Only the end with fewer neighbours is opened, and its neighbours are looked up among the other's; the rest are the
    differences to the ends' degrees, so a hub is never opened for each of its pairs.
    """
    near = symmetric(edges).select("node_id", "other_id").where("node_id is not null and other_id is not null").distinct()
    degree = near.groupBy("node_id").agg(F.count("*").alias("n"))
    of = lambda s: degree.select(F.col("node_id").alias(s), F.col("n").alias(f"n_{s}"))
    sized = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_a", "n_b"))).where("n_a + n_b > 0")
    smaller = F.col("n_a") <= F.col("n_b")
    ends = sized.select("a", "b", F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("many"))
    opened = ends.join(near.select(F.col("node_id").alias("few"), "other_id"), "few")
    shared = opened.join(near.select(F.col("node_id").alias("many"), "other_id"), ["many", "other_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return sized.join(shared, ["a", "b"], "left").select("a", "b", n.alias("shared"), (F.col("n_a") - n).alias("only_a"), (F.col("n_b") - n).alias("only_b"))


def context(named: DataFrame, near: DataFrame, block: int = 1000) -> DataFrame:
    """(capture_id, id): what stands next (near: id, other_id, each once) to anything that a capture names (named: capture_id,
    id), without what it names, each once.

    The neighbours of the named node that has most are written as they are joined, in blocks of about ``block`` neighbours by
    five times as many captures; those of the others are added where they don't stand next to it. So the pairs of a hub and
    the captures that name it are never shuffled.
    """
    named = named.distinct()
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    ranked = named.join(degree, "id").withColumn("r", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("degree"), "id")))
    first = ranked.where("r = 1").select("capture_id", F.col("id").alias("first"), "degree")
    inside = named.join(first.select("capture_id", "first"), "capture_id").join(near.select(F.col("id").alias("first"), F.col("other_id").alias("id")), ["first", "id"])
    skip = inside.groupBy("capture_id").agg(F.collect_list("id").alias("skip"))
    size = first.groupBy("first").agg(F.ceil(F.count("*") / (5 * block)).cast("int").alias("rows"), F.ceil(F.max("degree") / block).cast("int").alias("columns"))
    place = lambda c, n: F.pmod(F.hash(c), F.col(n)).alias(f"of_{n}")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(f"of_{n}")
    left = first.join(size, "first").join(skip, "capture_id", "left").select("first", "capture_id", "skip", place("capture_id", "rows"), every("columns"))
    right = near.withColumnRenamed("id", "first").join(size, "first").select("first", "other_id", every("rows"), place("other_id", "columns"))
    key, n = ["first", "of_rows", "of_columns"], int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = left.repartition(n, *key).join(right.repartition(n, *key), key).where(F.col("skip").isNull() | ~F.array_contains("skip", F.col("other_id"))).select("capture_id", F.col("other_id").alias("id"))
    rest = ranked.where("r > 1").select("capture_id", "id").join(near, "id").select("capture_id", F.col("other_id").alias("id")).distinct().join(named, ["capture_id", "id"], "left_anti")
    rest = rest.join(first.select("capture_id", "first"), "capture_id").join(near.select(F.col("id").alias("first"), F.col("other_id").alias("id")), ["first", "id"], "left_anti")
    return most.unionByName(rest.select("capture_id", "id"))


def unlinked_siblings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_capture_id, id): nodes of a capture with several that no edge ties to another node of that capture."""
    own = live(nodes).where("source_capture_id is not null").select("id", "source_capture_id")
    several = own.groupBy("source_capture_id").agg(F.count("*").alias("n")).where("n > 1").select("source_capture_id")
    sibling = own.join(several, "source_capture_id", "left_semi")
    e = edges.select("source_id", "target_id").where("source_id <> target_id").distinct()
    tied = e.join(sibling.select(F.col("id").alias("source_id"), F.col("source_capture_id").alias("c")), "source_id").join(sibling.select(F.col("id").alias("target_id"), F.col("source_capture_id").alias("c")), ["target_id", "c"])
    ends = tied.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return sibling.join(ends, "id", "left_anti").select("source_capture_id", "id")


def filtered_neighbourhood(reached: DataFrame, nodes: DataFrame, node_types: Sequence[str] = (), networks: Sequence[str] = ()) -> DataFrame:
    """Nodes reached (id, hop) that are live and of the types, and in any of the networks."""
    p = F.lit(True)
    if node_types:
        p = p & F.col("node_type").isin(*node_types)
    if networks:
        p = p & F.arrays_overlap("networks", F.array(*map(F.lit, networks)))
    return reached.join(live(nodes).where(p).select("id", "node_type"), "id").select("id", "hop", "node_type")


def edge_weights(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, weight): max(0, cosine) of the vectors (id, embedding) of an edge's ends, edges without both left out."""
    from loomgraph.functions.scores import cosine

    a, b = vectors.select(F.col("id").alias("source_id"), F.col("embedding").alias("x")), vectors.select(F.col("id").alias("target_id"), F.col("embedding").alias("y"))
    return edges.join(a, "source_id").join(b, "target_id").select("id", F.greatest(F.lit(0.0), cosine(F.col("x"), F.col("y"))).alias("weight"))


def hub_score(degree: Column, between: Column, rank: Column) -> Column:
    return 0.4 * degree + 0.3 * between + 0.3 * rank


def changed(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) of the fields that differ between two versions of a table, nulls as values."""
    x = before.select(F.col(key), *(F.col(f).cast("string").alias(f"old_{f}") for f in fields))
    y = after.select(F.col(key), *(F.col(f).cast("string").alias(f"new_{f}") for f in fields))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new")) for f in fields))
    return x.join(y, key).select(key, F.explode(parts).alias("c")).select(key, "c.*").where(~F.equal_null("old", "new"))


def date_references(text: Column) -> Column:
    """Relative days that a text names, lower case: today, tomorrow, yesterday, next <weekday>, in <n> days, next week,
    end of the month."""
    days = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b(today|tomorrow|yesterday|next (?:{days}|week)|in [0-9]+ days|end of the month)\b"), 1))


def first_json(text: Column) -> Column:
    """The JSON object in a model's answer: the text itself, the inside of a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.trim(c))
    return F.coalesce(ok(text), ok(F.nullif(fenced, F.lit(""))), ok(F.nullif(braces, F.lit(""))))


def ordered_notices(notices: DataFrame) -> DataFrame:
    """By priority (critical, high, medium, low, others), the newest first."""
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).when(F.col("priority") == "low", 3).otherwise(4)
    return notices.orderBy(rank, F.desc("created_at"), "id")


def stated_properties(raw: str | None) -> str | None:
    """The properties of a JSON object as 'k: v', in their order and as Python writes values; nulls are left out."""
    try:
        doc = json.loads(raw) if raw else None
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    return " ".join(f"{k}: {v}" for k, v in doc.items() if v is not None) or None


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(id, text): what stands for a node in a vector space: title, content and its properties."""
    ship_package(nodes.sparkSession)

    @F.pandas_udf(StringType())
    def stated(column: pd.Series) -> pd.Series:
        return column.map(stated_properties)

    return live(nodes).select("id", F.concat_ws(" ", "title", F.nullif(F.col("content"), F.lit("")), stated("properties")).alias("text"))


def dated(nodes: DataFrame) -> DataFrame:
    """(id, node_type, due): commitments, events and pending elections with their day."""
    from loomgraph.operators.lookup import iso_day

    day = F.coalesce(iso_day(prop("due_date")), iso_day(prop("event_date")), iso_day(prop("date")), iso_day(prop("target_date")))
    return live(nodes).where(F.col("node_type").isin("COMMITMENT", "EVENT", "GOAL", "ELECTION")).select("id", "node_type", prop("status").alias("status"), day.alias("due")).where("due is not null")


def sessions_of_edges(edges: DataFrame, gap_days: int) -> DataFrame:
    """(node_id, n_sessions, longest): runs of edges of a node with gaps up to ``gap_days``."""
    e = symmetric(distinct_edges(edges)).where("created_at is not null and node_id is not null").select("node_id", "id", "direction", F.to_date("created_at").alias("day"))
    w = Window.partitionBy("node_id").orderBy("day", "id", "direction")
    fresh = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap_days).cast("int"), F.lit(1))
    runs = e.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("node_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
