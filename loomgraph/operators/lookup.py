"""Point lookups, filters and paging over the graph tables: predicates only, so they reach the scan or stay in codegen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = "00000000-0000-0000-0000-000000000001"


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce("deleted", F.lit(False)))


def prop(name: str, column: str = "properties") -> Column:
    return F.get_json_object(column, f"$.{name}")


def iso_day(value: Column) -> Column:
    """The calendar day of a text that begins with an ISO date, else null."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))


@dataclass(frozen=True)
class NodeFilter:
    """Networks and tags must all be present; bounds are inclusive."""

    node_types: Sequence[str] = ()
    networks: Sequence[str] = ()
    tags: Sequence[str] = ()
    min_confidence: float | None = None
    min_decay: float | None = None
    created_after: str | None = None
    created_before: str | None = None

    def predicate(self) -> Column:
        p = F.lit(True)
        if self.node_types:
            p = p & F.col("node_type").isin(*self.node_types)
        for n in self.networks:
            p = p & F.array_contains("networks", n)
        for t in self.tags:
            p = p & F.array_contains("tags", t)
        if self.min_confidence is not None:
            p = p & (F.col("confidence") >= self.min_confidence)
        if self.min_decay is not None:
            p = p & (F.col("decay_score") >= self.min_decay)
        if self.created_after:
            p = p & (F.col("created_at") >= F.lit(self.created_after).cast("timestamp"))
        if self.created_before:
            p = p & (F.col("created_at") <= F.lit(self.created_before).cast("timestamp"))
        return p


def query_nodes(nodes: DataFrame, filters: NodeFilter, limit: int | None = None, offset: int = 0) -> DataFrame:
    found = live(nodes).where(filters.predicate())
    if limit is None:
        return found
    return found.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def nodes_by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return live(nodes).join(ids.select("id").distinct(), "id", "left_semi")


def nodes_in_range(nodes: DataFrame, start: str | None, end: str | None, any_network: Sequence[str] = (), node_types: Sequence[str] = ()) -> DataFrame:
    """Created between the bounds, in any of the networks: the other rule than NodeFilter's."""
    p = NodeFilter(node_types=node_types, created_after=start, created_before=end).predicate()
    if any_network:
        p = p & F.arrays_overlap("networks", F.array(*map(F.lit, any_network)))
    return live(nodes).where(p)


def with_effective_date(nodes: DataFrame) -> DataFrame:
    """The day that counts for a node: the one its properties state, else the day it was created."""
    stated = F.when(F.col("node_type") == "EVENT", prop("event_date")).when(F.col("node_type") == "DECISION", prop("decision_date")).when(F.col("node_type") == "COMMITMENT", prop("due_date"))
    return nodes.withColumn("effective_date", F.coalesce(iso_day(stated), F.to_date("created_at")))


def by_status(nodes: DataFrame, node_type: str, status: str) -> DataFrame:
    return live(nodes).where((F.col("node_type") == node_type) & (prop("status") == status))


def search_titles(nodes: DataFrame, text: str) -> DataFrame:
    """Title or aliases contain the text, letter case aside."""
    pattern = f"%{text}%"
    return live(nodes).where(F.col("title").ilike(pattern) | F.coalesce(prop("aliases").ilike(pattern), F.lit(False)))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node_id, other_id and direction. It turns 'source or target is x' into an equi-join."""
    out = edges.select("*", F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), F.lit("outgoing").alias("direction"))
    back = edges.select("*", F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id"), F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row for each edge id: re-delivered rows are equal in all columns."""
    return edges.dropDuplicates(["id"])


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    both = symmetric(edges)
    if direction != "both":
        both = both.where(F.col("direction") == direction)
    return both.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").drop("node_id", "other_id", "direction").dropDuplicates(["id"])


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between the two ids of each pair (a, b), in either direction."""
    ends = lambda x, y: F.array_sort(F.array(x, y))
    want = pairs.select(ends(F.col("a"), F.col("b")).alias("ends")).distinct()
    return edges.withColumn("ends", ends(F.col("source_id"), F.col("target_id"))).join(want, "ends", "left_semi").drop("ends")


def latest(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key without a sort of the whole: max_by over the row's struct."""
    columns = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(*key, "row.*")
