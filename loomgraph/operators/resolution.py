"""Entity resolution on commit: which existing node a proposed one denotes, from several signals and their weighted mean.

Proposed nodes are rows (id, node_type, title, networks, created_at); so are existing ones, with properties. Candidates meet by
name keys (the whole title or an alias, letter case aside, and the first word), never pairwise; each signal is a column,
null where it could not be had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scores as sc
from loomgraph.operators.lookup import OWNER, prop, symmetric
from loomgraph.runtime import may_be_in, write_stage

# Weights of the signals and the limits of the decision.
WEIGHTS = {"exact_name": 0.95, "embedding_similarity": 0.80, "same_network": 0.15, "temporal_proximity": 0.10, "shared_relationships": 0.20, "llm_adjudication": 0.90}
EMBEDDING_FULL, MERGE_AT, CREATE_BELOW, WINDOW_DAYS = 0.92, 0.85, 0.40, 7


def aliases() -> Column:
    """Aliases of a node, stated as a JSON list or as one string."""
    raw = prop("aliases")
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull() & ~raw.startswith("["), F.array(raw)), F.array().cast("array<string>"))


def names_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("names", F.array_distinct(F.filter(F.concat(F.array("title"), aliases()), lambda x: sc.strip_spaces(x) != "")))


def _sides(proposed: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of either side with the first word of a name as key, where the other side has it as well. Equal names have equal
    first words, and a proposed node has one title: two nodes meet at one key, once."""
    word = lambda n: sc.name_form(n)["words"][0]
    rest = lambda s: (F.coalesce("networks", F.array().cast("array<string>")).alias(f"{s}_networks"), F.col("created_at").alias(f"{s}_at"))
    new = proposed.where("title is not null").select(F.col("id").alias("new_id"), "node_type", word(F.col("title")).alias("key"), sc.name_form(F.col("title")).alias("new_form"), *rest("new"))
    old = names_of(existing.where((F.col("id") != OWNER) & F.col("title").isNotNull()))
    old = old.select(F.col("id").alias("old_id"), "node_type", F.explode(F.array_distinct(F.transform("names", word))).alias("key"), F.transform("names", sc.name_form).alias("old_forms"), *rest("old"))
    old = old.join(new.select("node_type", "key").distinct(), ["node_type", "key"], "left_semi")
    return new, old


def _met(new: DataFrame, old: DataFrame, block: int = 500) -> DataFrame:
    """All pairs of the sides. The nodes of a key are hashed to blocks of about ``block``, and each pair of blocks is a join
    key of its own, so no task makes all pairs of a frequent word; nothing after this join moves the pairs."""
    size = new.groupBy("node_type", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("news")).join(old.groupBy("node_type", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("olds")), ["node_type", "key"])
    place = lambda i, n: F.pmod(F.hash(i), F.col(n)).alias(f"of_{n}")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(f"of_{n}")
    left = new.join(size, ["node_type", "key"]).select(*new.columns, place("new_id", "news"), every("olds"))
    right = old.join(size, ["node_type", "key"]).select(*old.columns, every("news"), place("old_id", "olds"))
    key, n = ["node_type", "key", "of_news", "of_olds"], int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *key).join(right.repartition(n, *key), key).where("new_id <> old_id")


def _exact_name() -> Column:
    return F.array_max(F.transform("old_forms", lambda n: sc.form_similarity(F.col("new_form"), n)))


def candidates(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, old_id, exact_name): nodes of one type that share a whole name or the first word of one, with the best name
    similarity over the title of the new and the title and aliases of the old. The owner is never a candidate."""
    return _met(*_sides(proposed, existing)).select("new_id", "old_id", _exact_name().alias("exact_name"))


def embedding_score(score: Column) -> Column:
    """A similarity counts in full from EMBEDDING_FULL on, else by half."""
    return F.when(score >= EMBEDDING_FULL, score).otherwise(score * 0.5)


def temporal_score(a: Column, b: Column) -> Column:
    days = F.abs(F.floor(sc.days_between(a, b)))
    return F.when(a.isNull() | b.isNull(), 0.0).when(days <= WINDOW_DAYS, 1 - days / WINDOW_DAYS).otherwise(0.0)


def _ends(edges: DataFrame) -> DataFrame:
    return symmetric(edges).select("node_id", "other_id").where("node_id is not null and other_id is not null and node_id <> other_id")


def _near(edges: DataFrame) -> DataFrame:
    return _ends(edges).distinct()


def shared_relationships(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(new_id, old_id, shared): the share of the new node's neighbours that are the old one's as well, 0 without any.
    Neighbours of the new node are opened, those of the old one only looked up."""
    near = _near(edges)
    opened = pairs.select("new_id", "old_id").join(near.select(F.col("node_id").alias("new_id"), "other_id"), "new_id")
    hit = near.select(F.col("node_id").alias("old_id"), "other_id", F.lit(1).alias("hit"))
    return opened.join(hit, ["old_id", "other_id"], "left").groupBy("new_id", "old_id").agg((F.count("hit") / F.count("*")).alias("shared"))


def _with_neighbours(new: DataFrame, old: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides with the neighbours that both have at a key, as arrays (new_near, old_near), and the number of all neighbours
    of the new node (n_near)."""
    ids = new.select(F.col("new_id").alias("node_id")).unionByName(old.select(F.col("old_id").alias("node_id"))).distinct()
    # few nodes meet another, so few edges are moved at all; a semi join would be planned before the filter
    near = write_stage(may_be_in(_ends(edges), "node_id", ids).join(ids, "node_id").distinct(), "resolution-near").df
    at = ["node_type", "key", "other_id"]
    of_new = new.select("new_id", "node_type", "key").join(near.withColumnRenamed("node_id", "new_id"), "new_id")
    of_old = old.select("old_id", "node_type", "key").join(near.withColumnRenamed("node_id", "old_id"), "old_id")
    both = of_new.select(*at).distinct().join(of_old.select(*at).distinct(), at).withColumn("both", F.lit(True))
    new_near = of_new.join(both, at, "left").groupBy("new_id").agg(F.count("*").alias("n_near"), F.collect_list(F.when(F.col("both"), F.col("other_id"))).alias("new_near"))
    old_near = of_old.join(both, at, "left_semi").groupBy("old_id", "node_type", "key").agg(F.collect_list("other_id").alias("old_near"))
    return new.join(new_near, "new_id", "left"), old.join(old_near, ["old_id", "node_type", "key"], "left")


def signals(proposed: DataFrame, existing: DataFrame, edges: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Candidates with all signals. ``similar`` (new_id, old_id, score) holds vector hits, where there are vectors."""
    networks, days = sc.overlap_share(F.col("new_networks"), F.col("old_networks")).alias("same_network"), temporal_score(F.col("new_at"), F.col("old_at")).alias("temporal_proximity")
    if similar is None:
        # most pairs share no neighbour: for them one array or the other is empty or null
        share = F.when((F.size("new_near") > 0) & (F.size("old_near") > 0), F.size(F.array_intersect("new_near", "old_near")) / F.col("n_near")).otherwise(0.0)
        new, old = (write_stage(s, "resolution-side").df for s in _sides(proposed, existing))
        met = _met(*_with_neighbours(new, old, edges))
        return met.select("new_id", "old_id", _exact_name().alias("exact_name"), embedding_score(F.lit(0.0)).alias("embedding_similarity"), networks, days, share.alias("shared_relationships"))
    c = candidates(proposed, existing).join(similar.select("new_id", "old_id", "score"), ["new_id", "old_id"], "full").withColumn("exact_name", F.coalesce("exact_name", F.lit(0.0)))
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.coalesce("networks", F.array().cast("array<string>")).alias(f"{s}_networks"), F.col("created_at").alias(f"{s}_at"))
    j = c.join(side(proposed, "new"), "new_id").join(side(existing, "old"), "old_id")
    j = j.join(shared_relationships(c, edges), ["new_id", "old_id"], "left")
    return j.select("new_id", "old_id", "exact_name", embedding_score(F.coalesce("score", F.lit(0.0))).alias("embedding_similarity"), networks, days, F.coalesce("shared", F.lit(0.0)).alias("shared_relationships"))


def combined(rows: DataFrame) -> DataFrame:
    """Signals with their weighted mean; the same name alone makes it 1."""
    present = {k: (F.col(k), w) for k, w in WEIGHTS.items() if k in rows.columns}
    return rows.withColumn("combined", F.when(F.col("exact_name") >= 1, 1.0).otherwise(sc.weighted_present(present)))


def decisions(proposed: DataFrame, scored: DataFrame) -> DataFrame:
    """(new_id, old_id, combined, outcome) for every proposed node: merge into the best candidate, defer, or create."""
    # the best of each task before anything is shuffled
    best = scored.groupBy("new_id").agg(F.min(F.struct((-F.round("combined", 9)).alias("order"), "old_id", "combined")).alias("best")).select("new_id", "best.old_id", "best.combined")
    outcome = F.when(F.col("combined") >= MERGE_AT, "merge").when(F.col("combined") >= CREATE_BELOW, "defer").otherwise("create")
    return proposed.select(F.col("id").alias("new_id")).join(best, "new_id", "left").select("new_id", F.when(outcome != "create", F.col("old_id")).alias("old_id"), "combined", outcome.alias("outcome"))
