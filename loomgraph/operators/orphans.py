"""References to records that do not exist: an incremental ledger of pending orphans.

State, in written tables of the shared folder, each a list of deltas that are only ever added to:

* the index of parents (id, created_at, deleted), by bucket of the id;
* the references themselves, by bucket of the id they refer to;
* the log of orphans: a row whenever the standing of a reference changes (missing, deleted, late, or null: in order).

``advance`` takes the new references and the arriving parent rows of one increment. A new reference probes the index, the
arriving parents included. Arriving parents are met with the pending orphans that wait for them or are late: both are judged
again, as a parent may be stated again with an earlier time. A parent that is newly deleted reopens the references to it,
which are read again from the buckets of such parents only. Each increment writes what changed and a snapshot of the open
orphans for each table, field, reason and month; no state is written anew. Deltas of the index are merged into one after
COMPACT_AFTER of them.

Each step is one equi-join on the referenced id. The few most frequent ids (the owner's node holds a tenth of all
edges) are joined apart, against a broadcast of as many parent rows, so no task gathers them.

Defined cases: a null reference is none; a row delivered again counts once; a reference without a time is never late;
a parent stated more than once exists from its first created_at and is deleted if any row says so; empty tables work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import Stage, hot_keys, split_hot_join, write_stage

BUCKETS, COMPACT_AFTER = 16, 8
REF_KEY = ["table_name", "record_id", "field_name"]
REF_COLUMNS = ["table_name", "record_id", "field_name", "parent_table", "ref_id", "ref_at"]


def references(edges: DataFrame, facts: DataFrame, checks: DataFrame) -> DataFrame:
    """All references in long form, one row each; a re-delivered row is the same reference again."""

    def of(df: DataFrame, name: str, fields: list[str], at: str, parent: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("ref_id")) for f in fields)))
        long = df.select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.col(at).alias("ref_at"), pairs.alias("p"))
        return long.select("table_name", "record_id", "p.field_name", F.lit(parent).alias("parent_table"), "p.ref_id", "ref_at").where(F.col("ref_id").isNotNull())

    return reduce(
        DataFrame.unionByName,
        [of(edges, "edges", ["source_id", "target_id"], "created_at", "nodes"), of(facts, "verified_facts", ["node_id"], "created_at", "nodes"), of(checks, "fact_checks", ["fact_id"], "checked_at", "verified_facts")],
    )


def parent_rows(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    both = nodes.select(F.lit("nodes").alias("parent_table"), F.col("id").alias("ref_id"), F.col("created_at").alias("parent_at"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return both.unionByName(facts.select(F.lit("verified_facts").alias("parent_table"), F.col("id").alias("ref_id"), F.col("created_at").alias("parent_at"), F.lit(False).alias("deleted"))).where("ref_id is not null")


def _merged(parents: DataFrame) -> DataFrame:
    return parents.groupBy("parent_table", "ref_id").agg(F.min("parent_at").alias("parent_at"), F.max("deleted").alias("deleted"))


def _reason() -> Column:
    return F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("parent_at") > F.col("ref_at"), "late")


def _probe(refs: DataFrame, index: DataFrame, hot: list, also: list | None = None) -> DataFrame:
    """``refs`` with their reason, null if the parent is in order, and the columns ``also``. The two parent tables share one
    join by a keyed id."""
    key = F.concat_ws(":", "parent_table", "ref_id")
    r = refs.withColumn("key", key)
    return split_hot_join(r, index.select(key.alias("key"), "parent_at", "deleted"), "key", hot).select(*REF_COLUMNS, *(also or []), _reason().alias("reason"))


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("parent_table", "ref_id"), F.lit(BUCKETS)).cast("int"))


class Deltas:
    """A table as a list of written parts, each partitioned by bucket: parts are added, and read by bucket."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType):
        self.spark, self.name, self.schema, self.parts = spark, name, schema, []

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part and give it back."""
        part = write_stage(_bucketed(df.select(*self.schema.names)).repartition(BUCKETS, "bucket"), self.name, partition_by="bucket")
        self.parts.append(part)
        return part.df

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All parts; with ``buckets`` only their folders."""
        out = [p.df if buckets is None else p.df.where(F.col("bucket").isin(buckets)) for p in self.parts]
        return reduce(DataFrame.unionByName, out).select(*self.schema.names) if out else self.spark.createDataFrame([], self.schema)

    def compact(self, merged: DataFrame) -> None:
        """One part instead of all: ``merged`` holds what they say."""
        old = list(self.parts)
        self.parts = []
        self.add(merged)
        for p in old:
            p.drop()


def _buckets(df: DataFrame) -> list[int]:
    """Buckets of the parents that the rows name: BUCKETS numbers at most."""
    return sorted(r["bucket"] for r in _bucketed(df.select("parent_table", "ref_id")).select("bucket").distinct().collect())


class OrphanLedger:
    """The pending orphans after the increments so far."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number = spark, 0
        self.index = Deltas(spark, "orphan-index", T.StructType.fromDDL("parent_table string, ref_id string, parent_at timestamp, deleted boolean"))
        self.refs = Deltas(spark, "orphan-refs", T.StructType.fromDDL("table_name string, record_id string, field_name string, parent_table string, ref_id string, ref_at timestamp"))
        self.log: list[Stage] = []
        self.snapshots: list[Stage] = []

    @property
    def orphans(self) -> DataFrame:
        """REF_COLUMNS and reason of the open orphans: the last word of the log on each reference."""
        if not self.log:
            return self.refs.read().withColumn("reason", F.lit(None).cast("string")).where(F.lit(False))
        rows = reduce(DataFrame.unionByName, (s.df for s in self.log))
        last = rows.groupBy(*REF_KEY).agg(F.max_by(F.struct("parent_table", "ref_id", "ref_at", "reason"), "increment").alias("last"))
        return last.select(*REF_KEY, "last.*").where("reason is not null")

    def advance(self, new_refs: DataFrame, arriving: DataFrame) -> OrphanLedger:
        timed = lambda df, at: df.withColumn(at, F.col(at).cast("timestamp"))
        came = write_stage(_merged(timed(arriving, "parent_at")), "orphan-came").df
        came_in = _buckets(came)
        # who is deleted now and wasn't: only their references are read again, from their buckets
        gone = came.where("deleted").select("parent_table", "ref_id")
        if self.index.parts:
            gone = gone.join(self.index.read(came_in).where("deleted").select("parent_table", "ref_id").distinct(), ["parent_table", "ref_id"], "left_anti")
            gone = write_stage(gone, "orphan-gone").df
        changes = []
        if self.refs.parts:
            earlier = self.refs.read(_buckets(gone))
            changes.append(earlier.join(gone, ["parent_table", "ref_id"], "left_semi").dropDuplicates(REF_KEY).select(*REF_COLUMNS, F.lit("deleted").alias("reason")))
            pending = self.orphans.where("reason <> 'deleted'").join(came.select("parent_table", "ref_id"), ["parent_table", "ref_id"], "left_semi").join(gone, ["parent_table", "ref_id"], "left_anti")
            pending = write_stage(pending.select(*REF_COLUMNS, F.col("reason").alias("before")), "orphan-pending").df
        self.index.add(came)
        own = self.refs.add(timed(new_refs, "ref_at").dropDuplicates(REF_KEY))
        hot = hot_keys(own.select(F.concat_ws(":", "parent_table", "ref_id").alias("key")), "key")
        fresh = _probe(own, _merged(self.index.read(_buckets(own))), hot).where("reason is not null")
        if self.number:
            judged = _probe(pending, _merged(self.index.read(came_in)), [], ["before"])
            changes.append(judged.where(~F.col("reason").eqNullSafe(F.col("before"))).select(*REF_COLUMNS, "reason"))
        self.number += 1
        self.log.append(write_stage(reduce(DataFrame.unionByName, changes, fresh).withColumn("increment", F.lit(self.number)), "orphan-log"))
        self.snapshots.append(write_stage(self.snapshot().withColumn("increment", F.lit(self.number)), "orphan-snapshot"))
        # only now, when nothing above reads the parts any more
        if len(self.index.parts) > COMPACT_AFTER:
            self.index.compact(_merged(self.index.read()))
        return self

    def snapshot(self) -> DataFrame:
        """Open orphans for each table, field, reason and month of the reference."""
        return self.orphans.groupBy("table_name", "field_name", "reason", F.date_format("ref_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_orphans"))

    def history(self) -> DataFrame:
        """The snapshots of all increments."""
        return reduce(DataFrame.unionByName, (s.df for s in self.snapshots))


def run_ledger(refs: DataFrame, parents: DataFrame, cuts: list) -> OrphanLedger:
    """Advance through the increments between ``cuts`` (rows without a time come first). A row of the parents counts
    when it is created; a deletion, whose time isn't recorded, comes with its row."""
    ledger = OrphanLedger(refs.sparkSession)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):

        def within(df: DataFrame, at: str, low=low, high=high) -> DataFrame:
            keep = F.lit(True)
            if low is not None:
                keep = keep & (F.col(at) >= F.lit(low))
            if high is not None:
                keep = keep & (F.col(at) < F.lit(high))
            return df.where(F.coalesce(keep, F.lit(low is None)))

        ledger.advance(within(refs, "ref_at"), within(parents, "parent_at"))
    return ledger


def found(ledger: OrphanLedger) -> DataFrame:
    return ledger.orphans.select(*REF_KEY, "reason")
