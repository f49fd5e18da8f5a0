"""Time-ordered operators: activity bursts, anomalies, sequences, concurrency, sessions, as-of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scores import micros
from loomgraph.runtime import ship_package


def daily_counts(rows: DataFrame, at: str = "created_at") -> DataFrame:
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def burst_windows(days: DataFrame, width: int, factor: float) -> DataFrame:
    """Windows of ``width`` active days that hold more than ``factor`` times their share, taken greedily from the first
    day on, none overlapping. ``days`` (day, n) has one row for each calendar day, so one task can walk it."""
    ordered = Window.orderBy("day")
    frame = ordered.rowsBetween(0, width - 1)
    ahead = days.select("day", F.row_number().over(ordered).alias("pos"), F.sum("n").over(frame).alias("total"), F.max("day").over(frame).alias("last_day"), F.count("*").over(frame).alias("length"))
    mean = days.agg((F.sum("n") / F.count("*")).alias("mean"))
    hot = ahead.crossJoin(F.broadcast(mean)).where((F.col("length") == width) & (F.col("total") / width > F.col("mean") * factor))
    ship_package(days.sparkSession)

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0
        for b in batches:
            keep = []
            for r in b.itertuples():
                keep.append(r.pos >= free)
                if r.pos >= free:
                    free = r.pos + width
            yield b[keep]

    return hot.select("day", "last_day", "total", "pos").coalesce(1).sortWithinPartitions("pos").mapInPandas(greedy, "day date, last_day date, total long, pos int").drop("pos")


def anomalous_days(days: DataFrame, sigmas: float = 2.0, least: int = 3) -> DataFrame:
    """Days above mean + sigmas * population deviation, and above ``least``."""
    m = days.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))
    return days.crossJoin(F.broadcast(m)).where((F.col("n") > F.col("mean") + sigmas * F.col("deviation")) & (F.col("n") > least)).select("day", "n", F.round((F.col("n") - F.col("mean")) / F.col("deviation"), 6).alias("score"))


def recent_against_prior(rows: DataFrame, key: str, at: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days and of as many before them, by key."""
    now, start, before = F.lit(as_of).cast("timestamp"), F.expr(f"timestamp'{as_of}' - interval {days} days"), F.expr(f"timestamp'{as_of}' - interval {2 * days} days")
    t = F.col(at)
    return rows.where((t >= before) & (t < now)).groupBy(key).agg(F.count_if(t >= start).alias("recent"), F.count_if(t < start).alias("prior"))


def concurrent(anchors: DataFrame, rows: DataFrame, hours: int) -> DataFrame:
    """(anchor_id, id) of rows within ``hours`` of an anchor that share none of its networks.

    A range join as an equi-join: time is cut into buckets as wide as the window, and an anchor looks into three.
    """
    width = hours * 3600
    bucket = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / width)
    a = anchors.select(F.col("id").alias("anchor_id"), F.col("created_at").alias("anchor_at"), F.coalesce("networks", F.array()).alias("anchor_networks"), F.explode(F.sequence(bucket(F.col("created_at")) - 1, bucket(F.col("created_at")) + 1)).alias("bucket"))
    b = rows.select("id", "created_at", F.coalesce("networks", F.array().cast("array<string>")).alias("networks"), bucket(F.col("created_at")).alias("bucket"))
    near = F.abs(micros(F.col("created_at")) - micros(F.col("anchor_at"))) <= F.lit(width).cast("long") * 1_000_000
    return b.join(a, "bucket").where(near & (F.col("id") != F.col("anchor_id")) & ~F.coalesce(F.arrays_overlap("networks", "anchor_networks"), F.lit(False))).select("anchor_id", "id")


def sessions(events: DataFrame, user: str, at: str, gap_minutes: int) -> DataFrame:
    """(user, session, start, end, n) of runs of events with gaps up to ``gap_minutes``."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    fresh = (micros(F.col(at)) - micros(F.lag(at).over(w)) > gap_minutes * 60_000_000).cast("int")
    marked = events.withColumn("fresh", F.coalesce(fresh, F.lit(1)))
    numbered = marked.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of right (key, at, value) not later than it: one shuffle on the key, both
    sides in one ordered stream, the last value carried forward. At equal times the right row comes first."""
    both = left.select(key, at, F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("seen")).unionByName(
        right.select(key, at, F.lit(0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns)).dtypes[0][1]).alias("row"), F.col(value).alias("seen"))
    )
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of_value", F.last("seen", ignorenulls=True).over(w)).where("side = 1").select("row.*", "as_of_value")
