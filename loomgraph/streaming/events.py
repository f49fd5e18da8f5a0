"""Structured Streaming over the event table: filters, windows, sessions, deduplication, keyed state, sinks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.runtime import shared_dir

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of parquet files; the number of files a trigger takes is the back pressure, and nothing is dropped."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # the source takes folders and patterns, so one file is named by a pattern
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def matches(pattern: str, column: str = "event_type") -> Column:
    """'*' takes all, 'prefix.*' a family, anything else one type."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith(".*"):
        return F.col(column).startswith(pattern[:-1])
    return F.col(column) == pattern


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; state older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _watch(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts the rows of a key and the changes of its value's band; state is (rows, changes, last band)."""
    rows, changes, last = state.get if state.exists else (0, 0, "")
    parts = [b for b in batches if len(b)]
    if parts:
        for band in pd.concat(parts).sort_values(["ts", "event_id"])["band"]:
            rows, changes, last = rows + 1, changes + int(bool(last) and band != last), band
    state.update((rows, changes, last))
    yield pd.DataFrame({"user_id": [key[0]], "n_rows": [rows], "n_changes": [changes], "last_band": [last]})


def watch_changes(events: DataFrame) -> DataFrame:
    """For each user how often the band of the value changed, kept as state over the micro-batches. Rows of one user in
    one batch are taken in order of time; a user with very many rows a batch streams through in Arrow batches."""
    banded = events.select("user_id", "event_id", "ts", F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "mid").otherwise("high").alias("band"))
    out = "user_id long, n_rows long, n_changes long, last_band string"
    return banded.groupBy("user_id").applyInPandasWithState(_watch, out, "rows long, changes long, last string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and give its result as a table of the shared folder.

    Each batch is written under its number, so a batch that runs again overwrites itself (exactly once). With ``keys``
    the last batch's row of each key counts (update mode); in complete mode only the last batch counts.
    """
    spark = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/loomgraph/stream-{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode == "complete":
        return done.where(F.col("batch") == done.agg(F.max("batch").alias("b")).first()["b"]).drop("batch")
    if keys:
        rest = [c for c in done.columns if c not in (*keys, "batch")]
        return done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return done.drop("batch")


def fan_out(stream: DataFrame, routes: dict[str, tuple[str, str]], checkpoint: str) -> None:
    """Write each batch to every route whose pattern matches: {name: (pattern, path)}. A route that fails is reported
    and fails the batch, which runs again as a whole; paths are keyed by batch, so nothing is written twice."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for pattern, path in routes.values():
                batch.where(matches(pattern)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
