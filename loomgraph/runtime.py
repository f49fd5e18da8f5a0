"""Session helpers: reading tables, the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error, because a
    folder of one machine would be lost with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomgraph-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Stage:
    """A table written to the shared folder: it cuts lineage, survives the loss of executors and can be dropped."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        # with the schema at hand no job reads footers for it, and a table without files is an empty one
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _where(self) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def uri(self) -> str:
        """The folder with its scheme, for tasks that read its files themselves."""
        fs, where = self._where()
        return fs.makeQualified(where).toString()

    def drop(self) -> None:
        fs, where = self._where()
        fs.delete(where, True)


def write_stage(df: DataFrame, name: str, partitions: int | None = None, partition_by: str | None = None) -> Stage:
    """Write ``df`` below the shared folder. ``partitions`` coalesces (no shuffle) to avoid many tiny files;
    ``partition_by`` makes a folder for each value of a column, so that a filter on it reads only those."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return Stage(spark, path, out.schema)


def drop_stages(spark: SparkSession) -> None:
    """Delete all written stages below the shared folder: for the end of a job, when no result is read any more."""
    Stage(spark, f"{shared_dir(spark)}/loomgraph", StructType()).drop()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if it isn't installed on the executors."""
    import sys

    if PACKAGE_ROOT not in sys.path:
        sys.path.insert(0, PACKAGE_ROOT)
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    # workers of a local session have the driver's environment, not its sys.path, so they need the package as well
    import shutil

    stem = tempfile.mkdtemp(prefix="loomgraph-ship-") + "/loomgraph_pkg"
    shutil.make_archive(stem, "zip", PACKAGE_ROOT, "loomgraph")
    sc.addPyFile(stem + ".zip")
    sc._loomgraph_shipped = True



def hot_keys(df: DataFrame, key: str, at_least: int = 1000, most: int = 64) -> list:
    """The ``most`` most frequent keys with ``at_least`` rows each: a list of a fixed length."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= at_least)
    return [r[0] for r in counts.orderBy(F.desc("count"), key).limit(most).collect()]


def split_hot_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right`` (unique on ``key``) so that the rows of a hot key of ``left`` never meet in one task.

    ``hot`` (see ``hot_keys``) has a fixed length, so its rows of ``right`` have a proven bound and are broadcast; all
    other keys take the ordinary shuffled join. Nothing is dropped: both parts together are all rows of ``left``. Null
    keys go with the ordinary part.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right.where(~F.col(key).isin(hot)), key, how))


def may_be_in(df: DataFrame, column: str, ids: DataFrame, bits: int = 21) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the ids (the one column of ``ids``): all that are, and few others, so
    that most others are never shuffled. The hashes of the ids are bits of words, of which there are 2 ** (bits - 6) at most
    however many the ids are; with more ids than bits nearly every row stays."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    word = lambda c: F.shiftright(place(c), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    (key,) = ids.columns
    words = ids.groupBy(word(key).alias("filter_word")).agg(F.bit_or(bit(key)).alias("filter_bits"))
    met = df.join(F.broadcast(words), word(df[column]) == F.col("filter_word"))
    return met.where(F.col("filter_bits").bitwiseAND(bit(column)) != 0).select(*df.columns)
