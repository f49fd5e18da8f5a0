"""Versioned tables in plain folders: a version is written whole, then a pointer is moved; old versions can come back."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession


class GraphStore:
    """Tables below ``base``: <table>/v=<n> and a pointer file. Readers follow the pointer, so a failed write is unseen."""

    def __init__(self, spark: SparkSession, base: str, keep: int = 10):
        self.spark, self.base, self.keep = spark, base.rstrip("/"), keep
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self, table: str) -> list[int]:
        fs, where = self._fs(), self._path(table)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def current(self, table: str) -> int | None:
        fs, at = self._fs(), self._path(f"{table}/_current.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            text = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)["version"]

    def _point(self, table: str, version: int) -> None:
        fs, temporary = self._fs(), self._path(f"{table}/_current-{time.time_ns()}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        final = self._path(f"{table}/_current.json")
        fs.delete(final, False)
        fs.rename(temporary, final)

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        version = max(self.versions(table), default=0) + 1
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.base}/{table}/v={version}")
        self._point(table, version)
        for old in self.versions(table)[: -self.keep]:
            self._fs().delete(self._path(f"{table}/v={old}"), True)
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.current(table) if version is None else version
        if v is None:
            raise FileNotFoundError(f"no version of {table} in {self.base}")
        return self.spark.read.parquet(f"{self.base}/{table}/v={v}")

    def restore(self, table: str, version: int) -> None:
        """Make an older version the current one; the newer ones stay until they are pruned."""
        if version not in self.versions(table):
            raise ValueError(f"{table} has no version {version}")
        self._point(table, version)
