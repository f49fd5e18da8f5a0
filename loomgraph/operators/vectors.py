"""Vector and text retrieval: exact cosine search in blocks, bridges across groups, BM25, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import ship_package

TILE = "ids array<long>, labels array<int>, data binary"
PAIR = "query_id long, query_label int, id long, label int, score double"


def _tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            emb = part.column("embedding")
            m = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.int32())), pa.array([m.tobytes()], pa.binary())], names=["ids", "labels", "data"])


def tiles(vectors: DataFrame, rows: int = 2048) -> DataFrame:
    """Rows packed as unit vectors, ``rows`` to a tile."""
    ship_package(vectors.sparkSession)
    good = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").mapInArrow(lambda b: _tiles(b, rows), TILE)


def search(vectors: DataFrame, queries: DataFrame, top: int, least: float = -1.0, other_label: bool = False, older_of_label: bool = False) -> DataFrame:
    """(query_id, query_label, id, label, score): the ``top`` nearest rows of each query by cosine, itself left out.

    ``other_label`` takes rows of other labels only, ``older_of_label`` those of the query's label with a lower id.
    Exact: queries and rows are cut into tiles, each pair of tiles is one matrix product, and only the best of a tile
    leave it. Tiles meet, not rows, and no side is broadcast.
    """
    q = tiles(queries, 512).select(F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("data").alias("q_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.array(r["ids"], dtype=np.int64), np.array(r["q_ids"], dtype=np.int64)
                x = np.frombuffer(r["data"]).reshape(len(ids), -1)
                y = np.frombuffer(r["q_data"]).reshape(len(qids), -1)
                s = y @ x.T
                s[qids[:, None] == ids[None, :]] = -2.0
                ql, l = np.array([-1 if v is None else v for v in r["q_labels"]]), np.array([-1 if v is None else v for v in r["labels"]])
                if other_label:
                    s[ql[:, None] == l[None, :]] = -2.0
                if older_of_label:
                    s[(ql[:, None] != l[None, :]) | (ids[None, :] >= qids[:, None])] = -2.0
                k = min(top, len(ids))
                # ties at the border are kept whole here and broken by id afterwards
                border = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero((s >= border) & (s >= least) & (s > -2.0))
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ql[i], pa.int32()), pa.array(ids[j]), pa.array(l[j], pa.int32()), pa.array(s[i, j])], names=["query_id", "query_label", "id", "label", "score"])

    met = tiles(vectors).crossJoin(q).mapInArrow(run, PAIR)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 0)


def bm25(documents: DataFrame, queries: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score) of documents with at least one term of a query (query, term).

    Only terms of the queries are exploded and counted; lengths and the number of documents are two scalars.
    """
    wanted = queries.select("query", "term").distinct()
    words = documents.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("words"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean"))
    hits = words.select(key, F.size("words").alias("length"), F.explode("words").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("part", part)
    return scored.join(wanted, "term").groupBy("query", key).agg(F.sum("part").alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, keys: list[str], alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse after scaling each to 0..1 within its query; an absent score is 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(keys[0])
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select(*keys, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    return scaled(dense, "d").join(scaled(sparse, "s"), keys, "full").select(*keys, (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))
