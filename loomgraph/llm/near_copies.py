"""Near-duplicate records with small edits, without comparing all pairs.

A text is the set of its sequences of ``SHINGLE`` consecutive words; two texts are linked if their sets share at least
``THRESHOLD`` of their union. The scheme is that of anchor points: every text gets a short fingerprint and is replicated
to all anchors that could also hold a partner, fingerprints are compared per anchor, and survivors are verified.

* Fingerprint: 64 parity bits of the set. Its Hamming distance never exceeds the size of the symmetric difference, so
  with d = (|A|+|B|)(1-t)/(1+t) a pair further apart than d is no pair: the comparison loses nothing. Pairs that met at
  an anchor are compared once more by 256 other parity bits, before any set moves.
* Anchors: a covering code over bit vectors does not serve here. At t = 0.7 two linked texts of 60 sequences may differ
  in 21 of them, and a radius of 21 around a code word of 64 bits takes in nearly all code words. With one-bit min-hashes
  (agreement 0.85 a bit at the threshold) and the perfect code of 23 bits and radius 3, a text goes to the 71 anchors
  within 3 + 3, 99.95 % of the linked pairs meet, and so do 45 % of all pairs of texts: the comparison stays quadratic.
  The anchors are therefore the rarest members of the set: ordered by how often they occur in the corpus, any two linked
  sets share a member among the first |A| - ceil(t|A|) + 1 of each. That covers every pair at the threshold, with
  certainty.
* Occurrence counts come from a sketch over the whole corpus whose counters grow with the number of members, up to
  MOST_COUNTERS; the logarithms of the counts are broadcast, a byte each. Counts that collide only change the order, and
  any order that is the same everywhere is exact.
* Verification: exact intersection of the sets.

Scale: texts with the same words are one class, deduplicated per partition before anchors are shuffled, so a class with
a third of all rows sends as many rows as there are partitions. Anchors are rare by construction, and members are hashes
of 64 bits, so that unrelated texts don't meet at any size of the corpus. Links hold between classes; ``near_copies``
expands them to pairs of members, ``link_counts`` gives one row for each text instead.

Defined cases: null, empty and short texts (below ``min_words``) have no partners; texts with the same letters and
digits are copies, not near copies; captures that are copies under ``merkle`` are left out; ties cannot occur, ids are
ordered; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.merkle import capture_digest, frequent
from loomgraph.runtime import ship_package, split_hot_join, write_stage

SHINGLE, THRESHOLD_NUM, THRESHOLD_DEN, MIN_WORDS = 3, 7, 10, 30
COUNTERS, MOST_COUNTERS, SLICES, WIDE = 1 << 20, 1 << 26, 16, 4
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)

PRINT_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("words_key", T.BinaryType()),
        T.StructField("ref", T.LongType()),
        T.StructField("letters_key", T.LongType()),
        T.StructField("copy_key", T.BinaryType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("sig", T.ArrayType(T.LongType())),
        T.StructField("fp", T.LongType()),
        T.StructField("wide", T.ArrayType(T.LongType())),
    ]
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class ShingleHasher:
    """64-bit hashes of the distinct word sequences of a text, sorted. The cache of words is bounded."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.cache = k, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        for x in words:
            if x not in cache:
                cache[x] = xxhash.xxh64_intdigest(x)
        w = np.array([cache[x] for x in words], dtype=np.uint64)
        m = len(words) - self.k + 1
        h = w[:m] * _MIX[0]
        for j in range(1, self.k):
            h = (h ^ (h >> np.uint64(29))) * _MIX[3] + w[j : m + j] * _MIX[j % 5]
        h ^= h >> np.uint64(32)
        h *= _MIX[4]
        return np.unique(h ^ (h >> np.uint64(29))).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, min_words: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("table_name", pa.string()), ("id", pa.string()), ("words_key", pa.binary()), ("ref", pa.int64()), ("letters_key", pa.int64()), ("copy_key", pa.binary()), ("first", pa.bool_()), ("n", pa.int32()), ("sig", pa.list_(pa.int64())), ("fp", pa.int64()), ("wide", pa.list_(pa.int64()))])
    hasher, seen = ShingleHasher(k), set()
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        for name, i, text in zip(*(b.column(c).to_pylist() for c in ("table_name", "id", "text")), strict=True):
            words = words_of(text)
            if len(words) < max(min_words, k):
                continue
            key = blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16, person=name.encode()[:16]).digest()
            ref = int.from_bytes(key[:8], "little", signed=True)
            fresh = ref not in seen
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(ref)
            sig = hasher(words)
            bits = np.packbits((np.bincount((sig >> 8) & 63, minlength=64) & 1).astype(np.uint8))
            wide = np.packbits((np.bincount((sig >> 14) & (64 * WIDE - 1), minlength=64 * WIDE) & 1).astype(np.uint8)).view(np.int64)
            row = (name, i, key, ref, xxhash.xxh64_intdigest("".join(words)) - (1 << 63), capture_digest(text) if name == "captures" else None, fresh, len(sig), sig, int(bits.view(np.int64)[0]), wide)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all members, number of members of each text)."""
    sig = b.column("sig")
    return sig.flatten().to_numpy(zero_copy_only=False), np.diff(sig.offsets.to_numpy())


def _bucket(members: np.ndarray, counters: int) -> np.ndarray:
    return (members.view(np.uint64) >> np.uint64(24)) & np.uint64(counters - 1)


def _count(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(counters, dtype=np.uint32)
    for b in batches:
        members, _ = _flat(b)
        if len(members):
            total += np.bincount(_bucket(members, counters).astype(np.int64), minlength=counters).astype(np.uint32)
    if total.any():
        slices = [s.tobytes() for s in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pa.compress(s, "zstd", asbytes=True) for s in slices], pa.binary())], names=["slice", "counts"])


def _add(key: tuple, t: pa.Table, counters: int) -> pa.Table:
    """Logarithms of the summed counts, a byte each: eight steps to a doubling."""
    total = np.zeros(counters // SLICES, dtype=np.int64)
    for c in t.column("counts").to_pylist():
        total += np.frombuffer(pa.decompress(c, decompressed_size=4 * len(total), codec="zstd", asbytes=True), dtype=np.uint32)
    small = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([small.tobytes()], pa.binary())})


def counters_for(n_members: int) -> int:
    """A power of two, about an eighth of the members, between COUNTERS and MOST_COUNTERS."""
    return min(max(COUNTERS, 1 << max(n_members // 8, 1).bit_length()), MOST_COUNTERS)


def corpus_counts(prints: DataFrame, counters: int) -> np.ndarray:
    """How often each counter's members occur in all texts, as logarithms: MOST_COUNTERS bytes at most."""
    parts = prints.select("sig").mapInArrow(lambda b: _count(b, counters), "slice int, counts binary").groupBy("slice").applyInArrow(lambda k, t: _add(k, t, counters), "slice int, counts binary").collect()
    out = np.zeros((SLICES, counters // SLICES), dtype=np.uint8)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.reshape(-1)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (n * num + den - 1) // den + 1


def _anchors(batches: Iterator[pa.RecordBatch], counts, num: int, den: int) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for b in batches:
        members, n = _flat(b)
        if not len(members):
            continue
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((members, table[_bucket(members, len(table))], doc))
        start = np.repeat(np.cumsum(n) - n, n)
        keep = (np.arange(len(members)) - start) < np.repeat(prefix_length(n, num, den), n)
        chosen = order[keep]
        owner = doc[chosen]
        salt = np.array([xxhash.xxh64_intdigest(x) for x in b.column("table_name").to_pylist()], dtype=np.uint64)
        anchor = (members[chosen].view(np.uint64) ^ salt[owner]).view(np.int64)
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column("ref").take(take), b.column("n").take(take), b.column("fp").take(take)], names=["anchor", "ref", "n", "fp"])


def linked_classes(texts: DataFrame, k: int = SHINGLE, num: int = THRESHOLD_NUM, den: int = THRESHOLD_DEN, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(links between classes: key_a, key_b; members: table_name, id, words_key, copy_key). A class is all texts of a table
    with the same words. ``texts`` has table_name, id and text."""
    spark = texts.sparkSession
    ship_package(spark)
    rows = texts.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("table_name", "id", "text")
    stage = write_stage(rows.mapInArrow(lambda b: _fingerprints(b, k, min_words), PRINT_SCHEMA), "prints")
    prints = stage.df
    counts = spark.sparkContext.broadcast(corpus_counts(prints, counters_for(prints.agg(F.sum("n").alias("n")).first()["n"] or 0)))
    narrow = prints.where("first").select("table_name", "ref", "n", "fp", "sig")
    held = narrow.mapInArrow(lambda b: _anchors(b, counts, num, den), "anchor long, ref long, n int, fp long").repartition("anchor").dropDuplicates(["anchor", "ref", "n", "fp"])
    a, b = held.alias("a"), held.alias("b")
    near = (
        (F.col("a.ref") < F.col("b.ref"))
        & (F.col("a.n") * den >= F.col("b.n") * num)
        & (F.col("b.n") * den >= F.col("a.n") * num)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) * (num + den) <= (F.col("a.n") + F.col("b.n")) * (den - num))
    )
    pairs = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & near).select(F.col("a.ref").alias("ref_a"), F.col("b.ref").alias("ref_b")).distinct()
    # a second, wider fingerprint is compared by pair, before the sets themselves move
    wide = prints.where("first").select("ref", "n", "wide").repartition("ref").dropDuplicates(["ref", "n", "wide"])
    look = lambda s: wide.select(F.col("ref").alias(f"ref_{s}"), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}"))
    apart = sum((F.bit_count(F.col("wide_a")[i].bitwiseXOR(F.col("wide_b")[i])) for i in range(WIDE)), F.lit(0))
    pairs = pairs.join(look("a"), "ref_a").join(look("b"), "ref_b").where(apart * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("ref_a", "ref_b")
    sets = prints.where("first").select("ref", "words_key", "letters_key", "sig").repartition("ref").dropDuplicates(["ref", "words_key"])
    side = lambda s: sets.select(F.col("ref").alias(f"ref_{s}"), F.col("words_key").alias(f"key_{s}"), F.col("letters_key").alias(f"letters_{s}"), F.col("sig").alias(f"sig_{s}"))
    both = F.size(F.array_intersect("sig_a", "sig_b"))
    linked = (
        pairs.join(side("a"), "ref_a")
        .join(side("b"), "ref_b")
        .where(F.col("letters_a") != F.col("letters_b"))
        .where(both * (num + den) >= (F.size("sig_a") + F.size("sig_b")) * num)
        .select("key_a", "key_b")
    )
    linked = write_stage(linked.distinct(), "near-classes").df
    return linked, prints.select("table_name", "id", "words_key", "copy_key")


def near_copies(texts: DataFrame, k: int = SHINGLE, num: int = THRESHOLD_NUM, den: int = THRESHOLD_DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """(table_name, id_a, id_b) with id_a < id_b, of all linked texts."""
    linked, members = linked_classes(texts, k, num, den, min_words)
    member = lambda s: members.select("table_name", F.col("words_key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}"), F.col("copy_key").alias(f"copy_{s}"))
    return (
        linked.join(member("a"), "key_a")
        .join(member("b").drop("table_name"), "key_b")
        .where(~F.coalesce(F.col("copy_a") == F.col("copy_b"), F.lit(False)) & (F.col("id_a") != F.col("id_b")))
        .select("table_name", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .distinct()
    )


def link_counts(texts: DataFrame, k: int = SHINGLE, num: int = THRESHOLD_NUM, den: int = THRESHOLD_DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """(table_name, id, class_id, n_links): one row for each text that is long enough, the smallest id of the texts with the
    same words, and the number of other classes that are linked to it. Copies are not expanded."""
    linked, members = linked_classes(texts, k, num, den, min_words)
    ends = linked.select(F.col("key_a").alias("words_key")).unionByName(linked.select(F.col("key_b").alias("words_key")))
    n = ends.groupBy("words_key").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("words_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).join(n, "words_key", "left")
    classes = write_stage(classes.select(F.hex("words_key").alias("key"), "class_id", "n", F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-members").df
    keyed = members.select("table_name", "id", F.hex("words_key").alias("key"))
    return split_hot_join(keyed, classes.drop("n"), "key", frequent(classes), "inner").select("table_name", "id", "class_id", "n_links")


def graph_texts(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    return captures.select(F.lit("captures").alias("table_name"), "id", F.col("raw_content").alias("text")).unionByName(nodes.select(F.lit("nodes").alias("table_name"), "id", F.col("content").alias("text")))
