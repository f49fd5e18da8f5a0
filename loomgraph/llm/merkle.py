"""Duplicates hidden by formatting differences: bottom-up hashing of nested records.

Method: leaves are normalised (only letters and digits count, case ignored), the child digests of an unordered node are
sorted and hashed, records are grouped by their root digest, and a group is confirmed by comparing whole canonical
forms. A capture is a record of named fields and a body, whether it was typed, rendered as ``Field: value`` lines before
a body, or written as a JSON object whose member ``text`` is the body; JSON may be nested to any depth.

Scale: one linear pass makes digests; groups are counted with partial aggregation; only members of groups of two or more
are read again for the comparison. Members find their group's row by a join in which the most frequent groups, at most
HOT of them, are kept apart against a broadcast of as many rows, so that a group with a third of all rows stays spread
over all tasks. No pairs are made.

Defined cases: a null text or title is no record and has no copies; texts without any letter or digit are copies of each
other; broken JSON is plain text; the same field stated twice with two values counts twice; ties for keep_id cannot
occur as ids are unique (a re-delivered row with the same id is the same record); extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import ship_package, split_hot_join, write_stage

# The field names that the connectors render before a body.
FIELD_NAMES = frozenset(["note", "date", "category", "type", "tags", "linksto", "calendarevent", "end", "location", "participants", "attendees", "details", "recurrence"])
BODY_MEMBER = "text"
LEFT_OUT = ("PERSON", "ORGANIZATION")
#: Groups of at least HOT_ROWS rows, HOT at most, are joined apart.
HOT, HOT_ROWS = 64, 1000
_KEEP = re.compile(r"[^\W_]+")


def norm(text: str) -> str:
    return "".join(_KEEP.findall(text.casefold()))


def record(text: str) -> tuple[list[tuple[str, object]], object]:
    """(named fields, body) of a capture's text."""
    bare = text.strip().strip("﻿​").strip()
    if bare.startswith("{"):
        try:
            doc = json.loads(bare, object_pairs_hook=lambda pairs: {"\0pairs": pairs})
        except (ValueError, RecursionError):
            doc = None
        if isinstance(doc, dict):
            pairs = doc["\0pairs"]
            body = [v for k, v in pairs if norm(k) == BODY_MEMBER]
            fields = [(k, v) for k, v in pairs if norm(k) != BODY_MEMBER]
            return fields, body[0] if body else ""
    fields: list[tuple[str, object]] = []
    rest = text
    while rest:
        line, _, after = rest.partition("\n")
        name, colon, value = line.partition(":")
        if colon and norm(name) in FIELD_NAMES:
            fields.append((name, value))
        elif norm(line):
            break
        rest = after
    return fields, rest


def _leaf(value: object) -> str:
    return "" if value is None else norm(value) if isinstance(value, str) else norm(json.dumps(value))


def canonical(value: object) -> object:
    """The normalised structure: unordered nodes as sorted lists of (name, value), ordered ones as lists."""
    if isinstance(value, dict):
        return ["U", sorted(([norm(k), canonical(v)] for k, v in value["\0pairs"]), key=json.dumps)]
    if isinstance(value, list):
        return ["O", [canonical(v) for v in value]] if any(isinstance(v, (dict, list)) for v in value) else "".join(map(_leaf, value))
    return _leaf(value)


def digest(value: object) -> bytes:
    """Bottom-up: the digest of a node from the digests of its children."""
    if isinstance(value, dict):
        kids = sorted(blake2b(norm(k).encode() + b"\0" + digest(v), digest_size=16).digest() for k, v in value["\0pairs"])
        return blake2b(b"U" + b"".join(kids), digest_size=16).digest()
    if isinstance(value, list):
        if any(isinstance(v, (dict, list)) for v in value):
            return blake2b(b"O" + b"".join(map(digest, value)), digest_size=16).digest()
        return digest("".join(map(_leaf, value)))
    return blake2b(b"L" + _leaf(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def capture_digest(text: str) -> bytes:
    fields, body = record(text)
    return digest({"\0pairs": [("fields", {"\0pairs": fields}), ("body", body)]})


def capture_canonical(text: str) -> str:
    fields, body = record(text)
    return json.dumps(canonical({"\0pairs": [("fields", {"\0pairs": fields}), ("body", body)]}))


@F.pandas_udf(T.BinaryType())
def capture_digest_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else capture_digest(x))


@F.pandas_udf(T.StringType())
def capture_canonical_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else capture_canonical(x))


def node_form(node_type: Column, title: Column) -> Column:
    """Upper then lower case folds more letters together than lower case alone; with the replacement between them the
    optimizer doesn't reduce the two to the outer one."""
    return F.concat_ws("\0", F.coalesce(node_type, F.lit("")), F.lower(F.regexp_replace(F.upper(title), r"[^\p{L}\p{N}]+", "")))


def copies(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    """(table_name, id, keep_id, n): each member of a group of two or more, with the group's smallest id and its size."""
    spark = captures.sparkSession
    ship_package(spark)
    kept_nodes = nodes.where(F.col("title").isNotNull() & F.col("id").isNotNull() & ~F.coalesce(F.col("node_type").isin(*LEFT_OUT), F.lit(False)))
    texts = captures.where(F.col("raw_content").isNotNull() & F.col("id").isNotNull())
    digests = texts.select(F.lit("captures").alias("table_name"), "id", capture_digest_udf("raw_content").alias("digest")).unionByName(
        kept_nodes.select(F.lit("nodes").alias("table_name"), "id", F.unhex(F.md5(node_form(F.col("node_type"), F.col("title")))).alias("digest"))
    )
    rows = write_stage(digests.withColumn("key", F.concat_ws(":", "table_name", F.hex("digest"))), "merkle-digests").df
    several = write_stage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "merkle-groups").df
    members = split_hot_join(rows, several.select("key"), "key", frequent(several), "inner")
    of = lambda name: members.where(F.col("table_name") == name)
    full = (
        of("captures").join(texts.select("id", "raw_content"), "id").select("table_name", "id", "digest", capture_canonical_udf("raw_content").alias("form"))
    ).unionByName(of("nodes").join(kept_nodes.select("id", "node_type", "title"), "id").select("table_name", "id", "digest", node_form(F.col("node_type"), F.col("title")).alias("form")))
    # from here on a group has a key of its digest and its whole form; the groups themselves are told apart by the forms
    key = F.concat_ws(":", "table_name", F.hex("digest"), F.hex(F.xxhash64("form")))
    full = write_stage(full.distinct().withColumn("key", key), "merkle-forms").df
    groups = full.groupBy("key", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    groups = write_stage(groups.select("key", "keep_id", "n"), "merkle-kept").df
    return split_hot_join(full.select("table_name", "id", "key"), groups, "key", frequent(groups), "inner").select("table_name", "id", "keep_id", "n")


def frequent(groups: DataFrame) -> list[str]:
    return [r["key"] for r in groups.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "key").limit(HOT).select("key").collect()]


def found(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    return copies(captures, nodes).where("id <> keep_id").select("table_name", "keep_id", F.col("id").alias("copy_id"))


def copy_counts(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each record that has copies: how many rows of the table it stands for."""
    return copies(captures, nodes).where("id = keep_id").select("table_name", "keep_id", F.col("n").alias("n_rows"))
