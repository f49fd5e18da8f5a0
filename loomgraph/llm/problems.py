"""Queries p2, p4, p5, p6, p8, p9 and p10 over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import abuse, byte_bpe, leakage, merkle, name_variants, near_copies, oracle, personal
from loomgraph.runtime import table

#: Edits that p9_passages grants to either side of an exact run.
EDITS = 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return merkle.found(table(spark, d, "captures"), table(spark, d, "nodes"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return merkle.copy_counts(table(spark, d, "captures"), table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copies(near_copies.graph_texts(table(spark, d, "captures"), table(spark, d, "nodes")))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """One row for each text with its class and its number of linked classes; copies are not expanded to pairs."""
    return near_copies.link_counts(near_copies.graph_texts(table(spark, d, "captures"), table(spark, d, "nodes")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode_corpus(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.token_report(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked regions with up to EDITS edits beyond the exact run."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), edits=EDITS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, d, "nodes"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row for each named node with its entity; the pairs are not expanded."""
    return name_variants.entities(table(spark, d, "nodes"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    return personal.find_personal(personal.private_fields(table(spark, d, "captures"), nodes), personal.name_lexicon(nodes))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "record_id", "field_name", F.explode("pii_types").alias("pii_type")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "record_id", "field_name", "redacted")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.explode("categories").alias("category")).distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", "score")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_redacted": p5_redacted, "p8_ids": p8_ids, "p8_report": p8_report, "p9_found": p9_found, "p9_passages": p9_passages, "p6_found": p6_found, "p6_links": p6_links, "p2_found": p2_found, "p2_counts": p2_counts}

SQL: dict[str, str] = oracle.SQL
