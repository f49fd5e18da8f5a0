"""Queries p1, p3 and p7: hierarchies, time normalisation and orphan references."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, orphans, timestamps
from loomgraph.runtime import table

#: Penalty of a reading against the conventions where a source's conventions aren't known (p3_inferred).
UNKNOWN_CONVENTIONS = 0.5
#: The days at which the ledger of orphans takes its increments, and those of the series of snapshots.
CUT, CUTS = "2024-07-01", ("2024-01-01", "2024-07-01", "2025-01-01")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "edges"), with_paths=False).select("node_id", "root_id", "depth")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.hierarchy(table(spark, d, "edges"))
    return nodes.select("node_id", "root_id", "depth", F.concat_ws("/", "path").alias("path"), "n_descendants", "in_cycle", "back_edge_to")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "edges")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values = timestamps.time_values(table(spark, d, "nodes"), table(spark, d, "sync_records"))
    return timestamps.normalise_times(values).select("table_name", "record_id", "field_name", "utc_us").distinct()


def p3_inferred(spark: SparkSession, d: str) -> DataFrame:
    values = timestamps.time_values(table(spark, d, "nodes"), table(spark, d, "sync_records"))
    return timestamps.normalise_times(values, UNKNOWN_CONVENTIONS)


def _ledger(spark: SparkSession, d: str, cuts: tuple[str, ...] = (CUT,)) -> orphans.OrphanLedger:
    edges, facts, checks, nodes = (table(spark, d, t) for t in ("edges", "verified_facts", "fact_checks", "nodes"))
    refs, parents = orphans.references(edges, facts, checks), orphans.parent_rows(nodes, facts)
    return orphans.run_ledger(refs, parents, [datetime.fromisoformat(c) for c in cuts])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(_ledger(spark, d))


def p7_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Open orphans after each increment."""
    return _ledger(spark, d, CUTS).history().groupBy("increment", "table_name", "field_name", "reason").agg(F.sum("n_orphans").alias("n_orphans"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).snapshot()


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p3_found": p3_found, "p3_inferred": p3_inferred, "p7_found": p7_found, "p7_report": p7_report, "p7_snapshots": p7_snapshots}

_LINKS = """
link AS (SELECT CASE WHEN upper(trim(edge_type)) = 'CONTAINS' THEN target_id ELSE source_id END AS child,
    min(CASE WHEN upper(trim(edge_type)) = 'CONTAINS' THEN source_id ELSE target_id END) AS parent
  FROM edges WHERE upper(trim(edge_type)) IN ('PART_OF', 'SUBTASK_OF', 'CONTAINS') AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
ids AS (SELECT child AS id FROM link UNION SELECT parent FROM link),
top AS (SELECT id FROM ids WHERE id NOT IN (SELECT child FROM link)),
tree AS (SELECT id AS node_id, id AS root_id, 0 AS depth FROM top UNION ALL SELECT l.child, t.root_id, t.depth + 1 FROM tree t JOIN link l ON l.parent = t.node_id),
stuck AS (SELECT id FROM ids WHERE id NOT IN (SELECT node_id FROM tree)),
walk AS (SELECT id AS start, id AS pos, 0 AS n FROM stuck UNION ALL SELECT w.start, l.parent, w.n + 1 FROM walk w JOIN link l ON l.child = w.pos WHERE w.n < 2 * (SELECT count(*) FROM stuck)),
loops AS (SELECT start, min(pos) AS low FROM walk WHERE n >= (SELECT count(*) FROM stuck) GROUP BY start)"""

_REFS = """
refs AS (SELECT DISTINCT * FROM (
  SELECT 'edges' AS table_name, id AS record_id, 'source_id' AS field_name, 'nodes' AS parent_table, source_id AS ref_id, created_at AS ref_at FROM edges
  UNION ALL SELECT 'edges', id, 'target_id', 'nodes', target_id, created_at FROM edges
  UNION ALL SELECT 'verified_facts', id, 'node_id', 'nodes', node_id, created_at FROM verified_facts
  UNION ALL SELECT 'fact_checks', id, 'fact_id', 'verified_facts', fact_id, checked_at FROM fact_checks) WHERE ref_id IS NOT NULL),
parents AS (SELECT 'nodes' AS parent_table, id AS ref_id, min(created_at) AS parent_at, max(CASE WHEN deleted THEN 1 ELSE 0 END) AS gone FROM nodes GROUP BY id
  UNION ALL SELECT 'verified_facts', id, min(created_at), 0 FROM verified_facts GROUP BY id),
judged AS (SELECT r.*, CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN p.gone = 1 THEN 'deleted' WHEN p.parent_at > r.ref_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.parent_table = r.parent_table AND p.ref_id = r.ref_id)"""

_STAND = f"""WITH {_REFS.replace('WHERE ref_id IS NOT NULL', "WHERE ref_id IS NOT NULL AND coalesce(ref_at < TIMESTAMP '{c}', true)").replace('FROM nodes GROUP BY id', "FROM nodes WHERE coalesce(created_at < TIMESTAMP '{c}', true) GROUP BY id").replace('FROM verified_facts GROUP BY id', "FROM verified_facts WHERE coalesce(created_at < TIMESTAMP '{c}', true) GROUP BY id")} SELECT table_name, field_name, reason, count(*) AS n_orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT node_id, root_id, depth FROM tree UNION ALL SELECT start, low, -1 FROM loops",
    "p1_descendants": f"WITH RECURSIVE {_LINKS}, below AS (SELECT parent AS ancestor_id, child AS node_id, 1 AS distance FROM link WHERE child IN (SELECT node_id FROM tree) UNION ALL SELECT b.ancestor_id, l.child, b.distance + 1 FROM below b JOIN link l ON l.parent = b.node_id) SELECT ancestor_id, node_id, distance FROM below",
    "p7_found": f"WITH {_REFS} SELECT DISTINCT table_name, record_id, field_name, reason FROM judged WHERE reason IS NOT NULL",
    "p7_snapshots": " UNION ALL ".join(f"SELECT {k + 1} AS increment, * FROM ({_STAND.format(c=c)})" for k, c in enumerate((*CUTS, "9999-01-01"))),
    "p7_report": f"WITH {_REFS} SELECT table_name, field_name, reason, strftime(ref_at, '%Y-%m') AS period, count(*) AS n_orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
