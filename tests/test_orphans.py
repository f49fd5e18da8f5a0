import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.operators import orphans as o

REF = "table_name string, record_id string, field_name string, parent_table string, ref_id string, ref_at timestamp"
PARENT = "parent_table string, ref_id string, parent_at timestamp, deleted boolean"
DAY = datetime(2024, 1, 1)


def data(spark, seed):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.05 else DAY + timedelta(hours=rng.randrange(1000))
    parents = [("nodes", f"p{i}", at(), rng.random() < 0.2) for i in range(60)]
    refs = [("edges", f"r{i}", "source_id", "nodes", "p1" if rng.random() < 0.4 else f"p{rng.randrange(80)}", at()) for i in range(3000)]
    refs += refs[:50]
    return spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), refs, parents


def brute(refs, parents):
    known = {p[1]: p for p in parents}
    out = set()
    for t, r, f, _, x, at in refs:
        p = known.get(x)
        if p is None:
            out.add((t, r, f, "missing"))
        elif p[3]:
            out.add((t, r, f, "deleted"))
        elif p[2] and at and p[2] > at:
            out.add((t, r, f, "late"))
    return out


def test_increments_agree_with_brute_force(spark):
    refs, parents, raw_refs, raw_parents = data(spark, 3)
    want = brute(raw_refs, raw_parents)
    for cuts in ([], [DAY + timedelta(hours=500)], [DAY + timedelta(hours=100 * h) for h in range(1, 10)]):
        ledger = o.run_ledger(refs, parents, cuts)
        assert {tuple(r) for r in o.found(ledger).collect()} == want, cuts
        assert len(ledger.snapshots) == len(cuts) + 1
        last = ledger.history().where(F.col("increment") == len(cuts) + 1).agg(F.sum("n_orphans")).first()[0]
        assert last == len(want)


def test_arrival_resolves_and_deletion_reopens(spark):
    ref = lambda *rows: spark.createDataFrame(list(rows), REF)
    par = lambda *rows: spark.createDataFrame(list(rows), PARENT)
    first = ref(("edges", "e1", "source_id", "nodes", "a", DAY), ("edges", "e2", "source_id", "nodes", "b", DAY + timedelta(9)))
    none, no_ref = spark.createDataFrame([], PARENT), spark.createDataFrame([], REF)
    ledger = o.OrphanLedger(spark).advance(first, none)
    rows = lambda: {tuple(r)[1:] for r in o.found(ledger).collect()}
    assert rows() == {("e1", "source_id", "missing"), ("e2", "source_id", "missing")}
    ledger.advance(no_ref, par(("nodes", "a", DAY + timedelta(1), False), ("nodes", "b", DAY, False)))
    assert rows() == {("e1", "source_id", "late")}
    ledger.advance(no_ref, par(("nodes", "b", DAY, True)))
    assert rows() == {("e1", "source_id", "late"), ("e2", "source_id", "deleted")}
    # the parent stated again with an earlier time: the reference was never late
    ledger.advance(no_ref, par(("nodes", "a", DAY - timedelta(1), False)))
    assert rows() == {("e2", "source_id", "deleted")}
    # deleted twice changes nothing
    ledger.advance(no_ref, par(("nodes", "b", DAY, True), ("nodes", "b", DAY, False)))
    assert rows() == {("e2", "source_id", "deleted")} and ledger.log[-1].df.count() == 0
    assert sum(r.n_orphans for r in ledger.snapshot().collect()) == 1


def test_an_increment_reads_the_buckets_it_touches(spark, monkeypatch):
    """Ten increments: each adds its own part, and nothing is written anew but a merged index."""
    refs, parents, raw_refs, raw_parents = data(spark, 5)
    monkeypatch.setattr(o, "COMPACT_AFTER", 4)
    ledger = o.run_ledger(refs, parents, [DAY + timedelta(hours=100 * h) for h in range(1, 10)])
    assert {tuple(r) for r in o.found(ledger).collect()} == brute(raw_refs, raw_parents)
    assert len(ledger.refs.parts) == 10 and len(ledger.index.parts) <= 5
    one = ledger.refs.read([3])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and 0 < one.count() < ledger.refs.read().count() / 3


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, source_id string, target_id string, created_at timestamp, ref_id string")
    f = spark.createDataFrame([], "id string, node_id string, created_at timestamp")
    c = spark.createDataFrame([], "id string, fact_id string, checked_at timestamp")
    n = spark.createDataFrame([], "id string, created_at timestamp, deleted boolean")
    assert o.found(o.run_ledger(o.references(e, f, c), o.parent_rows(n, f), [])).count() == 0
