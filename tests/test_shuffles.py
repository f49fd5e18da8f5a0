"""Pairs of a hub are not shuffled: values against plain Python or SQL, and the rows that the stages write for others."""

import math

import pytest

from loomgraph.operators import graph as g
from loomgraph.operators import resolution as rs
from loomgraph.operators import views


def shuffled(spark, make):
    """(rows of the result, rows written to shuffles)."""
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        it = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None).iterator()
        out = {}
        while it.hasNext():
            s = it.next()
            out[s.stageId()] = s.shuffleWriteRecords()
        return out

    before = stages()
    found = make().collect()
    return found, sum(n for k, n in stages().items() if k not in before)


def test_comparison_opens_the_smaller_end(spark):
    leaves = [f"l{i:03d}" for i in range(300)]
    edges = [("hub", x) for x in leaves] + [("l000", "l001"), ("hub", "hub")]
    e = spark.createDataFrame(edges, "source_id string, target_id string")
    near = {x: {b for p in edges for a, b in (p, p[::-1]) if a == x} for x in ["hub", *leaves]}
    pairs = [("hub", x) for x in leaves] + [("l000", "l001"), ("l002", "l003")]
    found, rows = shuffled(spark, lambda: views.compare(spark.createDataFrame(pairs, "a string, b string"), e))
    assert {(r.a, r.b): (r.shared, r.only_a, r.only_b) for r in found} == {(a, b): (len(near[a] & near[b]), len(near[a] - near[b]), len(near[b] - near[a])) for a, b in pairs}
    assert rows < 20_000  # 300 * 300 neighbours of the hub before


def test_resolution_of_a_frequent_word(spark):
    n = 150
    node = "id string, node_type string, title string, properties string, networks array<string>, created_at timestamp"
    make = lambda s: spark.range(n).selectExpr(f"concat('{s}', id) as id", "'CONCEPT' as node_type", f"concat('the {s} ', id % 7) as title", "cast(null as string) as properties", "array('A') as networks", "timestamp'2024-01-01' as created_at").to(spark.createDataFrame([], node).schema)
    edges = spark.createDataFrame([(f"{s}{i}", f"m{i % 3}") for s in ("new", "old") for i in range(0, n, 2)], "source_id string, target_id string")
    found, rows = shuffled(spark, lambda: rs.decisions(make("new"), rs.combined(rs.signals(make("new"), make("old"), edges))))
    assert rows < 10_000  # 150 * 150 pairs, and again for each signal, before
    best = {r.new_id: r.old_id for r in found}
    # the same last word counts most, then a neighbour in common, then the smaller id
    rank = lambda i, j: (-(i % 7 == j % 7), -(i % 2 == j % 2 == 0 and i % 3 == j % 3), f"old{j}")
    top = {f"new{i}": min(range(n), key=lambda j: rank(i, j)) for i in range(n)}
    scores = {(r.new_id, r.old_id): r for r in rs.signals(make("new"), make("old"), edges).collect()}
    assert len(scores) == n * n
    for i in range(n):
        assert scores[f"new{i}", f"old{top[f'new{i}']}"].shared_relationships == float(i % 2 == 0)
        assert best[f"new{i}"] in (None, f"old{top[f'new{i}']}")
    assert all(r.shared_relationships == float(int(r.new_id[3:]) % 2 == int(r.old_id[3:]) % 2 == 0 and int(r.new_id[3:]) % 3 == int(r.old_id[3:]) % 3) for r in scores.values())


def test_signals_and_scores_of_pairs_are_not_shuffled(spark):
    make = lambda s: spark.range(120).selectExpr(f"concat('{s}', id) as id", "'CONCEPT' as node_type", f"concat('the {s} ', id) as title", "cast(null as string) as properties", "array('A') as networks", "timestamp'2024-01-01' as created_at")
    edges = spark.createDataFrame([("new1", "m"), ("new1", "k"), ("old2", "m")], "source_id string, target_id string")
    found, rows = shuffled(spark, lambda: rs.combined(rs.signals(make("new"), make("old"), edges)))
    assert len(found) == 120 * 120 and rows < 5_000
    assert {(r.new_id, r.old_id): r.shared_relationships for r in found if r.shared_relationships} == {("new1", "old2"): 0.5}


def test_context_of_a_hub(spark):
    others = [f"o{i:03d}" for i in range(200)]
    near = [("hub", x) for x in [*others, "hub", "small"]] + [("small", x) for x in ("hub", "o001", "p", "q")]
    named = [(f"c{i}", "hub") for i in range(200)] + [("c0", "small"), ("c1", "o005"), ("d", "small"), ("d", "none")]
    want = {(c, o) for c, x in named for y, o in near if x == y and (c, o) not in named}
    make = lambda: views.context(spark.createDataFrame(named, "capture_id string, id string"), spark.createDataFrame(near, "id string, other_id string"), 10)
    found, rows = shuffled(spark, make)
    assert len(found) == len(want) and {(r.capture_id, r.id) for r in found} == want
    assert rows < 20_000  # each of 200 captures with each of 200 neighbours before


def test_resolution_moves_no_edges_of_other_nodes(spark):
    make = lambda s: spark.range(20).selectExpr(f"concat('{s}', id) as id", "'CONCEPT' as node_type", f"concat('the {s} ', id) as title", "cast(null as string) as properties", "array('A') as networks", "timestamp'2024-01-01' as created_at")
    # every node of a side twice with m and once with a node of its own, in either direction
    own = [(f"{s}{i}", x) for s in ("new", "old") for i in range(20) for x in ("m", f"x{s}{i}")] + [("m", f"{s}{i}") for s in ("new", "old") for i in range(20)]
    others = spark.range(30_000).selectExpr("concat('a', id) as source_id", "concat('b', id) as target_id")
    edges = spark.createDataFrame(own, "source_id string, target_id string").union(others)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids of the nodes were many
    try:
        found, rows = shuffled(spark, lambda: rs.signals(make("new"), make("old"), edges))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.new_id, r.old_id): r.shared_relationships for r in found} == {(f"new{i}", f"old{j}"): 0.5 for i in range(20) for j in range(20)}
    assert rows < 5_000  # 120,000 before: both ends of every edge, twice


def test_scores_of_names_with_other_spaces(spark):
    rows = lambda **titles: spark.createDataFrame([(k, "CONCEPT", v, None, ["A"], None) for k, v in titles.items()], "id string, node_type string, title string, properties string, networks array<string>, created_at timestamp")
    edges = spark.createDataFrame([], "source_id string, target_id string")
    old = rows(o1="solid effect", o2="Solid principle\u00a0", o3="\u3000")
    found = rs.combined(rs.signals(rows(n1="\u2009Solid effect", n2="solid Principle"), old, edges)).collect()
    # each title is that of one old node but for its spaces; the other two share one word of three
    assert {(r.new_id, r.old_id): round(r.exact_name, 6) for r in found} == {("n1", "o1"): 1.0, ("n1", "o2"): 0.2, ("n2", "o1"): 0.2, ("n2", "o2"): 1.0}


@pytest.mark.parametrize("hub", (10, 1000))
def test_pairs_of_predicted_links_are_not_shuffled(spark, hub):
    """Nor are the neighbours of a hub copied for each block: two hubs, one link between leaves."""
    leaves = [f"l{i:03d}" for i in range(300)]
    links = spark.createDataFrame([("hub", x, 1.0) for x in leaves] + [("all", x, 1.0) for x in leaves[::2]] + [("l000", "l001", 1.0)], "a string, b string, weight double").selectExpr("least(a, b) as a", "greatest(a, b) as b", "weight")
    found, rows = shuffled(spark, lambda: g.link_scores(links, block=20, hub=hub))
    near = {}
    for a, b, _ in links.collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    common = {(a, b): near[a] & near[b] for a in near for b in near if a < b and b not in near[a] and near[a] & near[b]}
    score = {k: 0.6 * sum(1 / math.log(len(near[x])) for x in c) + 0.4 * len(c) / math.sqrt(len(near[k[0]]) * len(near[k[1]])) for k, c in common.items()}
    assert len(found) == len(common) > 40_000
    assert {(r.a, r.b): r.n_common for r in found} == {k: len(c) for k, c in common.items()}
    assert all(r.score == pytest.approx(score[r.a, r.b], abs=1e-6) for r in found)
    assert rows < 6_000  # all pairs, or each leaf for each of 15 blocks, before
