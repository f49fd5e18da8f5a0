import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as h

EDGE = "id string, source_id string, target_id string, edge_type string"


def brute(parent):
    out = {}
    for n in {*parent, *parent.values()}:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            out[n] = (min(ring), -1)
        else:
            out[n] = (x, len(seen))
    return out


def edges(spark, parent, rng=None):
    rows = []
    for k, (c, p) in enumerate(parent.items()):
        kind = (rng or random).choice(["PART_OF", "subtask_of", "Contains"])
        rows.append((str(k), *((p, c) if kind == "Contains" else (c, p)), kind))
    return spark.createDataFrame(rows, EDGE)


def tree(rng, n, loops):
    names = [f"n{i:03d}" for i in range(n)]
    parent = {names[i]: names[rng.randrange(max(0, i - 6), i)] for i in range(1, n) if rng.random() < 0.9}
    for _ in range(loops):
        a = rng.choice(names)
        parent[a] = rng.choice(names)
    return parent


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parent = tree(rng, 120, 3)
    want = brute(parent)
    got = {r.node_id: r for r in h.hierarchy(edges(spark, parent, rng)).collect()}
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == want
    for k, r in got.items():
        assert r.path[-1] == k and r.path[0] == r.root_id
        assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))
        ring = want[k][1] == -1 and any(parent.get(x) == k for x in parent) and k in _ring(parent, k)
        assert r.in_cycle == ring


def _ring(parent, n):
    seen, x = [], n
    while x in parent and x not in seen:
        seen.append(x)
        x = parent[x]
    return seen[seen.index(x) :] if x in seen else []


@pytest.mark.parametrize("with_paths", [True, False])
def test_the_limit_of_a_task_changes_no_row(spark, with_paths):
    """Trees, chains, stars and cycles with trees on them: the same rows whether a component is traversed or doubled."""
    parent = tree(random.Random(7), 90, 2) | {f"s{i}": "star" for i in range(40)} | {f"c{i:02d}": f"c{(i + 1) % 9:02d}" for i in range(9)} | {"c_leaf": "c04", "c_deep": "c_leaf", "self": "self"}
    e = edges(spark, parent, random.Random(1))
    rows = lambda df: {r.node_id: (r.root_id, r.depth, r.path, r.n_descendants, r.in_cycle, r.back_edge_to) for r in df.collect()}
    want = rows(h.hierarchy(e, with_paths=with_paths))
    for limit in (2, 30):
        assert rows(h.hierarchy(e, max_component=limit, with_paths=with_paths)) == want
    assert (want["star"][2] is None) == (not with_paths) and want["star"][3] == 40 and want["c_deep"][3] == 0


def test_descendants(spark):
    e = edges(spark, {"b": "a", "c": "b", "d": "b"}, random.Random(2))
    got = {tuple(r) for r in h.descendants(h.hierarchy(e)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_defined_cases(spark):
    rows = [("1", "x", "x", "PART_OF"), ("2", None, "y", "PART_OF"), ("3", "c", "p", "part_of"), ("3", "c", "p", "part_of"), ("4", "p", "c", "CONTAINS"), ("5", "q", "r", "KNOWS"), ("6", None, None, None)]
    e = spark.createDataFrame(rows, EDGE).withColumn("parent", F.lit("clash")).withColumn("comp", F.lit(1))
    got = {(r.node_id, r.root_id, r.depth) for r in h.hierarchy(e, with_paths=False).collect()}
    assert got == {("x", "x", -1), ("p", "p", 0), ("c", "p", 1)}
    assert h.hierarchy(spark.createDataFrame([], EDGE)).count() == 0


def test_deep_chain(spark):
    parent = {f"{i:05d}": f"{i - 1:05d}" for i in range(1, 1500)}
    got = {r.node_id: r.depth for r in h.hierarchy(edges(spark, parent, random.Random(0)), with_paths=False).collect()}
    assert got["01499"] == 1499 and len(got) == 1500
