import heapq
import math
import random

import pytest

from loomgraph.operators import graph as g
from loomgraph.operators.lookup import OWNER
from loomgraph.operators.temporal import as_of_join, burst_windows
from loomgraph.plans import compositions, graphs


def links(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in pairs], "a string, b string, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(5)
    pairs = {}
    for _ in range(60):
        a, b = rng.sample([f"n{i:02d}" for i in range(30)], 2)
        pairs[min(a, b), max(a, b)] = rng.choice([0.25, 0.5, 1.0, 2.0])
    return [(a, b, w) for (a, b), w in pairs.items()]


def near(pairs):
    out = {}
    for a, b, w in pairs:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def test_components_and_cuts(spark, random_graph):
    n = near(random_graph)

    def reach(start, without=()):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in n.get(x, ()):
                if (min(x, y), max(x, y)) not in without and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    got = {r.id: r.label for r in g.components(links(spark, random_graph)).collect()}
    assert got == {x: min(reach(x)) for x in n}
    cuts = {(a, b) for a, b, _ in random_graph if b not in reach(a, {(a, b)})}
    assert {(r.a, r.b) for r in g.cut_links(links(spark, random_graph)).collect()} == cuts


def test_costs_and_k_paths(spark, random_graph):
    n = near(random_graph)
    cost, heap = {}, [(0.0, "n00")]
    while heap:
        c, x = heapq.heappop(heap)
        if x in cost:
            continue
        cost[x] = c
        for y, w in n.get(x, {}).items():
            heapq.heappush(heap, (c + 1 / max(w, 0.01), y))
    got = {r.id: r.cost for r in g.cheapest_costs(links(spark, random_graph), ids(spark, "n00")).collect()}
    assert got == pytest.approx(cost)

    paths = []

    def walk(path, c):
        if path[-1] == "n07":
            paths.append((round(c, 6), path))
            return
        if len(path) <= 5:
            for y, w in n.get(path[-1], {}).items():
                if y not in path:
                    walk([*path, y], c + 1 / max(w, 0.01))

    walk(["n00"], 0.0)
    paths.sort(key=lambda x: (x[0], len(x[1]), ",".join(x[1])))
    found = g.k_paths(links(spark, random_graph), ids(spark, "n00"), ids(spark, "n07"), 3, 5).collect()
    assert [(r.cost, r.path) for r in found] == paths[:3]


def test_betweenness_of_all_sources(spark, random_graph):
    n = near(random_graph)
    want = dict.fromkeys(n, 0.0)
    for s in n:
        order, sigma, dist, before = [], {s: 1.0}, {s: 0}, {s: []}
        todo = [s]
        while todo:
            x = todo.pop(0)
            order.append(x)
            for y in n[x]:
                if y not in dist:
                    dist[y], sigma[y], before[y] = dist[x] + 1, 0.0, []
                    todo.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    before[y].append(x)
        delta = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for p in before[x]:
                delta[p] += sigma[p] / sigma[x] * (1 + delta[x])
            if x != s:
                want[x] += delta[x]
    got = {r.id: r.betweenness for r in g.betweenness(links(spark, random_graph), ids(spark, *n)).collect()}
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want)


def test_betweenness_and_hub_scores_of_every_node(spark, tmp_path):
    """A path of 8 nodes and two without a link: exact, as there are fewer nodes than sources."""
    path = [f"n{i:02d}" for i in range(8)]
    spark.createDataFrame([(x, False) for x in [*path, "x", "y"]], "id string, deleted boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(a, b, 1.0, True) for a, b in zip(path, path[1:])], "source_id string, target_id string, weight double, bidirectional boolean").write.parquet(f"{tmp_path}/edges.parquet")
    want = {x: 2 * i * (7 - i) / (9 * 8) for i, x in enumerate(path)} | {"x": 0.0, "y": 0.0}
    assert {r.id: r.betweenness for r in graphs.betweenness(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-8)
    nodes, edges = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("nodes", "edges"))
    ranks = {r.id: r["rank"] for r in g.pagerank(nodes, edges, graphs.ROUNDS).collect()}
    degree = {x: (2 - (x in (path[0], path[-1]))) / 9 for x in path} | {"x": 0.0, "y": 0.0}
    hubs = {r.id: r.score for r in compositions.hub_scores(spark, str(tmp_path)).collect()}
    assert hubs == pytest.approx({x: 0.4 * degree[x] + 0.3 * want[x] + 0.3 * ranks[x] for x in want}, abs=1e-8)


def test_betweenness_of_a_sample_is_scaled(spark):
    """All nodes of a ring are alike: of any sample, the mean over the nodes is the exact value."""
    ring = [f"r{i:02d}" for i in range(9)]
    nodes = spark.createDataFrame([(x, False) for x in ring], "id string, deleted boolean")
    own = links(spark, [(a, b, 1.0) for a, b in zip(ring, [*ring[1:], ring[0]])])
    exact = [r.betweenness for r in g.normalised_betweenness(nodes, own, 9).collect()]
    sampled = [r.betweenness for r in g.normalised_betweenness(nodes, own, 3).collect()]
    assert len(sampled) == 9 and sum(sampled) / 9 == pytest.approx(exact[0])


def test_predicted_links_of_all_pairs(spark, tmp_path, random_graph):
    pairs = [*random_graph, *((OWNER, f"n{i:02d}", 1.0) for i in range(0, 30, 2)), (OWNER, "alone", 1.0)]
    n = near(pairs)
    spark.createDataFrame([(x, False) for x in n], "id string, deleted boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame(pairs, "source_id string, target_id string, weight double").write.parquet(f"{tmp_path}/edges.parquet")
    want = {}
    for a in n:
        for b in n:
            common = n[a].keys() & n[b].keys()
            if a < b and b not in n[a] and common:
                adamic = sum(1 / math.log(len(n[x])) for x in common if len(n[x]) > 1)
                want[a, b] = (len(common), pytest.approx(0.6 * adamic + 0.4 * len(common) / max(math.sqrt(len(n[a]) * len(n[b])), 1), abs=1e-6))
    assert any(v[0] == 1 for v in want.values())
    assert {(r.a, r.b): (r.n_common, r.score) for r in graphs.predicted_links(spark, str(tmp_path)).collect()} == want
    blocked = g.link_scores(links(spark, pairs), block=3).collect()
    assert len(blocked) == len(want) and {(r.a, r.b): (r.n_common, r.score) for r in blocked} == want


@pytest.mark.parametrize("hub", (4, 8))
def test_predicted_links_of_hubs(spark, random_graph, hub):
    """Pairs that share several hubs, hubs and other nodes, or only other nodes, each once."""
    pairs = [*random_graph, *((OWNER, f"n{i:02d}", 1.0) for i in range(0, 30, 2)), (OWNER, "alone", 1.0)]
    n = near(pairs)
    common = {(a, b): n[a].keys() & n[b].keys() for a in n for b in n if a < b and b not in n[a]}
    want = {k: (len(c), pytest.approx(0.6 * sum(1 / math.log(len(n[x])) for x in c if len(n[x]) > 1) + 0.4 * len(c) / math.sqrt(len(n[k[0]]) * len(n[k[1]])), abs=1e-6)) for k, c in common.items() if c}
    assert any(sum(len(n[x]) >= 4 for x in c) > 1 for c in common.values())
    got = g.link_scores(links(spark, pairs), block=8, hub=hub).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.n_common, r.score) for r in got} == want


def test_ranks_sum_to_one(spark):
    nodes = spark.createDataFrame([(x, False) for x in "abcd"], "id string, deleted boolean")
    edges = spark.createDataFrame([("a", "b", None, False), ("b", "c", 2.0, True), ("x", "a", 1.0, False)], "source_id string, target_id string, weight double, bidirectional boolean")
    ranks = {r.id: r["rank"] for r in g.pagerank(nodes, edges, 20).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and len(ranks) == 4
    order = g.ordinal_rank(g.pagerank(nodes, edges, 5).withColumnRenamed("rank", "score"), "score").collect()
    assert sorted(r["rank"] for r in order) == [1, 2, 3, 4]


def test_empty_graph(spark):
    none = links(spark, [])
    assert g.components(none).count() == 0
    assert g.cut_links(none).count() == 0
    assert g.label_propagation(none, 2).count() == 0
    assert g.link_scores(none).count() == 0
    assert g.shortest_paths(none, ids(spark, "a"), 3).count() == 1


def test_bursts_and_as_of(spark):
    days = spark.sql("select date_add(date'2024-01-01', cast(id as int)) day, if(id between 10 and 13, 50L, 1L) n from range(30)")
    got = burst_windows(days, 3, 2.0).collect()
    assert got and all((b.day - a.last_day).days >= 1 for a, b in zip(got, got[1:]))
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 5)], "i int, key string, at int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "key string, at int, v string")
    assert {(r.i, r.as_of_value) for r in as_of_join(left, right, "key", "at", "v").collect()} == {(1, "y"), (2, None), (3, None)}
