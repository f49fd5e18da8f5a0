"""Values of the core queries that have no oracle SQL, on the smallest tables, against plain Python."""

import re
from collections import Counter, defaultdict, deque

import pytest

from loomgraph.plans import registry
from tests.compare import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def graph(sf):
    near = defaultdict(dict)
    for a, b, w in oracle(sf, SQL["simple_links"]).fetchall():
        near[a][b] = near[b][a] = w
    return near


def rows(spark, sf, name):
    return [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def hops_from(near, start):
    hops, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in hops:
                hops[y] = hops[x] + 1
                queue.append(y)
    return hops


def test_shortest_paths(spark, sf, graph):
    got = QUERIES["shortest_paths"](spark, sf).collect()
    start = next(r.id for r in got if r.hops == 0)
    want = {k: h for k, h in hops_from(graph, start).items() if h <= 6}
    assert {r.id: r.hops for r in got} == want
    for r in got:
        p = r.path.split(",")
        assert p[0] == start and p[-1] == r.id and len(p) == r.hops + 1 and all(b in graph[a] for a, b in zip(p, p[1:]))


def test_cut_links(spark, sf, graph):
    def parts():
        seen, n = set(), 0
        for x in graph:
            if x not in seen:
                n += 1
                seen |= hops_from(graph, x).keys()
        return n

    before, want = parts(), set()
    leaves = {x for x in graph if len(graph[x]) == 1}
    for a in list(graph):
        for b in list(graph[a]):
            if a < b:
                if a in leaves or b in leaves:
                    want.add((a, b))
                    continue
                if not set(graph[a]) & set(graph[b]):  # no triangle: it may be a cut
                    w = graph[a].pop(b)
                    graph[b].pop(a)
                    if b not in hops_from(graph, a):
                        want.add((a, b))
                    graph[a][b] = graph[b][a] = w
    assert set(rows(spark, sf, "cut_links")) == want and parts() == before


@pytest.mark.parametrize("name", ["three_paths", "three_paths_aside"])
def test_three_paths(spark, sf, graph, name):
    got = rows(spark, sf, name)
    (first,) = {r[0].split(",")[0] for r in got} or {None}
    assert got and [c for _, c in got] == sorted(c for _, c in got)
    goal = got[0][0].split(",")[-1]
    owner = "00000000-0000-0000-0000-000000000001"
    best = []

    def walk(path, cost, most):
        if cost > most + 1e-5:
            return
        if path[-1] == goal:
            best.append((round(cost, 6), len(path), ",".join(path)))
            return
        for y, w in graph[path[-1]].items():
            if y not in path and not (name.endswith("aside") and y == owner):
                walk([*path, y], cost + 1 / max(w, 0.01), most)

    walk([first], 0.0, got[-1][1])
    assert [(c, p) for p, c in got] == [(c, p) for c, _, p in sorted(best)[:3]]


def test_rank_order(spark, sf):
    want = [r[0] for r in sorted(oracle(sf, SQL["pagerank"]).fetchall(), key=lambda r: (-round(r[1], 9), r[0]))]
    got = [i for i, _ in sorted(rows(spark, sf, "pagerank_order"), key=lambda r: r[1])]
    assert len(got) == len(want) and got[:50] == want[:50] and set(got) == set(want)


def test_all_patterns_are_those_of_the_detectors(spark, sf):
    names = [n for n in SQL if n.startswith("pattern_") and n not in ("pattern_communities", "pattern_outcomes", "pattern_evidence", "pattern_warnings")]
    want = {(p, s) for n in names for p, s in oracle(sf, f"SELECT pattern, subject FROM ({SQL[n]})").fetchall()}
    got = {r[:2] for r in rows(spark, sf, "patterns_all")}
    assert want <= got and {p for p, _ in got - want} <= {"activity_change", "idle_people", "stalled_goals", "undecided"}


def test_reconciled_patterns(spark, sf):
    states = Counter(r[2] for r in rows(spark, sf, "patterns_reconciled"))
    assert set(states) <= {"new", "confirmed", "resolved"} and states["confirmed"] + states["new"] == len(rows(spark, sf, "patterns_all"))


def test_committed_proposals(spark, sf):
    by = dict(oracle(sf, "SELECT source_capture_id, count(*) FROM nodes WHERE NOT coalesce(deleted, false) AND source_capture_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2").fetchall())
    got = {r[0]: r[1:] for r in rows(spark, sf, "proposals_committed")}
    assert got.keys() == by.keys() and all((s == "rejected") == (why is not None) for s, why in got.values())


def test_betweenness(spark, sf, graph):
    """Brandes' algorithm from all nodes: the smallest tables have more nodes than sources, so the sample is compared."""
    got = dict(rows(spark, sf, "betweenness"))
    total, n = dict.fromkeys(got, 0.0), len(got)
    for s in graph:
        order, paths, pred = [], Counter({s: 1}), defaultdict(list)
        dist, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in graph[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
                    pred[y].append(x)
        gain = Counter()
        for y in reversed(order):
            for x in pred[y]:
                gain[x] += paths[x] / paths[y] * (1 + gain[y])
            if y != s and y in total:
                total[y] += gain[y]
    exact = {k: v / ((n - 1) * (n - 2)) for k, v in total.items()}
    error = sum(abs(got[k] - exact[k]) for k in got) / n
    assert error < 0.01 and max(exact, key=exact.get) == max(got, key=got.get)


def test_question_words(spark, sf):
    titles = dict(oracle(sf, "SELECT id, title FROM nodes WHERE title IS NOT NULL AND NOT coalesce(deleted, false)").fetchall())
    got = {r[0]: r[1:] for r in rows(spark, sf, "query_names")}
    assert got.keys() == titles.keys()
    for i, (names, focus, intent) in got.items():
        kind = len(titles[i]) % 3
        assert intent == ("question" if kind == 0 else "profile")
        if kind == 0:
            assert focus is not None and "status" in focus.split()
        plain = [w for w in re.split(r"\s+", titles[i]) if re.fullmatch(r"[A-Z][a-z]+", w)]
        assert set(plain) - {"What", "The", "A", "An", "My", "Our", "This", "That"} <= set(names.split("|")) | {w for w in plain if w in ("How", "Who", "Where", "When", "Why", "Is", "Are", "Do", "Can", "Will", "Get", "Give", "Show", "Tell", "Has", "Have")}


def test_what_is_sent_out(spark, sf):
    for _, text in rows(spark, sf, "queries_sent_out"):
        assert not re.search(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{4}-\d{2}-\d{2}\b", text)


def test_hierarchy_rows(spark, sf):
    found = {r[0]: r[1:] for r in oracle(sf, SQL["p1_found"]).fetchall()}
    for r in QUERIES["p1_hierarchy"](spark, sf).collect():
        assert (r.root_id, r.depth) == found[r.node_id]
        p = r.path.split("/")
        assert p[0] == r.root_id and p[-1] == r.node_id and (r.depth == -1 or len(p) == r.depth + 1)
