import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import merkle
from loomgraph.llm import near_copies as nc

TEXT = "table_name string, id string, text string"


def brute(rows):
    out = set()
    sets = {}
    for t, i, x in rows:
        w = nc.words_of(x or "")
        if len(w) >= 30:
            sets[t, i] = (w, set(zip(w, w[1:], w[2:])), x)
    for (t, i), (w, s, x) in sets.items():
        for (u, j), (v, r, y) in sets.items():
            if t == u and i < j and "".join(w) != "".join(v) and 10 * len(s & r) >= 7 * len(s | r):
                if t != "captures" or merkle.capture_canonical(x) != merkle.capture_canonical(y):
                    out.add((t, i, j))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(28, 70))]
        for k in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(0, 2)] = [rng.choice(vocabulary)] * rng.randrange(0, 2)
            text = " ".join(v)
            rows.append((rng.choice(["captures", "nodes"]), f"i{i:03d}{k}", rng.choice([text, text.upper() + ".", text.replace(" ", ", ")])))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {tuple(r) for r in nc.near_copies(spark.createDataFrame(rows, TEXT)).collect()}
        want = brute(rows)
        assert got == want and want


def test_a_class_of_copies_links_to_its_variant(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [("nodes", f"c{i:02d}", base) for i in range(40)] + [("nodes", "v", base + " more words")]
    got = {tuple(r) for r in nc.near_copies(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {("nodes", f"c{i:02d}", "v") for i in range(40)}


def test_bounds():
    n = np.arange(1, 200)
    p = nc.prefix_length(n, 7, 10)
    for k, x in zip(n, p):
        least = -(-7 * int(k) // 10)
        assert x == k - least + 1
    h = nc.ShingleHasher()
    a, b = h("a b c d e".split()), h("a b c d e".split())
    assert (a == b).all() and len(a) == 3


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [("nodes", "a", None), ("nodes", "b", ""), ("nodes", "c", "short"), ("nodes", None, long), ("nodes", "d", long), ("nodes", "e", long + " y"), ("nodes", "e", long + " y")]
    df = spark.createDataFrame(rows, TEXT).withColumn("ref", F.lit("clash")).withColumn("sig", F.lit(1))
    assert {tuple(r) for r in nc.near_copies(df).collect()} == {("nodes", "d", "e")}
    assert nc.near_copies(df.where("false")).count() == 0


def test_link_counts(spark):
    """One row for each long text, with the smallest id of its words and the number of linked classes."""
    rows = corpus(3)
    links = {}
    words = {(t, i): " ".join(nc.words_of(x)) for t, i, x in rows if len(nc.words_of(x)) >= 30}
    sets = {k: set(zip(w.split(), w.split()[1:], w.split()[2:])) for k, w in words.items()}
    for (t, i), s in sets.items():
        near = {words[u, j] for (u, j), r in sets.items() if t == u and words[t, i].replace(" ", "") != words[u, j].replace(" ", "") and 10 * len(s & r) >= 7 * len(s | r)}
        links[t, i] = (min(j for (u, j), w in words.items() if u == t and w == words[t, i]), len(near))
    got = {(r.table_name, r.id): (r.class_id, r.n_links) for r in nc.link_counts(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == links


def test_a_class_with_a_third_of_all_rows_is_not_expanded(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [("nodes", f"c{i:04d}", base) for i in range(1500)] + [("nodes", "v", base + " more words")] + [("nodes", f"x{i}", " ".join(f"b{i}_{k}" for k in range(40))) for i in range(300)]
    got = nc.link_counts(spark.createDataFrame(rows, TEXT)).collect()
    assert len(got) == len(rows) and {r.n_links for r in got if r.id.startswith("c")} == {1} and {r.class_id for r in got if r.id.startswith("c")} == {"c0000"}


def test_counters_grow_with_the_corpus_within_their_bound():
    assert nc.counters_for(0) == nc.COUNTERS and nc.counters_for(1 << 27) == 1 << 25 and nc.counters_for(10**13) == nc.MOST_COUNTERS
