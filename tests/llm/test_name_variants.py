import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import name_variants as nv

NODE = "id string, node_type string, title string, properties string, key string"


def person(i, name, org=None, mail=None, **more):
    return (i, "PERSON", name, json.dumps({"organization": org, "contact_info": {"email": mail} if mail else {}, **more}), "x")


def org(i, name, site=None, **more):
    return (i, "ORGANIZATION", name, json.dumps({"website": site, **more}), "x")


def test_pairs(spark):
    rows = [
        person("a1", "Elizabeth Brixcroft", "Vuvevos Chess Partners", "e.b@vuvevos.example"),
        person("a2", "Brixcroft, Liz", "VUVEVOS CHESS PARTNERS"),
        person("a3", "Elizabth Brixcroft", None, "E.B@VUVEVOS.EXAMPLE"),
        person("a4", "E. Brixcroft", "Vuveovs Chess Partners"),
        person("b1", "Elizabeth Brixcroft", "Timasad Academy", "e@timasad.example"),
        person("c1", "William Brixcroft", "Vuvevos Chess Partners", "w.b@vuvevos.example"),
        person("d1", "Elizabeth Brixcroft", "Vuvevos Chess Partners", "other@vuvevos.example"),
        org("o1", "Vuvevos Chess Partners", "www.vuvevos.example"),
        org("o2", "Partners of Vuvevos"),
        org("o3", "Vuvevso Chess Partners"),
        org("o4", "Timasad Academy"),
        ("n1", "NOTE", "Elizabeth Brixcroft", None, None),
    ]
    got = {tuple(r) for r in nv.variant_pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert {p for p in got if p[0][0] == "o"} == {("o1", "o2"), ("o1", "o3"), ("o2", "o3")}
    assert {("a1", "a2"), ("a1", "a3"), ("a2", "a3")} <= got
    assert not {p for p in got if {"b1", "c1"} & set(p)} and ("a1", "d1") not in got


def test_cosine_join_is_exact(spark):
    rng = random.Random(4)
    rows = [(f"i{i:02d}", g) for i in range(60) for g in {f"g{int(rng.expovariate(0.15))}" for _ in range(rng.randrange(2, 12))}]
    by, df = {}, {}
    for i, g in rows:
        by.setdefault(i, set()).add(g)
        df[g] = df.get(g, 0) + 1
    w = {g: math.log1p((len(by) + 1) / n) for g, n in df.items()}
    norm = {i: math.sqrt(sum(w[g] ** 2 for g in gs)) for i, gs in by.items()}
    for t in (0.3, 0.6):
        want = {(a, b): sum(w[g] ** 2 for g in by[a] & by[b]) / norm[a] / norm[b] for a in by for b in by if a < b}
        want = {k: v for k, v in want.items() if v >= t}
        got = {(r.a, r.b): r.cosine for r in nv.cosine_pairs(spark.createDataFrame(rows, "id string, gram string"), t).collect()}
        assert got == pytest.approx(want)


def test_names():
    same = [("deepa maldanbury", "maldanbury deepa"), ("elizabeth brixcroft", "liz brixcroft"), ("yelena vosordal", "yel vosordal"), ("haruto branatnova", "haruto braantnova"), ("k pardanbrow", "katherine pardanbrow")]
    other = [("william kreventari", "lucia kreventari"), ("sanja yarnnen", "sanja sorvnen"), ("a b", "a c")]
    assert all(nv.same_name(*p) for p in same) and not any(nv.same_name(*p) for p in other)
    assert nv.distance("abcd", "abdc", 2) == 1 and nv.distance("abc", "xyz", 1) == 2
    assert nv.person_form("Dr. Brixcroft, Elizabeth") == "elizabeth brixcroft" and nv.person_form("Lena") == ""
    assert nv.org_form("Group of Zasafel") == "zasafel group" and nv.org_form("The Semanis Energy Department of Studies") == "semanis energy department studies"


def test_average_linkage_keeps_contradictions_apart():
    c = nv.average_linkage(4, {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0})
    assert c[0] == c[1] and c[2] == c[3] and c[0] != c[2]
    assert len(set(nv.average_linkage(3, {}))) == 3
    c = nv.average_linkage(4, {(i, j): 1.0 for i in range(4) for j in range(i + 1, 4) if (i, j) != (0, 3)}, frozenset([0, 3]))
    assert c[0] != c[3] and c[0] == c[1] == c[2]


def test_the_cosines_decide_who_belongs_together():
    """A weak link between two close pairs is too little for one cluster, a strong one is enough."""
    close = [("a", "b", False, 0.9), ("c", "d", False, 0.9)]
    of = lambda links: dict(nv.clusters_of(links, set()))
    weak, strong = of([*close, ("b", "c", False, 0.35)]), of([*close, ("b", "c", False, 0.9)])
    assert weak["a"] == weak["b"] != weak["c"] == weak["d"] and len(set(strong.values())) == 1
    # one address makes one item, as near as the nearest of its people
    assert len(set(of([("a", "b", True, 1.0), ("a", "c", False, 0.3), ("b", "c", False, 0.9)]).values())) == 1


def test_top_partners(spark):
    grams = spark.createDataFrame([(i, g) for i, gs in (("a", "wxyz"), ("b", "wxyz"), ("c", "wxy"), ("d", "w"), ("e", "q")) for g in gs], "id string, gram string")
    all_ = {(r.a, r.b): r.cosine for r in nv.cosine_pairs(grams, 0.1).collect()}
    top = {(r.a, r.b): r.cosine for r in nv.cosine_pairs(grams, 0.1, 1).collect()}
    assert ("a", "b") in top and set(top) < set(all_) and all(abs(top[k] - all_[k]) < 1e-9 for k in top)
    for x in "abcd":
        mine = {k: c for k, c in all_.items() if x in k}
        assert any(abs(top.get(k, 0) - max(mine.values())) < 1e-9 for k in mine)


def test_entities_and_pairs_agree(spark):
    rows = [(f"p{i}", "PERSON", t, '{"organization": "Orgaaa One"}', None) for i, t in enumerate(["Maria Westmoor", "Maria Westmor", "Dr Maria Westmoor", "John Hadley"])]
    df = spark.createDataFrame(rows, NODE)
    e = {r.id: r.entity_id for r in nv.entities(df).collect()}
    pairs = {tuple(r) for r in nv.variant_pairs(df).collect()}
    assert pairs == {(a, b) for a in e for b in e if a < b and e[a] == e[b]} and ("p0", "p1") in pairs and e["p3"] == "p3"


def test_defined_cases(spark):
    rows = [("a", "PERSON", None, None, None), ("b", "PERSON", None, "broken", None), ("c", "PERSON", "", "[]", None), ("d", "ORGANIZATION", None, None, None), (None, "PERSON", "A Bbb", None, None), ("e", "PERSON", "A Bbbb", '{"organization": 5, "aliases": 7, "contact_info": "x"}', None), ("f", "PERSON", "x" * 5000, '{"organization": "Org"}', None), ("g", "PERSON", "Same Name", '{"organization": "Orgaaa One"}', None), ("h", "PERSON", "Same Name", '{"organization": "Orgaaa One"}', None)]
    df = spark.createDataFrame(rows, NODE).withColumn("names", F.lit(1)).withColumn("gram", F.lit(1))
    assert {tuple(r) for r in nv.variant_pairs(df).collect()} == {("g", "h")}
    assert nv.variant_pairs(df.where("false")).count() == 0
