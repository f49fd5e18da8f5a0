import json
import random

from pyspark.sql import functions as F

from loomgraph.llm import merkle as m

CAPTURE = "id string, raw_content string, extra string"
NODE = "id string, node_type string, title string, digest string"


def test_forms_of_one_record():
    a = "Note: The Plan\nDate: 2024-01-02\nTags: a, b\n\nBody goes here, twice."
    b = "TAGS : A B\r\n\r\ndate:2024.01.02\r\nNote:the plan\r\n\r\n\r\n[body  goes here twice]"
    c = json.dumps({"date": "20﻿24-01-02", "tags": "a, b", "text": "BODY GOES HERE; TWICE", "note": "the-plan"})
    assert len({m.capture_canonical(x) for x in (a, b, c)}) == 1
    assert len({m.capture_digest(x) for x in (a, b, c)}) == 1
    other = [a.replace("Plan", "Plans"), a.replace("Tags", "Type"), a + " more", "Idea: x\n\n" + a]
    assert len({m.capture_digest(x) for x in [a, *other]}) == 5


def test_nested_records_have_unordered_members_and_ordered_lists():
    x = json.dumps({"a": {"p": 1, "q": ["x", {"k": 2}]}, "text": "t"})
    y = json.dumps({"text": "T.", "a": {"q": ["X", {"k": 2}], "p": "1"}})
    z = json.dumps({"text": "t", "a": {"q": [{"k": 2}, "x"], "p": 1}})
    assert m.capture_digest(x) == m.capture_digest(y) != m.capture_digest(z)
    assert m.capture_canonical(x) == m.capture_canonical(y) != m.capture_canonical(z)


def test_found_against_brute_force(spark):
    rng = random.Random(1)
    captures = []
    for i in range(120):
        k = rng.randrange(15)
        fields = [("Note", f"title {k}"), ("Type", "memo")]
        rng.shuffle(fields)
        body = f"body {k} of it"
        text = rng.choice([body.upper(), body + "!"])
        captures.append((f"c{i:03d}", "\n".join(f"{a}: {b}" for a, b in fields) + "\n\n" + text if k % 2 else text, "x"))
    nodes = [(f"n{i:02d}", rng.choice(["NOTE", "IDEA", "PERSON"]), rng.choice(["Straße A", "STRASSE-a", "other", None]), "d") for i in range(60)]
    want = set()
    for name, rows, key in (("captures", captures, lambda r: m.capture_canonical(r[1])), ("nodes", [n for n in nodes if n[1] != "PERSON" and n[2]], lambda r: (r[1], m.norm(r[2])))):
        first = {}
        for r in sorted(rows):
            k = key(r)
            if k in first:
                want.add((name, first[k], r[0]))
            else:
                first[k] = r[0]
    c, n = spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(nodes, NODE)
    assert {tuple(r) for r in m.found(c, n).collect()} == want
    counts = {(r.table_name, r.keep_id): r.n_rows for r in m.copy_counts(c, n).collect()}
    assert sum(v - 1 for v in counts.values()) == len(want)


def test_defined_cases(spark):
    c = spark.createDataFrame([("a", None, None), ("b", "", None), ("c", "?!", None), ("d", "{broken", None), ("e", "Broken", None), ("f", "x" * 200_000, None), ("g", "X" * 200_000 + ".", None), (None, "", None)], CAPTURE)
    n = spark.createDataFrame([("n", "NOTE", None, None), ("o", None, "T", None), ("p", None, "t.", None)], NODE)
    got = {tuple(r) for r in m.found(c, n).collect()}
    assert got == {("captures", "b", "c"), ("captures", "d", "e"), ("captures", "f", "g"), ("nodes", "o", "p")}
    assert m.found(c.where("false"), n.where("false")).count() == 0
    assert m.found(c.withColumn("keep_id", F.lit(1)).withColumn("form", F.lit(2)), n).count() == 4
    again = c.where("id = 'b'")
    assert m.found(again.union(again), n.where("false")).count() == 0


def test_a_group_with_a_third_of_all_rows_stays_spread(spark):
    rows = [(f"n{i:05d}", "NOTE", "The Same Title!" if i % 3 == 0 else f"title {i}", "d") for i in range(6000)]
    out = m.copies(spark.createDataFrame([], CAPTURE), spark.createDataFrame(rows, NODE).repartition(4))
    assert out.count() == 2000 and {(r.keep_id, r.n) for r in out.collect()} == {("n00000", 2000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by = [r["count"] for r in m.copies(spark.createDataFrame([], CAPTURE), spark.createDataFrame(rows, NODE).repartition(4)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(by) < 0.6 * sum(by)
