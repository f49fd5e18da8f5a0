import json
import math
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scores as sc
from loomgraph.operators import writes as wr
from loomgraph.sources import store, vault
from loomgraph.streaming import events as ev


def test_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/One.md").write_text("---\ntitle: First\ntags: [x, y]\ntype: note\n---\nSee [[Two|that]] and #z/w here\n")
    (tmp_path / "a/Two.md").write_text("no block, [[One]]")
    (tmp_path / ".git/skip.md").write_text("x")
    (tmp_path / "a/other.txt").write_text("x")
    notes = vault.read_notes(spark, str(tmp_path))
    got = {r.title: r for r in notes.collect()}
    assert set(got) == {"First", "Two"}
    assert got["First"].tags == ["x", "y", "z/w"] and got["First"].links == ["Two"] and got["First"].kind == "note"
    raw = {r.raw_content for r in vault.note_captures(notes).collect()}
    assert any(x.startswith("Note: First\nType: note\nTags: x, y, z/w\nLinks to: Two\n\n") for x in raw)


def test_calendars(spark, tmp_path):
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  title\r\nDTSTART:20240105T101500Z\r\nATTENDEE;CN=x:mailto:a@b.example\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240107\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    got = {r.uid: r for r in vault.read_calendars(spark, str(tmp_path)).collect()}
    assert got["1"].summary == "Long title" and str(got["1"].starts_at) == "2024-01-05 10:15:00" and got["1"].participants == ["a@b.example"]
    assert str(got["2"].starts_at) == "2024-01-07 00:00:00"
    assert vault.read_calendars(spark, str(tmp_path), "2024-01-06").count() == 1
    assert any(r.raw_content.startswith("Calendar Event: Long title\nDate: 2024-01-05 10:15") for r in vault.calendar_captures(vault.read_calendars(spark, str(tmp_path))).collect())


def test_html(spark):
    row = spark.createDataFrame([("<p>A &amp; <b>b</b><script>x()</script></p><!-- no -->",)], "h string").select(vault.html_text(F.col("h")).alias("t")).first()
    assert row.t == "A & b"


def test_store_versions(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g", keep=2)
    for n in (1, 2, 3):
        assert s.write("nodes", spark.range(n)) == n
    assert s.versions("nodes") == [2, 3] and s.read("nodes").count() == 3
    s.restore("nodes", 2)
    assert s.read("nodes").count() == 2 and s.current("nodes") == 2
    with pytest.raises(ValueError):
        s.restore("nodes", 1)
    with pytest.raises(FileNotFoundError):
        s.read("edges")


def test_proposals_are_all_or_nothing(spark, tmp_path):
    good = {"proposal_id": "g", "nodes_to_create": [{"temp_id": "t1", "node_type": "PERSON", "title": "P", "confidence": 0.9}, {"temp_id": "t2", "node_type": "COMMITMENT", "title": "C", "confidence": 0.9}], "edges_to_create": [{"source_id": "t1", "target_id": "t2", "edge_type": "committed_to"}, {"source_id": "t2", "target_id": "old", "edge_type": "RELATED_TO"}]}
    bad = {"proposal_id": "b", "nodes_to_create": [{"temp_id": "t1", "node_type": "NOTE", "title": "N", "confidence": 0.9}], "edges_to_create": [{"source_id": "t1", "target_id": "old", "edge_type": "KNOWS"}]}
    (tmp_path / "g.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(bad))
    nodes = spark.createDataFrame([("old", "NOTE")], "id string, node_type string")
    new, edges, verdicts = wr.commit_proposals(nodes, vault.read_proposals(spark, str(tmp_path)))
    assert {(r.proposal_id, r.status, r.reason) for r in verdicts.collect()} == {("g", "approved", None), ("b", "rejected", "source_type")}
    assert new.count() == 2 and edges.count() == 2
    assert {r.id for r in new.collect()} == {r.id for r in wr.commit_proposals(nodes, vault.read_proposals(spark, str(tmp_path)))[0].collect()}


def test_merge_json_and_patch(spark):
    df = spark.createDataFrame([(1, '{"a": "1", "b": "2"}', '{"b": "3"}', "x"), (2, "broken", None, None)], "id int, p string, c string, t string")
    got = {r.id: json.loads(r.m) for r in df.select("id", wr.merge_json("p", "c").alias("m")).collect()}
    assert got == {1: {"a": "1", "b": "3"}, 2: {}}
    patched = wr.patch(df.select("id", "t"), spark.createDataFrame([(2, "new")], "id int, t string"), "id", ["t"])
    assert {(r.id, r.t) for r in patched.collect()} == {(1, "x"), (2, "new")}


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(sc.decay(at("2024-01-01"), at("2024-01-31"), F.lit(0.05), F.lit(0))) == pytest.approx(0.22313016)
    assert one(sc.decay(at("2024-02-01"), at("2024-01-31"), F.lit(0.05), F.lit(0))) == 1.0
    assert one(sc.name_similarity(F.lit("Sam Chen"), F.lit("sam chen "))) == 1.0
    for a, b, want in [("Sam Chen", "Sam Lee", 0.2), ("Eddy", "Eddy Paez", 0.85), ("Eddy Paez", "eddy", 0.85), ("Aisha", "Dr Aisha Nakamura", 0.7), ("Carlos Rivera", "Rivera Carlos", 0.6), ("", "x", 0.0), ("x y", "z", 0.0), ("abcdefghi", "abcdefghij", 0.9)]:
        assert one(sc.name_similarity(F.lit(a), F.lit(b))) == pytest.approx(want), (a, b)
    assert one(sc.review_fold(F.array(F.lit(5), F.lit(5), F.lit(5)))["interval_days"]) == 16
    assert one(sc.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(sc.tightest_window(F.lit(-1))) is None and one(sc.tightest_window(F.lit(2))) == 3


def test_relevance_of_active_and_dated_nodes(spark):
    """An open commitment and a future event stay at 1; the latest of access, own date and creation is the anchor; the first
    known network gives the rate, 0.01 without one."""
    node = "id string, node_type string, properties string, networks array<string>, last_accessed timestamp, created_at timestamp, access_count int"
    old, late = datetime(2024, 1, 1), datetime(2024, 1, 21)
    rows = [
        ("open", "COMMITMENT", '{"status": "Open"}', ["SOCIAL"], None, old, 0),
        ("ahead", "EVENT", '{"event_date": "2030-01-01"}', None, None, old, 0),
        ("own", "EVENT", '{"event_date": "2024-01-11T00:00:00+00:00"}', ["ODD", "SOCIAL"], None, old, 0),
        ("read", "NOTE", None, ["ACADEMIC"], late, old, 0),
        ("plain", "NOTE", None, [], None, old, None),
        ("often", "NOTE", None, ["ACADEMIC"], None, old, 9),
    ]
    got = {r.id: r.v for r in spark.createDataFrame(rows, node).select("id", sc.relevance(F.lit("2024-01-31").cast("timestamp")).alias("v")).collect()}
    e = math.exp
    want = {"open": 1.0, "ahead": 1.0, "own": e(-0.07 * 20), "read": e(-0.05 * 10), "plain": e(-0.01 * 30), "often": e(-0.05 / (1 + math.log(10)) * 30)}
    assert got == pytest.approx(want)


def test_fan_out(spark, tmp_path, sf):
    stream = ev.read_events(spark, f"{sf}/events.parquet")
    ev.fan_out(stream, {"all": ("*", f"{tmp_path}/all"), "p": ("purchase", f"{tmp_path}/p")}, f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/all").count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(f"{tmp_path}/p").select("event_type").distinct().collect()[0][0] == "purchase"
    assert not spark.range(1).select(F.lit("a.b").alias("event_type")).where(~ev.matches("a.*")).count()


def test_late_rows_fall_behind_the_watermark(spark, tmp_path):
    """Four files, one a trigger: a row behind the watermark of the trigger before is left out, one within it counts."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    files = [[(1, at(0, 5)), (2, at(0, 50))], [(3, at(3, 0)), (4, at(2, 55))], [(8, at(3, 1))], [(5, at(0, 10)), (6, at(2, 52)), (7, at(9, 0))]]
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, t, 1, "click", 1.0, None) for i, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    stream = ev.read_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    closed = {(r.start.hour, r.n) for r in ev.drain(ev.windowed(stream, "1 hour"), "late", "append").collect()}
    assert closed == {(0, 2), (2, 2), (3, 2)}  # event 5 came too late for hour 0, event 6 was in time for hour 2
    sessions = sorted((r.start.hour, r.n) for r in ev.drain(ev.sessions(stream, "30 minutes"), "late-sessions", "append").collect())
    assert sessions == [(0, 1), (0, 1), (2, 4)]


def test_all_connectors_at_once(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\nbody")
    (tmp_path / "b.ics").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:S\nDTSTART:20240101T100000Z\nDTEND:20240101T110000Z\nEND:VEVENT\nEND:VCALENDAR\n")
    got = {json.loads(r.metadata)["connector"]: r.raw_content for r in vault.sync_all(spark, str(tmp_path)).collect()}
    assert got.keys() == {"markdown", "calendar"} and "body" in got["markdown"] and "Calendar Event: S" in got["calendar"]


def test_migrations(spark):
    from loomgraph.sources import migrations as mg

    old = spark.createDataFrame([("a", None)], "id string, tags array<string>")
    new = mg.upgraded(old, "nodes")
    assert new.columns == ["id", "tags", "review_date", "deleted"] and dict(new.dtypes)["deleted"] == "boolean" and new.first().deleted is None
    assert mg.upgraded(new, "nodes").columns == new.columns and mg.upgraded(old, "nodes", to=2).columns == ["id", "tags", "review_date"]
    assert mg.taken_back(new, "nodes", 2).columns == ["id", "tags", "review_date"] and mg.taken_back(new, "nodes", 1).columns == ["id"]
    done = spark.createDataFrame([(2,), (3,)], "version int")
    assert {r.version for r in mg.versions(spark, done).collect()} == {4, 5} and mg.versions(spark).count() == len(mg.STEPS)
