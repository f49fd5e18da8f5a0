import json

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import personal as p

FAMILIES = ["maldanbury", "maldobury", "thorvescu", "thorvoescu", "branoquist", "branilquist", "elvakova", "elvinkova"]
ENDS = [f[:n] for f in FAMILIES for n in (3, 4)], [f[-n:] for f in FAMILIES for n in (3, 4)]
LEX = p.Lexicon(frozenset("deepa lena hana thomas kate ezra dana".split()), frozenset(ENDS[0]), frozenset(ENDS[1]))

CASES = [
    ("Spoke to Deepa Maldanbury about it.", ["NAME"]),
    ("Minutes taken by Prof. Thorvescu.", ["NAME"]),
    ("Reach Branoquist, Thomas by mail", ["NAME"]),
    ("We saw D. Maldanbury and", ["NAME"]),
    ("coffee with HANA P. ELVAKOVA today", ["NAME"]),
    ("Coffee with Lena by the end", []),
    ("Spoke to Hana B. about", []),
    ("Ask Branoquist about the room at Dana River park", []),
    ("write to maldanbury7@novilul.example.org now", ["EMAIL"]),
    ("write to kate dot m (at) novilul dot example dot org now", ["EMAIL"]),
    ("mail kate at novilul dot example", ["EMAIL"]),
    ("meet at the dot", []),
    ("the handle @9205club is free", []),
    ("Call (905) 555 0122 or 604-555-0169, +1 (647) 555-0138", ["PHONE"]),
    ("+49 30 23125 955", ["PHONE"]),
    ("ring 01 99 00 46 97", ["PHONE"]),
    ("17185550137", ["PHONE"]),
    ("call five five five, zero one six nine two two two", ["PHONE"]),
    ("one two, three four five of six", []),
    ("call nine oh five, five five five, oh one two two", ["PHONE"]),
    ("ISBN 000-0-753-1327-0 and Order 555-0722-5052 of 2024-01-02, build 4.83.845", []),
    ("Total was 1252,394.52 after tax", []),
    ("SSN 978-63-6933 on file", ["ID_NUMBER"]),
    ("passport no. Z8038234.", ["ID_NUMBER"]),
    ("national insurance number QQ 16 65 95 D", ["ID_NUMBER"]),
    ("QX7487677 fits the form, ticket #22197495", []),
    ("keys at 575 Foundry Street, Port Kessin", ["ADDRESS"]),
    ("816 fennel blvd alder cross", ["ADDRESS"]),
    ("Heronstraße 604, 72920 Vellbrook", ["ADDRESS"]),
    ("Mill Road 925, Quarry Hill", ["ADDRESS"]),
    ("933 rue Willow, Nordhaven", ["ADDRESS"]),
    ("Ran 425 laps near Fennel Street market, lecture at Quarry Road", []),
    ("mаldаnbury@novilul.example", ["EMAIL"]),  # two Cyrillic letters
    ("tel 604​-555-0169", ["PHONE"]),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_kinds(text, kinds):
    assert [k for k in p.KINDS if k in {s[2] for s in p.spans(text, LEX)}] == kinds


@pytest.mark.parametrize("text,kinds", CASES)
def test_spans_map_back_to_the_source(text, kinds):
    found = p.spans(text, LEX)
    assert all(0 <= s < e <= len(text) for s, e, _ in found)
    new = p.redact(text, found)
    for k in kinds:
        assert f"[{k}]" in new
    assert p.spans(new, LEX) == []
    if not kinds:
        assert new == text


GATED = [
    *("Matrikelnummer: 1234567", "StudentID 1234567", "matriculationno. A12345", "student number 12345", "SSN: 978-63-6933", "social security number 978636933", "sin 123 456 789"),
    *("passport no Z8038234", "pasaporte: 123456", "passeport 123456", "reisepass nr 123456", "insurance no. 12 34 56", "QQ123456A", "978-63-6933"),
    *("anna@acme dot org", "anna@acme [dot] org", "anna@acme (punkt) org", "anna@acme {point} org", "anna@acme <punto> org", "anna@acme punkt org", "anna (at) acme.org", "anna at acme dot org"),
    *("+1 (647) 555-0138", "+1 23 45", "+33 12 34 56", "+905550122", "(905) 555 0122", "604-555-0169", "17185550137", "01 99 00 46 97", "call five five five, zero one six nine two two two"),
    *("12 rue Willow", "5 avenue du Lac", "7 calle Sol", "9 via Roma", "3 boulevard Sud", "flat 2, 575 Foundry Street", "Mill Road 925", "4 Elm lane", "8 Oak ave", "6 fennel blvd"),
    *("Heronstraße 604", "Heronstrasse 604", "Birkenweg 4", "Rathausplatz 1", "Kirchgasse 2", "Lindenallee 7", "paſſport 1234567", "4 vıa Roma"),
]


@pytest.mark.parametrize("text", GATED)
def test_gates_lose_nothing(text):
    found = p.spans(text, LEX, gates=False)
    assert found and p.spans(text, LEX) == found


def test_readable_rest():
    t = "Mail “Dana” — kаte(at)novilul.example — soon…"
    assert p.redact(t, p.spans(t, LEX)) == "Mail “Dana” — [EMAIL] — soon…"


def test_json_capture():
    t = json.dumps({"note": "x", "text": "a\nDeepa Maldanbury\nSSN 978-63-6933"})
    assert p.redact(t, p.spans(t, LEX)) == '{"note": "x", "text": "a\\n[NAME]\\n[ID_NUMBER]"}'


def test_names_stated_once(spark):
    """Whole names of PERSON nodes are found however rare and short they are, among many people as well."""
    often = [f"Deepa {f.title()}" for f in FAMILIES] * 1500
    once = ["Zuzka Oyelaran", "Anna Lee", "Min-Ji Kim", "Kim Lee", "Wu, Xia"]
    nodes = spark.createDataFrame([("PERSON", x, None) for x in often + once], "node_type string, title string, properties string")
    lex = p.name_lexicon(nodes)
    for text, name in [("met Zuzka Oyelaran there", "Zuzka Oyelaran"), ("met Anna Lee there", "Anna Lee"), ("ask Dr. Kim now", "Dr. Kim"), ("met Kim Lee there", "Kim Lee"), ("Xia Wu wrote", "Xia Wu"), ("met Deepa Maldanbury", "Deepa Maldanbury")]:
        assert [text[s:e] for s, e, _ in p.spans(text, lex)] == [name]
    assert p.spans("Lee side of the hill, a kim of tea", lex) == []


def test_bloom_filter(spark):
    words = [f"name{i}" for i in range(3000)]
    b = p.bloom_of(spark.createDataFrame([(w,) for w in words], "word string").repartition(3))
    again = p.Bloom.__new__(p.Bloom)
    again.__setstate__(b.__getstate__())
    assert all(w in b and w in again for w in words) and sum(f"other{i}" in b for i in range(20_000)) < 5
    assert {"name1", "name2"} <= b and "x" not in p.bloom_of(spark.createDataFrame([], "word string"))


def test_tables_and_defined_cases(spark):
    node = "id string, node_type string, title string, content string, properties string, text string"
    people = [(f"p{i}{j}", "PERSON", f"{g} {f.title()}", None, json.dumps({"contact_info": {"phone": "kate@x.example", "note": "see badge"}}), None) for i, g in enumerate(["Deepa", "Hana"]) for j, f in enumerate(FAMILIES)]
    rows = [*people, ("a", "NOTE", None, "by Hana Maldobury", None, None), ("b", None, None, None, None, None), ("c", "NOTE", "t", "", "broken", None)]
    nodes = spark.createDataFrame(rows, node)
    captures = spark.createDataFrame([("1", None), ("2", ""), ("3", "z " * 100_000 + "Deepa Elvakova"), ("3", "z " * 100_000 + "Deepa Elvakova")], "id string, raw_content string").withColumn("pii_types", F.lit(1))
    lex = p.name_lexicon(nodes)
    assert {"deepa", "hana"} <= lex.given and lex.family("maldobury")
    got = p.find_personal(p.private_fields(captures, nodes), lex).select("table_name", "record_id", "field_name", F.explode("pii_types").alias("k")).distinct().collect()
    assert {tuple(r) for r in got} == {("captures", "3", "raw_content", "NAME"), ("nodes", "a", "content", "NAME")} | {("nodes", r[0], "contact_info", "EMAIL") for r in people}
    assert p.find_personal(p.private_fields(captures.where("false"), nodes.where("false")), p.name_lexicon(nodes.where("false"))).count() == 0
