import json

from loomgraph.plans import compositions


def test_embedding_texts_of_all_live_nodes(spark, tmp_path):
    nodes = [
        ("a", "Title", "Some\ncontent", json.dumps({"role": "lead", "amount": 1.5, "open": True, "none": None, "list": ["x", 2], "contact": {"phone": "+1 23"}}), False),
        ("b", "Bare", None, None, False),
        ("c", "Empty", "", "{}", False),
        ("d", "Broken", "text", "{no json", None),
        ("e", "Gone", "text", '{"k": "v"}', True),
        ("f", "Listed", None, "[1, 2]", False),
        ("g", "Ordered", None, '{"z": "Zoë", "a": 1, "z": "last"}', False),
    ]
    spark.createDataFrame(nodes, "id string, title string, content string, properties string, deleted boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    want = {}
    for i, title, content, raw, deleted in nodes:  # as the reference puts it together
        text = f"{title} {content}" if content else title
        try:
            props = json.loads(raw) if raw else None
        except ValueError:
            props = None
        if isinstance(props, dict) and props:
            text = f"{text} {' '.join(f'{k}: {v}' for k, v in props.items() if v is not None)}"
        if not deleted:
            want[i] = text
    assert {r.id: r.text for r in compositions.embedding_texts(spark, str(tmp_path)).collect()} == want
