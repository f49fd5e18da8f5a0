"""Oracle SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from loomgraph.llm import merkle

_FIELDS = "[" + ", ".join(f"'{f}'" for f in sorted(merkle.FIELD_NAMES)) + "]"


def _norm(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_LEFT_OUT = ", ".join(f"'{k}'" for k in merkle.LEFT_OUT)
FORMS = f"""raw AS (SELECT id, raw_content AS x, trim(raw_content, chr(65279) || chr(8203) || E' \\t\\r\\n' || chr(160)) AS bare FROM captures WHERE raw_content IS NOT NULL),
js AS (SELECT id, x, bare, starts_with(bare, '{{') AND json_valid(bare) AS is_json FROM raw),
doc AS (SELECT id, list_sort(list_transform(list_filter(json_keys(bare), lambda k: {_norm('k')} <> 'text'), lambda k: {_norm('k')} || '=' || {_norm("coalesce(json_extract_string(bare, '$.' || to_json(k)::VARCHAR), '')")})) AS fields, {_norm("coalesce(json_extract_string(bare, '$.text'), '')")} AS body FROM js WHERE is_json),
split AS (SELECT id, string_split(x, chr(10)) AS ls FROM js WHERE NOT is_json),
kind AS (SELECT id, ls, list_transform(ls, lambda l: CASE WHEN contains(l, ':') AND list_contains({_FIELDS}, {_norm("split_part(l, ':', 1)")}) THEN 'f' WHEN {_norm('l')} = '' THEN 'b' ELSE 'x' END) AS ks FROM split),
cut AS (SELECT id, ls, ks, coalesce(list_position(ks, 'x'), len(ls) + 1) AS pos FROM kind),
plain AS (SELECT id, list_sort(list_transform(list_filter(ls[1:pos - 1], lambda l, i: ks[i] = 'f'), lambda l: {_norm("split_part(l, ':', 1)")} || '=' || {_norm("substr(l, strpos(l, ':') + 1)")})) AS fields, {_norm("array_to_string(ls[pos:], chr(10))")} AS body FROM cut),
form AS (SELECT 'captures' AS table_name, id, to_json(fields)::VARCHAR || '|' || body AS form FROM doc UNION ALL SELECT 'captures', id, to_json(fields)::VARCHAR || '|' || body FROM plain
  UNION ALL SELECT 'nodes', id, coalesce(node_type, '') || '|' || {_norm('title')} FROM nodes WHERE title IS NOT NULL AND coalesce(node_type, '') NOT IN ({_LEFT_OUT})),
grp AS (SELECT table_name, id, min(id) OVER w AS keep_id, count(*) OVER w AS n, form FROM form WINDOW w AS (PARTITION BY table_name, form))"""

_WORDS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"

SQL = {
    "p2_found": f"WITH {FORMS} SELECT table_name, keep_id, id AS copy_id FROM grp WHERE id <> keep_id",
    "p2_counts": f"WITH {FORMS} SELECT table_name, keep_id, n AS n_rows FROM grp WHERE id = keep_id AND n > 1",
    "p6_found": f"""WITH {FORMS}, w AS MATERIALIZED (SELECT 'captures' AS t, id, {_WORDS.format('raw_content')} AS ws FROM captures UNION ALL SELECT 'nodes', id, {_WORDS.format('content')} FROM nodes),
s AS MATERIALIZED (SELECT t, id, array_to_string(ws, '') AS letters, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS sh FROM w WHERE len(ws) >= 30),
u AS MATERIALIZED (SELECT t, id, unnest(sh) AS g FROM s), c AS (SELECT a.t, a.id AS id_a, b.id AS id_b, count(*) AS n FROM u a JOIN u b ON a.t = b.t AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT c.t AS table_name, id_a, id_b FROM c JOIN s a ON a.t = c.t AND a.id = id_a JOIN s b ON b.t = c.t AND b.id = id_b LEFT JOIN form x ON c.t = 'captures' AND x.table_name = c.t AND x.id = id_a LEFT JOIN form y ON c.t = 'captures' AND y.table_name = c.t AND y.id = id_b
WHERE 10 * n >= 7 * (len(a.sh) + len(b.sh) - n) AND a.letters <> b.letters AND NOT coalesce(x.form = y.form, false)""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark),
dr AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM d WHERE len(ws) >= 12), br AS MATERIALIZED (SELECT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM b WHERE len(ws) >= 12)
SELECT DISTINCT doc_id, item_id FROM dr JOIN br USING (g)""",
}
