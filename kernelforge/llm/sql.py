"""SQL forms (DuckDB) of this subpackage's queries, where SQL can state them.

They state the results plainly, over whole tables: op3 sums Poisson terms per source, op4 counts the
shingles that documents share and closes links recursively, op6 joins windows by their words,
op9 follows each message's one dependency, and op10 names equal substrings by doubling their length.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

_MIX = r"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w * sum(n) OVER () / sum(w) OVER () / n AS rate FROM counts),
cdf AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM rates, range(0, 2000) r(k)),
drawn AS (SELECT doc_id, source, length(text)::INT AS n_text, coalesce(doc_id::VARCHAR, '') AS ident,
    ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT / 281474976710656.0 AS u, row_number() OVER () AS row_id FROM documents),
many AS (SELECT row_id, count(*) AS n FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.p <= d.u AND c.p < 1 - 1e-13 GROUP BY row_id),
copies AS (SELECT row_id, unnest(range(0, n)) AS copy FROM many)
SELECT doc_id, source, copy::INT AS copy, md5(concat_ws('|', 'mix-1', 'order', ident, copy::VARCHAR)) AS shuffle_key, n_text FROM drawn JOIN copies USING (row_id)
"""

_NEAR = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_CLEAN = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_TEXT}, {_WORDS}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_TEXT}, {_WORDS}) AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, gram FROM (SELECT item_id, least(len(w), 13) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram FROM items WHERE len(w) > 0)),
placed AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
    FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
met AS MATERIALIZED (SELECT doc_id, pos, n, item_id FROM placed JOIN windows USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS word FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _doubled(names: list[tuple[str, str, int]]) -> str:
    """Tables in which equal strings share a number: each pairs the former's numbers at p and p + shift."""
    return "".join(f", {new} AS MATERIALIZED (SELECT doc_id, p, dense_rank() OVER (ORDER BY v, u) AS v FROM (SELECT doc_id, p, v, lead(v, {shift}) OVER (PARTITION BY doc_id ORDER BY p) AS u FROM {old}) WHERE u IS NOT NULL)" for new, old, shift in names)


_PACKED = " + ".join(f"{256**k} * lead(b, {k}) OVER o" if k else "b" for k in range(7))
_REPEATS = rf"""
WITH bytes AS MATERIALIZED (SELECT doc_id, generate_subscripts(h, 1) - 1 AS p, unnest(h) AS h FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents)),
s7 AS MATERIALIZED (SELECT doc_id, p, {_PACKED} AS v FROM (SELECT doc_id, p, ('0x' || h)::BIGINT AS b FROM bytes) WINDOW o AS (PARTITION BY doc_id ORDER BY p) QUALIFY v IS NOT NULL)
{_doubled([("s14", "s7", 7), ("s28", "s14", 14), ("s56", "s28", 28), ("s100", "s56", 44)])},
later AS (SELECT doc_id, p FROM s100 QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, p) > 1),
covered AS (SELECT doc_id, p, h, count(start) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM (SELECT b.doc_id, b.p, b.h, l.p AS start FROM bytes b LEFT JOIN later l ON b.doc_id = l.doc_id AND b.p = l.p)),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM covered),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(h, '' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM documents LEFT JOIN sums USING (doc_id)
"""

_CHAT = r"""
WITH RECURSIVE d AS (SELECT c.*, c.conv_id || '-' || c.turn AS ident, c.role = 'user' AS call, coalesce(b.role = 'user' AND c.role = 'assistant', false) AS linked, coalesce(n.role = 'assistant', false) AS answered,
    CASE WHEN c.role = 'assistant' AND b.role = 'user' THEN b.turn WHEN c.role = 'user' AND a.role = 'user' THEN CASE WHEN b.role = 'assistant' THEN b.turn ELSE a.turn END END AS dep
    FROM conversations c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 2 LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
lv AS (SELECT conv_id, turn, 0 AS level FROM d WHERE dep IS NULL UNION ALL SELECT d.conv_id, d.turn, lv.level + 1 FROM d JOIN lv ON d.conv_id = lv.conv_id AND d.dep = lv.turn)
SELECT d.conv_id, d.turn, role, level::INT AS level, CASE WHEN call THEN 1 ELSE 0 END::INT AS n_calls, linked,
    concat_ws(' | ', CASE WHEN call AND text IS NULL THEN ident || ': missing text' END, CASE WHEN call AND length(text) NOT BETWEEN 1 AND 400 THEN ident || ': text has a wrong length' END, CASE WHEN call AND d.turn NOT BETWEEN 0 AND 5 THEN ident || ': turn is out of range' END,
        CASE WHEN role = 'assistant' AND d.turn > 0 AND NOT linked THEN 'result without call' END, CASE WHEN call AND NOT answered THEN '1 calls without result' END) AS problems,
    '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role)::VARCHAR
    || CASE WHEN role = 'assistant' AND d.turn > 0 THEN ',"tool_call_id":"' || d.conv_id || '-' || (d.turn - 1) || '"' ELSE '' END
    || CASE WHEN call THEN ',"tool_calls":[{"arguments":{' || coalesce('"text":' || to_json(text)::VARCHAR || ',', '') || '"turn":' || d.turn || '}' || CASE WHEN d.turn >= 2 THEN ',"depends_on":["' || d.conv_id || '-' || (d.turn - 2) || '"]' ELSE '' END || ',"id":"' || ident || '","name":"reply"}]' ELSE '' END || '}' AS json
FROM d LEFT JOIN lv ON lv.conv_id = d.conv_id AND lv.turn = d.turn
"""

ORACLE_SQL: dict[str, str] = {"op3_mix_sources": _MIX, "op4_minhash_neardup": _NEAR, "op6_decontamination": _CLEAN, "op9_chat_format": _CHAT, "op10_suffix_dedup": _REPEATS}
