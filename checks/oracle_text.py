"""SQL of the text structure: lines, kinds, key/values, tables, sections (DuckDB dialect)."""

from . import oracle_base as O

WS, C = O.WS, O.WS_CLASS
_PRICE = O.cents_text(O.cents("l_extendedprice"))
_TOTAL = O.cents_text(O.cents("o_totalprice"))
_K = "o_orderkey"


def _when(cond, text):
    return f"CASE WHEN {cond} THEN {text} END"


_PARTS = [
    _when(f"{_K} % 11 <> 0", f"'# Invoice AC-' || {_K}"),
    _when(f"{_K} % 11 <> 0", "'Customer Name: Customer#' || o_custkey"),
    _when(f"{_K} % 11 <> 0", f"'Invoice No: FLP/BLR/' || {_K} || ' Invoice Date: ' || {O.iso('o_orderdate')}"),
    _when(f"{_K} % 11 <> 0", "'Order Priority:  ' || o_orderpriority || ' '"),
    _when(f"{_K} % 11 <> 0", f"'Total: $' || {_TOTAL}"),
    _when(f"{_K} % 5 = 0", f"'  Total: ' || {_TOTAL} || ' Currency: USD'"),
    _when(f"{_K} % 5 = 1", "'Reference 12: none'"),
    "''",
    _when(f"{_K} % 2 = 0", "'Line Items'"),
    _when("item_rows IS NOT NULL", "'Item  Qty  Amount  Amount'"),
    "item_rows",
    "''",
    _when(f"{_K} % 3 = 0", "'| Code | Name |  |' || chr(10) || '|---|---|' || chr(10) || '| A1 | über |  |' || chr(10) || '|  | Beta | 3 |'"),
    "'single  row'",
    _when(f"{_K} % 11 <> 0", "'NOTES AND TERMS'"),
    f"'Deliver order ' || {_K} || ' before noon; contact billing' || {_K} || '@example.com or +49 170 12' || CASE WHEN length({_K}::VARCHAR) > 5 THEN left({_K}::VARCHAR, 5) ELSE lpad({_K}::VARCHAR, 5, '0') END || ', please.'",
    _when(f"{_K} % 7 = 0", "'Second paragraph, see linkedin.com/in/ab-c for more details.'"),
    _when(f"{_K} % 4 <> 1", f"'- first bullet ' || {_K}"),
    _when(f"{_K} % 4 = 2", "'2) another   bullet'"),
    _when(f"{_K} % 7 = 0", "'## Notes' || chr(10) || 'plain words here.' || chr(10) || '## Notes' || chr(10) || 'more plain words.' || chr(10) || '## Notes 2' || chr(10) || 'the last words.'"),
]
TEXTS = f"""
v_items AS (SELECT l_orderkey, string_agg(p_name || '  ' || l_quantity::INT || '  ' || {_PRICE} ||
    CASE WHEN l_linenumber % 4 <> 0 THEN '  ' || l_returnflag ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
v_docs_text AS (SELECT o_orderkey AS doc_id, concat_ws(chr(10), {", ".join(_PARTS)}) AS text FROM orders LEFT JOIN v_items ON l_orderkey = o_orderkey
  UNION ALL SELECT -1 - doc_id, text FROM documents)"""

TRIM = O.trim("text")
INNER = f"regexp_replace(regexp_replace(text, '^{WS}*\\|', ''), '\\|{WS}*\\z', '')"


def cells(x):
    inner = f"regexp_replace(regexp_replace({x}, '^{WS}*\\|', ''), '\\|{WS}*\\z', '')"
    t = O.trim("c")
    return f"""CASE WHEN contains({x}, '|') THEN list_transform(string_split({inner}, '|'), lambda c: {t})
      ELSE list_filter(list_transform(string_split_regex({x}, '{WS}{{2,}}|\\t+'), lambda c: {t}), lambda c: c <> '') END"""


_W = "(?:[A-Za-z][A-Za-z.&()-]{2,}|(?i:no|id|po))"
LABEL = f"(^| )({_W}(?: +{_W})*){WS}*[:：]{WS}+"
_LT = f"regexp_replace(text, '^{WS}+', '')"
LIST_ITEM = f"^{WS}*(?:[-*•]|[0-9]+[.)]){WS}+(.+[^{C}]){WS}*\\z"
HEADING = f"^(#{{1,6}}){WS}+(.*[^{C}]){WS}*\\z"
WORDS = f"string_split_regex({TRIM}, '{WS}+')"
HEADING_LIKE = f"""(length({TRIM}) BETWEEN 1 AND 64 AND NOT regexp_matches({TRIM}, '[.!?,;:]\\z')
  AND length(regexp_replace({TRIM}, '[^A-Za-z]', '', 'g')) >= 2
  AND (({TRIM} = upper({TRIM}) AND regexp_matches({TRIM}, '[A-Z]'))
    OR (len({WORDS}) <= 8 AND len(list_filter({WORDS}, lambda w: NOT (regexp_matches(w, '^[^a-z]*[A-Z0-9]') OR length(w) <= 3))) = 0)))"""

LINES = f"""
v_l0 AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM v_docs_text)),
v_l1 AS (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(text) - 1)::INT AS start FROM v_l0),
v_l2 AS (SELECT *, start + length(text) AS "end", string_split_regex({_LT}, '{LABEL}') AS vals, regexp_extract_all({_LT}, '{LABEL}', 2) AS keys,
   regexp_extract_all({_LT}, '{LABEL}', 0) AS labels, length(text) - length({_LT}) AS lead FROM v_l1),
v_l3 AS (SELECT *, CASE
  WHEN NOT regexp_matches(text, '[^{C}]') THEN 'blank'
  WHEN (contains(text, '|') OR regexp_matches(text, '[^{C}] {{2,}}[^{C}]|\\t')) AND NOT regexp_matches(text, '^[-=|+{C}]+\\z') AND len({cells("text")}) >= 2 THEN 'tabular'
  WHEN regexp_matches(text, '{HEADING}') THEN 'md'
  WHEN len(vals) > 1 AND vals[1] = '' AND len(list_filter(vals[2:], lambda v: regexp_matches(v, '[^{C}]'))) > 0 THEN 'kv'
  WHEN regexp_matches(text, '{LIST_ITEM}') THEN 'list-item' WHEN {HEADING_LIKE} THEN 'like' ELSE 'paragraph' END AS k FROM v_l2),
v_l4 AS (SELECT *, k = 'tabular' AND (coalesce(lag(k) OVER w, '') = 'tabular' OR coalesce(lead(k) OVER w, '') = 'tabular') AS in_table,
  coalesce(lag(k) OVER w, '') AS prev_k FROM v_l3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
v_l5 AS (SELECT *, CASE WHEN k IN ('md','like') THEN 'heading' WHEN in_table THEN 'table-row' WHEN k = 'tabular' THEN 'line' ELSE k END AS kind,
  CASE WHEN k = 'md' THEN regexp_extract(text, '{HEADING}', 2) WHEN k = 'like' THEN {TRIM} END AS head,
  sum(CASE WHEN in_table AND prev_k <> 'tabular' THEN 1 ELSE 0 END) OVER w - 1 AS tno FROM v_l4 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
v_l AS MATERIALIZED (SELECT doc_id, line_no, text, start, "end", kind, k, vals, keys, labels, lead, CASE WHEN in_table THEN tno::INT END AS table_no,
  CASE WHEN in_table THEN row_number() OVER (PARTITION BY doc_id, in_table, tno ORDER BY line_no) - 1 END AS table_row,
  last_value(head IGNORE NULLS) OVER w AS heading, (count(head) OVER w)::INT AS section_no FROM v_l5 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""

KV = f"""
v_kv AS MATERIALIZED (SELECT * EXCLUDE (p), start_at AS start, start_at + length(value) AS "end" FROM (
  SELECT doc_id, line_no, (p - 1)::INT AS pair_no, p, {O.trim("keys[p]")} AS key, {O.trim("vals[p + 1]")} AS value,
    (line_start + lead + list_sum(list_transform(labels[1:p], lambda x: length(x))) + coalesce(list_sum(list_transform(vals[2:p], lambda x: length(x))), 0)
      + length(vals[p + 1]) - length(regexp_replace(vals[p + 1], '^{WS}+', '')))::INT AS start_at, heading
  FROM (SELECT doc_id, line_no, start AS line_start, lead, vals, keys, labels, heading, unnest(range(1, len(keys) + 1)) AS p FROM v_l WHERE kind = 'kv')) WHERE value <> '')"""

BLOCKS = f"""
v_b AS (SELECT *, start_at + length(inner_text) AS end_at FROM (SELECT *, start + strpos(text, inner_text) - 1 AS start_at FROM (
  SELECT *, CASE WHEN k = 'md' THEN regexp_extract(text, '{HEADING}', 2) ELSE {TRIM} END AS inner_text FROM v_l WHERE kind <> 'blank'))),
v_blocks AS (SELECT doc_id, line_no AS block_no, kind, CASE WHEN kind = 'kv' THEN (SELECT string_agg(key || ': ' || value, '  ' ORDER BY pair_no) FROM v_kv q WHERE q.doc_id = v_b.doc_id AND q.line_no = v_b.line_no)
    WHEN kind = 'list-item' THEN regexp_extract(text, '{LIST_ITEM}', 1) ELSE inner_text END AS text,
  CASE WHEN kind IN ('heading','paragraph') THEN start_at ELSE start END::INT AS start,
  CASE WHEN kind IN ('heading','paragraph') THEN end_at ELSE "end" END::INT AS "end",
  CASE WHEN k = 'md' THEN length(regexp_extract(text, '{HEADING}', 1)) WHEN kind = 'heading' THEN 2 END AS level, heading, section_no FROM v_b)"""

_HEADS = "first_value(text) OVER (PARTITION BY doc_id, table_no ORDER BY table_row)"
TABLES = f"""
v_rows AS (SELECT *, {cells("text")} AS c, {cells("head_line")} AS h, first_value(start) OVER (PARTITION BY doc_id, table_no ORDER BY table_row) AS table_start
  FROM (SELECT *, {_HEADS} AS head_line FROM v_l WHERE kind = 'table-row')),
v_tables AS (SELECT doc_id, table_no, count(*) - 1 AS row_count, max(len(c)) AS width, any_value(h) AS h, min(start) AS start, max("end") AS "end", any_value(heading) AS heading
  FROM v_rows GROUP BY doc_id, table_no),
v_cells0 AS (SELECT doc_id, table_no, table_row - 1 AS row_no, i - 1 AS column_no, coalesce(h[i], '') AS header, coalesce(c[i], '') AS value, c, text, start AS line_start, table_start, heading, i
  FROM (SELECT *, unnest(range(1, greatest(len(c), len(h)) + 1)) AS i FROM v_rows WHERE table_row > 0)),
v_cells AS MATERIALIZED (SELECT doc_id, table_no, row_no::INT AS row_no, column_no::INT AS column_no, header, value,
  CASE WHEN value <> '' THEN (line_start + pos)::INT END AS start, CASE WHEN value <> '' THEN (line_start + pos + length(value))::INT END AS "end", table_start, heading
  FROM (SELECT *, list_reduce(list_transform(c[1:i], lambda x: {{'v': x, 'at': 0::BIGINT, 'cur': 0::BIGINT}}), lambda a, x:
      CASE WHEN x.v = '' THEN {{'v': x.v, 'at': a.at, 'cur': a.cur}} ELSE {{'v': x.v, 'at': a.cur + strpos(substr(text, a.cur + 1), x.v) - 1, 'cur': a.cur + strpos(substr(text, a.cur + 1), x.v) - 1 + length(x.v)}} END,
      {{'v': '', 'at': 0::BIGINT, 'cur': 0::BIGINT}}).at AS pos FROM v_cells0))"""

PARSE = [TEXTS, LINES]
