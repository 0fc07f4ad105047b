"""SQL definitions of the derived inputs in `checks.views` (DuckDB dialect)."""

WS_CLASS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CLASS}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def cents_text(c: str) -> str:
    return f"(({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


def cents(x: str) -> str:
    return f"round({x} * 100)::BIGINT"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


DEC = "^-?[0-9]+([.][0-9]+)?\\z"
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"

DOCS = f"""
v_docs AS (
  SELECT o_orderkey AS doc_id,
    'INV_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.' ||
      (['pdf','txt','md','csv','html','bin'])[o_orderkey % 6 + 1] AS original_filename,
    CASE WHEN o_orderkey % 12 = 5 THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS mime_type,
    CASE WHEN o_orderkey % 4 = 0 THEN 'document' ELSE 'invoice' END AS document_type,
    CASE WHEN o_orderkey % 8 = 0 THEN 'Purchase' WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Invoice' END AS schema_name,
    CASE o_orderkey % 20 WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed'
      WHEN 4 THEN 'partial' ELSE 'succeeded' END AS processing_status,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'reopened' ELSE 'needs_review' END AS review_status,
    CASE o_orderkey % 40 WHEN 3 THEN 'PARSE_FAILED' WHEN 23 THEN 'EMPTY_DOCUMENT' END AS failure_code,
    CASE WHEN o_orderkey % 20 <> 1 THEN o_orderkey * 2 END AS current_extraction_id,
    CASE o_orderstatus WHEN 'F' THEN o_orderkey * 2 WHEN 'P' THEN o_orderkey * 2 + 1 END AS last_approved_extraction_id,
    CASE o_orderstatus WHEN 'F' THEN {iso("o_orderdate + INTERVAL 9 DAY")} END AS approved_at,
    {iso("o_orderdate")} AS created_at,
    {iso("o_orderdate + to_days((o_orderkey % 50)::INT)")} AS updated_at
  FROM orders)"""

EXTRACTIONS = """
v_extractions AS (
  SELECT o_orderkey * 2 + snap AS extraction_id, o_orderkey AS doc_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'purchase' ELSE 'invoice' END AS schema_key,
    'sv' || (o_orderkey % 7)::VARCHAR AS schema_version_id,
    1 + o_orderkey % 3 AS version, snap, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority
  FROM orders, (SELECT unnest([0, 1])::BIGINT AS snap)
  WHERE snap = 0 OR o_orderstatus = 'P')"""

_SNAP_CENTS = f"({cents('o_totalprice')} - snap * 10000)"
_TAX = f"({_SNAP_CENTS} // 10)"
_VALUES = [
    ("vendorName", "Vendor", "identity", "string", True, False, "c_name"),
    ("invoiceNumber", "Invoice number", "identity", "string", True, False,
     "'AC-' || lpad(doc_id::VARCHAR, 7, '0')"),
    ("currency", "Currency", "identity", "currency", True, False,
     "CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'AFRICA' THEN 'GBP' WHEN 'ASIA' THEN 'JPY' END"),
    ("invoiceDate", "Invoice start date", "dates", "date", True, False,
     f"CASE WHEN extraction_id % 29 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE {iso('o_orderdate')} END"),
    ("dueDate", "Due date", "dates", "date", False, False,
     iso("o_orderdate + to_days(CASE WHEN doc_id % 17 = 0 THEN -5 ELSE 30 END)")),
    ("subtotal", "Subtotal", "amounts", "decimal", False, True, cents_text(f"{_SNAP_CENTS} - {_TAX}")),
    ("tax", "Tax", "amounts", "decimal", False, True,
     cents_text(f"{_TAX} + CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 0 END")),
    ("total", "Total", "amounts", "decimal", True, True,
     f"CASE WHEN extraction_id % 23 = 0 THEN 'n/a' ELSE {cents_text(_SNAP_CENTS)} END"),
    ("paid", "Paid", "metadata", "boolean", False, False,
     "CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE 'maybe' END"),
    ("priority", "Priority", "metadata", "string", False, False, "o_orderpriority"),
]


def _field_rows() -> str:
    parts = [
        f"""SELECT extraction_id, doc_id, schema_key, {i} AS sort_order, '{p}' AS path, '{l}' AS label,
        '{g}' AS field_group, '{t}' AS type, {r} AS required, {m} AS material, {v} AS sample FROM base"""
        for i, (p, l, g, t, r, m, v) in enumerate(_VALUES)
    ]
    return "\n UNION ALL ".join(parts)


RAW_FIELDS = f"""
base AS (
  SELECT e.*, c_name, r_name FROM v_extractions e JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE doc_id % 16 <> 0),
flat AS ({_field_rows()}),
flat2 AS (
  SELECT *, extraction_id * 16 + sort_order AS field_id,
    CASE (extraction_id * 16 + sort_order) % 12 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'missing'
      WHEN 3 THEN 'inferred' WHEN 4 THEN 'conflicting' ELSE 'high' END AS confidence_state FROM flat),
flat3 AS (
  SELECT *, CASE WHEN confidence_state <> 'missing' THEN sample END AS extracted_value,
    CASE WHEN extraction_id % 7 = 0 AND path = 'total' THEN '1234.50'
      WHEN extraction_id % 7 = 0 AND path = 'vendorName' THEN sample || ' Ltd' END AS corrected_value FROM flat2),
v_raw AS (
  SELECT field_id, extraction_id, doc_id, schema_key, path, path AS schema_field_key, label, field_group, type,
    'scalar' AS node_kind, required, material,
    CASE WHEN extracted_value IS NULL THEN 'not_found' ELSE 'present' END AS presence_state,
    extracted_value, corrected_value, confidence_state,
    CASE confidence_state WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.4 END AS confidence_score,
    CASE WHEN corrected_value IS NOT NULL THEN 'corrected' WHEN field_id % 9 = 0 THEN 'confirmed'
      WHEN field_id % 31 = 0 AND NOT required THEN 'not_applicable'
      WHEN confidence_state = 'high' THEN 'auto_accepted' ELSE 'needs_review' END AS review_state,
    sample, sort_order FROM flat3)"""

LINE_FIELDS = f"""
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
  FROM lineitem),
li3 AS (
  SELECT l_orderkey, idx, 0 AS c, 'quantity' AS column_key, 'Quantity' AS label, l_quantity::BIGINT::VARCHAR || '.00' AS sample, false AS material FROM li
  UNION ALL SELECT l_orderkey, idx, 1, 'unitPrice', 'Unit price', {cents_text(cents("l_extendedprice") + " // l_quantity::BIGINT")}, false FROM li
  UNION ALL SELECT l_orderkey, idx, 2, 'lineTotal', 'Line total',
    CASE WHEN l_linenumber % 5 <> 0 THEN {cents_text(cents("l_extendedprice"))} END, true FROM li),
v_line AS (
  SELECT 1000000000000 + (l_orderkey * 2 * 1000 + idx) * 4 + c AS field_id, l_orderkey * 2 AS extraction_id, l_orderkey AS doc_id,
    CASE WHEN l_orderkey % 4 = 0 THEN 'purchase' ELSE 'invoice' END AS schema_key,
    'lineItems[' || idx::VARCHAR || '].' || column_key AS path, 'lineItems[].' || column_key AS schema_field_key,
    label, 'lineItems' AS field_group, 'decimal' AS type, 'scalar' AS node_kind, false AS required, material,
    CASE WHEN sample IS NULL THEN 'empty' ELSE 'present' END AS presence_state,
    sample AS extracted_value, NULL::VARCHAR AS corrected_value, 'high' AS confidence_state, 0.85 AS confidence_score,
    'auto_accepted' AS review_state, sample, (100 + idx * 3 + c)::INT AS sort_order FROM li3)"""


def typed(source: str, name: str) -> str:
    """Effective value and typed index columns of a field relation."""
    eff = "CASE WHEN review_state <> 'not_applicable' THEN coalesce(corrected_value, extracted_value) END"
    return f"""
{name} AS (
  SELECT *,
    CASE WHEN eff <> '' AND type NOT IN ('object','array') THEN eff END AS value_text,
    CASE WHEN type IN ('decimal','integer') AND regexp_matches(eff, '{DEC}') THEN eff::DECIMAL(38,6) END AS value_numeric,
    CASE WHEN type IN ('date','datetime') AND regexp_matches(eff, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left(eff, 10) END AS value_date,
    CASE WHEN type = 'boolean' AND eff <> '' THEN lower(eff) IN ('true','yes') END AS value_boolean
  FROM (SELECT *, {eff} AS eff FROM {source}))"""


def single(source: str, name: str) -> str:
    """Single-field validation state, first message and attention flag."""
    return f"""
{name}_e AS (
  SELECT *, CASE
    WHEN coalesce(eff, '') = '' THEN CASE WHEN review_state <> 'not_applicable' AND required THEN label || ' is required.' END
    WHEN type = 'date' AND NOT regexp_matches(eff, '{ISO}') THEN 'Enter a valid date (YYYY-MM-DD).'
    WHEN type = 'currency' AND NOT regexp_matches(eff, '^[A-Z]{{3}}\\z') THEN 'Enter a 3-letter currency code (e.g. USD).'
    WHEN type = 'decimal' AND NOT regexp_matches(eff, '{DEC}') THEN 'Enter a valid number.'
    WHEN type = 'boolean' AND lower(eff) NOT IN ('true','false','yes','no') THEN 'Enter true or false.' END AS error
  FROM {source}),
{name} AS (
  SELECT *, CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS validation_state, error AS message,
    {attention("CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END")} AS needs_attention FROM {name}_e)"""


def attention(state: str) -> str:
    return f"""CASE WHEN review_state IN ('confirmed','not_applicable') THEN {state} = 'invalid'
      WHEN review_state = 'corrected' THEN {state} IN ('invalid','warning')
      ELSE confidence_state <> 'high' OR {state} IN ('invalid','warning') END"""


FIELDS = ",".join([EXTRACTIONS, RAW_FIELDS, typed("v_raw", "v_fields")])
CHECKED = ",".join([FIELDS, single("v_fields", "v_checked")])
ALL_FIELDS = ",".join(
    [EXTRACTIONS, RAW_FIELDS, LINE_FIELDS,
     "v_both AS (SELECT * FROM v_raw UNION ALL BY NAME SELECT * FROM v_line)", typed("v_both", "v_all")]
)
SOURCES = """
v_sources AS (
  SELECT field_id::VARCHAR || ':src' || r::VARCHAR AS ref_id, field_id, ((field_id + r) % 9 + 1)::INT AS page,
    (field_id + r) % 2 = 0 AS has_box, CASE WHEN field_id % 5 = 0 THEN 1 - r END AS candidate_rank
  FROM v_raw, (SELECT unnest([0, 1]) AS r) WHERE field_id % 3 <> 0)"""


def selected(scope: str = "approved", source: str = "v_fields") -> str:
    """Documents with the selected extraction and its record values (CTE v_sel)."""
    pick = "current_extraction_id" if scope == "current" else "coalesce(last_approved_extraction_id, current_extraction_id)"
    raw = "coalesce(corrected_value, extracted_value)"
    text = f"coalesce(value_text, {raw})"
    num = f"coalesce(value_numeric, CASE WHEN regexp_matches({raw}, '{DEC}') THEN {raw}::DECIMAL(38,6) END)"
    date = f"coalesce(value_date, CASE WHEN regexp_matches({raw}, '{ISO}') THEN {raw} END)"

    def sub(expr: str, path: str) -> str:
        return f"(SELECT {expr} FROM {source} f WHERE f.extraction_id = d.selected_extraction_id AND f.path = '{path}')"

    return f"""
v_scoped AS (SELECT *, {pick} AS selected_extraction_id FROM v_docs),
v_sel AS (
  SELECT d.*, {sub(text, 'vendorName')} AS vendor_name, {sub(text, 'invoiceNumber')} AS invoice_number,
    {sub(date, 'invoiceDate')} AS invoice_date, {sub(date, 'dueDate')} AS due_date,
    {sub(text, 'currency')} AS currency, {sub(num, 'total')} AS total FROM v_scoped d)"""


RECORDS = """
v_rec AS (
  SELECT d.doc_id, d.current_extraction_id AS extraction_id, v.* EXCLUDE (extraction_id)
  FROM v_docs d JOIN (
    SELECT extraction_id,
      max(CASE WHEN path = 'vendorName' THEN coalesce(value_text, corrected_value, extracted_value) END) AS vendor_name,
      max(CASE WHEN path = 'invoiceNumber' THEN coalesce(value_text, corrected_value, extracted_value) END) AS invoice_number,
      max(CASE WHEN path = 'currency' THEN coalesce(value_text, corrected_value, extracted_value) END) AS currency,
      max(CASE WHEN path = 'total' THEN value_numeric END) AS total
    FROM v_fields WHERE path IN ('vendorName','invoiceNumber','invoiceDate','dueDate','currency','total') GROUP BY extraction_id) v
  ON d.current_extraction_id = v.extraction_id)"""


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body
