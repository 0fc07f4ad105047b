"""Checks of record search and of the review queue: query and SQL side by side."""

from pyspark.sql import functions as F

from docrecords.operators import queue, records
from docrecords.operators.records import AmountFilter, FieldFilter, RecordFilter

from . import oracle_base as O
from . import views as V

QUERIES = {}
ORACLE = {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


SEL = [O.DOCS, O.FIELDS, O.selected()]
SEL_CUR = [O.DOCS, O.FIELDS, O.selected("current")]
TRUST = "(review_status = 'approved' OR last_approved_extraction_id IS NOT NULL)"


def matches(spark, sf, spec=RecordFilter(), scope="approved"):
    return records.match_records(
        V.docs(spark, sf), V.fields(spark, sf), V.extractions(spark, sf), spec, scope
    )


def text(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


def dec(col, scale=6):
    return F.col(col).cast(f"decimal(38,{scale})").cast("string").alias(col)


def sqldec(col, scale=6):
    return f"CAST(CAST({col} AS DECIMAL(38,{scale})) AS VARCHAR) AS {col}"


@check(
    "q01_selected_extraction",
    O.sql([O.DOCS], """SELECT doc_id, coalesce(last_approved_extraction_id, current_extraction_id) AS approved_scope,
      current_extraction_id AS current_scope FROM v_docs"""),
)
def _(spark, sf):
    return V.docs(spark, sf).select(
        "doc_id",
        records.selected_extraction("approved").alias("approved_scope"),
        records.selected_extraction("current").alias("current_scope"),
    )


@check(
    "q02_selected_values",
    O.sql(SEL, f"SELECT doc_id, vendor_name, invoice_number, invoice_date, due_date, currency, {sqldec('total')} FROM v_sel"),
)
def _(spark, sf):
    return records.select_values(V.docs(spark, sf), V.fields(spark, sf)).select(
        "doc_id", "vendor_name", "invoice_number", "invoice_date", "due_date", "currency", dec("total")
    )


@check("q03_default_trust", O.sql([O.DOCS], f"SELECT doc_id, review_status FROM v_docs WHERE {TRUST}"))
def _(spark, sf):
    spec = RecordFilter()
    return V.docs(spark, sf).filter(records.status_predicate(spec, "approved")).select("doc_id", "review_status")


@check(
    "q04_text_search",
    O.sql(SEL, """SELECT doc_id FROM v_sel d WHERE contains(lower(original_filename), '00077')
      OR contains(lower(vendor_name), '00077')
      OR EXISTS (SELECT 1 FROM v_fields f WHERE f.extraction_id = d.selected_extraction_id AND contains(lower(value_text), '00077'))"""),
)
def _(spark, sf):
    return records.search_filter(V.docs(spark, sf), V.fields(spark, sf), "00077").select("doc_id")


@check(
    "q05_schema_filter",
    O.sql([O.DOCS, O.EXTRACTIONS], """SELECT doc_id FROM v_docs d WHERE EXISTS (SELECT 1 FROM v_extractions e
      WHERE e.extraction_id = coalesce(d.last_approved_extraction_id, d.current_extraction_id) AND e.schema_key = 'purchase')"""),
)
def _(spark, sf):
    return records.schema_filter(V.docs(spark, sf), V.extractions(spark, sf), "purchase").select("doc_id")


@check(
    "q06_vendor_currency",
    O.sql(SEL, f"SELECT doc_id, vendor_name, currency FROM v_sel WHERE {TRUST} AND contains(lower(vendor_name), 'ltd') AND currency = 'EUR'"),
)
def _(spark, sf):
    return matches(spark, sf, RecordFilter(vendor="LTD", currency="EUR")).select("doc_id", "vendor_name", "currency")


@check(
    "q07_amount_filter",
    O.sql(SEL, f"""SELECT comparator, count(*) AS n, {sqldec("sum(total)").replace("AS sum(total)", "AS total")} FROM (
      SELECT 'gt' AS comparator, total FROM v_sel WHERE total > 200000.50 UNION ALL
      SELECT 'gte', total FROM v_sel WHERE total >= 200000.50 UNION ALL SELECT 'lt', total FROM v_sel WHERE total < 1234.51 UNION ALL
      SELECT 'lte', total FROM v_sel WHERE total <= 1234.50 UNION ALL
      SELECT 'between', total FROM v_sel WHERE total BETWEEN 1000 AND 50000) GROUP BY comparator"""),
)
def _(spark, sf):
    rows = records.select_values(V.docs(spark, sf), V.fields(spark, sf))
    specs = [
        AmountFilter("gt", "200000.50"), AmountFilter("gte", "200000.50"), AmountFilter("lt", "1234.51"),
        AmountFilter("lte", "1234.50"), AmountFilter("between", "1000", "50000"),
    ]
    hits = F.array(*[F.when(records.amount_predicate(s, F.col("total")), s.comparator) for s in specs])
    return (
        rows.select("total", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("comparator"))
        .groupBy("comparator")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
        .select("comparator", "n", dec("total"))
    )


@check(
    "q08_date_ranges",
    O.sql(SEL, f"""SELECT doc_id, invoice_date, due_date FROM v_sel WHERE {TRUST} AND invoice_date >= '1996-01-01'
      AND invoice_date <= '1997-06-30' AND due_date <= '1997-03-31'"""),
)
def _(spark, sf):
    spec = RecordFilter(invoice_date=("1996-01-01", "1997-06-30"), due_date=(None, "1997-03-31"))
    return matches(spark, sf, spec).select("doc_id", "invoice_date", "due_date")


@check(
    "q09_status_and_type",
    O.sql([O.DOCS], """SELECT doc_id, review_status, processing_status FROM v_docs WHERE review_status IN ('needs_review','reopened')
      AND processing_status IN ('succeeded','partial') AND document_type = 'invoice'"""),
)
def _(spark, sf):
    spec = RecordFilter(
        review_status=("needs_review", "reopened"), processing_status=("succeeded", "partial"), document_type="invoice"
    )
    return matches(spark, sf, spec).select("doc_id", "review_status", "processing_status")


PREDS = (
    FieldFilter("priority", "eq", "1-urgent"),
    FieldFilter("vendorName", "contains", "00"),
    FieldFilter("tax", "gte", "1000"),
    FieldFilter("subtotal", "lt", "400000.5"),
    FieldFilter("paid", "exists"),
)


def _exists(cond):
    return f"EXISTS (SELECT 1 FROM v_fields f WHERE f.extraction_id = d.selected_extraction_id AND {cond})"


PRED_SQL = " AND ".join(
    _exists(c)
    for c in (
        "schema_field_key = 'priority' AND lower(value_text) = '1-urgent'",
        "schema_field_key = 'vendorName' AND contains(lower(value_text), '00')",
        "schema_field_key = 'tax' AND value_numeric >= 1000",
        "schema_field_key = 'subtotal' AND value_numeric < 400000.5",
        "schema_field_key = 'paid' AND presence_state = 'present'",
    )
)


@check("q10_field_predicates", O.sql(SEL, f"SELECT doc_id FROM v_scoped d WHERE {PRED_SQL}"))
def _(spark, sf):
    return records.field_filter(V.docs(spark, sf), V.fields(spark, sf), list(PREDS)).select("doc_id")


@check(
    "q11_disallowed_paths",
    O.sql([O.FIELDS], """SELECT DISTINCT p.path AS path, p.path || ' is not a queryable schema field.' AS message
      FROM (SELECT path FROM v_fields UNION ALL SELECT upper(event_type) FROM events) p
      WHERE p.path NOT IN (SELECT schema_field_key FROM v_fields)"""),
)
def _(spark, sf):
    asked = V.fields(spark, sf).select("path").union(V.table(spark, sf, "events").select(F.upper("event_type")))
    leaves = V.fields(spark, sf).select(F.col("schema_field_key").alias("leaf_key"))
    return records.disallowed_paths(asked.distinct(), leaves)


@check(
    "q12_sorted_rank",
    O.sql(SEL, f"""SELECT doc_id, {sqldec('total')}, row_number() OVER (ORDER BY total DESC NULLS LAST, doc_id) AS position
      FROM v_sel WHERE {TRUST} ORDER BY position"""),
)
def _(spark, sf):
    rows = records.ranked(matches(spark, sf), records.sort_columns("total", "desc"))
    return rows.select("doc_id", dec("total"), "position")


@check(
    "q13_page",
    O.sql(SEL, f"""SELECT doc_id, original_filename, (SELECT count(*) FROM v_sel WHERE {TRUST}) AS total,
      greatest(1, ceil((SELECT count(*) FROM v_sel WHERE {TRUST}) / 20.0))::BIGINT AS total_pages
      FROM v_sel WHERE {TRUST} ORDER BY vendor_name ASC NULLS LAST, doc_id LIMIT 20 OFFSET 40"""),
)
def _(spark, sf):
    rows = matches(spark, sf)
    shown = records.page(rows, records.sort_columns("vendorName", "asc"), 3, 20)
    counts = records.page_counts(rows, 20)
    return shown.select("doc_id", "original_filename").join(F.broadcast(counts), F.lit(True))


@check(
    "q14_currency_totals",
    O.sql(SEL, f"""SELECT currency, count(*) AS n, CAST(sum(total)::DECIMAL(38,6) AS VARCHAR) AS total FROM v_sel
      WHERE {TRUST} AND total > 1000 AND currency IS NOT NULL GROUP BY currency HAVING sum(total) IS NOT NULL"""),
)
def q14(spark, sf):
    rows = matches(spark, sf, RecordFilter(amount=AmountFilter("gt", "1000")))
    return records.currency_totals(rows).select("currency", "n", dec("total"))


@check(
    "q15_schema_counts",
    O.sql(SEL, f"SELECT document_type, schema_name, count(*) AS n FROM v_sel WHERE {TRUST} GROUP BY ALL"),
)
def _(spark, sf):
    return records.schema_counts(matches(spark, sf)).select("document_type", "schema_name", "n")


@check(
    "q16_first_source",
    O.sql([O.FIELDS, O.SOURCES], """SELECT f.field_id, f.path, s.page, coalesce(s.has_box, false) AS has_box FROM v_fields f LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY coalesce(candidate_rank, 2147483647), ref_id) AS rn FROM v_sources) s
      ON s.field_id = f.field_id AND s.rn = 1"""),
)
def _(spark, sf):
    return records.first_source(V.fields(spark, sf), V.sources(spark, sf)).select("field_id", "path", "page", "has_box")


SUMMARY_SQL = """
sv AS (SELECT d.doc_id, f.schema_field_key AS key, f.label, coalesce(value_text, corrected_value, extracted_value) AS value, f.path,
    f.sort_order, f.field_id
  FROM v_docs d JOIN v_all f ON f.extraction_id = coalesce(d.last_approved_extraction_id, d.current_extraction_id)
  WHERE d.document_type <> 'invoice'),
top4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sort_order, field_id) AS rank FROM sv
  WHERE NOT contains(path, '[') AND value <> '') WHERE rank <= 4),
cells AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sort_order, field_id) AS cell_no FROM sv
  WHERE doc_id NOT IN (SELECT doc_id FROM top4)),
cells2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS cnt, regexp_extract(path, '^([A-Za-z0-9_]+)\\[(\\d+)\\]\\.(.+)\\z', 1) AS ak,
   regexp_extract(path, '^([A-Za-z0-9_]+)\\[(\\d+)\\]\\.(.+)\\z', 2) AS idx FROM cells),
rep AS (SELECT *, first_value(idx) OVER (PARTITION BY doc_id ORDER BY cell_no) AS first_idx,
  first_value(ak) OVER (PARTITION BY doc_id ORDER BY cell_no) AS first_ak FROM cells2 WHERE ak <> '' AND value <> ''),
tab AS (
  SELECT doc_id, 1 AS rank, first_ak || 'Count' AS key, 'Records' AS label,
    count(DISTINCT idx)::VARCHAR AS value FROM rep GROUP BY doc_id, first_ak
  UNION ALL
  SELECT doc_id, rn + 1, key, label, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cell_no) AS rn FROM rep
    WHERE idx = first_idx) WHERE rn <= 2)"""


@check(
    "q17_summary_values",
    O.sql([O.DOCS, O.ALL_FIELDS, SUMMARY_SQL], "SELECT doc_id, rank, key, label, value FROM top4"),
)
def _(spark, sf):
    return records.summary_values(V.docs(spark, sf), V.all_typed(spark, sf))


@check(
    "q18_table_summaries",
    O.sql([O.DOCS, O.ALL_FIELDS, SUMMARY_SQL], "SELECT doc_id, rank, key, label, value FROM tab"),
)
def _(spark, sf):
    return records.table_summaries(V.docs(spark, sf), V.all_typed(spark, sf))


@check(
    "q19_open_issue_counts",
    O.sql([O.DOCS, O.CHECKED], """SELECT d.doc_id, CASE WHEN current_extraction_id IS NOT NULL THEN
      (SELECT count(*) FROM v_checked f WHERE f.extraction_id = d.current_extraction_id AND needs_attention) END AS open_issues FROM v_docs d"""),
)
def _(spark, sf):
    return records.open_issue_counts(V.docs(spark, sf), V.checked_fields(spark, sf)).select("doc_id", "open_issues")


@check(
    "q20_known_vendors",
    O.sql([O.DOCS, O.FIELDS, O.RECORDS], "SELECT DISTINCT vendor_name FROM v_rec WHERE vendor_name <> ''"),
)
def _(spark, sf):
    return records.known_vendors(V.invoice_records(spark, sf))


LIB = """SELECT d.doc_id, r.vendor_name, CAST(r.total AS VARCHAR) AS total FROM v_docs d LEFT JOIN v_rec r ON r.doc_id = d.doc_id
  WHERE (original_filename ILIKE '%inv_0%7%' OR vendor_name ILIKE '%inv_0%7%') AND review_status IN ('reopened','needs_review')"""


@check(
    "q21_library_list",
    O.sql([O.DOCS, O.FIELDS, O.RECORDS], LIB + " ORDER BY r.total DESC NULLS FIRST, d.doc_id LIMIT 50 OFFSET 10"),
)
def _(spark, sf):
    rows = records.library_rows(
        V.docs(spark, sf), V.invoice_records(spark, sf), "inv_0%7", ("reopened", "needs_review")
    )
    ordered = rows.orderBy(*records.library_order("total", "desc")).offset(10).limit(50)
    return ordered.select("doc_id", "vendor_name", *text("total"))


ATTEMPTS = """
v_attempts AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_number,
  event_type AS status, CASE WHEN event_type = 'error' THEN 'PARSE_FAILED' END AS error_code FROM events)"""


def attempts(spark, sf):
    return V.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"),
        F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").alias("attempt_number"),
        F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", "PARSE_FAILED").alias("error_code"),
    )


@check(
    "q22_latest_attempt",
    O.sql([O.DOCS, ATTEMPTS], """SELECT d.doc_id, a.attempt_number, a.status AS attempt_status, a.error_code,
      processing_status = 'failed' AND coalesce(failure_code, '') NOT IN ('UNSUPPORTED_FIXTURE','UNSUPPORTED_FILE','OCR_REQUIRED','EMPTY_DOCUMENT') AS can_retry,
      (SELECT count(*) FROM v_docs WHERE processing_status IN ('queued','processing')) AS active
      FROM v_docs d LEFT JOIN (SELECT * FROM v_attempts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempt_number DESC) = 1) a
      ON a.doc_id = d.doc_id"""),
)
def _(spark, sf):
    d = V.docs(spark, sf)
    active = records.active_count(d)
    return records.latest_attempts(d, attempts(spark, sf)).join(F.broadcast(active), F.lit(True))


FULL = RecordFilter(
    search="customer", schema_key="invoice", amount=AmountFilter("between", "1000", "450000"),
    invoice_date=("1995-01-01", None), fields=(FieldFilter("priority", "contains", "i"),),
)


@check(
    "q23_search_records",
    O.sql([O.DOCS, O.CHECKED, O.SOURCES, O.selected()], f"""
SELECT d.doc_id, d.original_filename, d.document_type,
  coalesce(CASE split_part(original_filename, '.', 2) WHEN 'md' THEN 'markdown' WHEN 'bin' THEN CASE WHEN mime_type LIKE 'text/plain%' THEN 'txt' END
    ELSE split_part(original_filename, '.', 2) END, 'txt') AS document_format,
  d.schema_name, d.vendor_name, d.invoice_number, CASE WHEN regexp_matches(d.invoice_date, '{O.ISO}') THEN d.invoice_date END AS invoice_date,
  d.currency, CAST(d.total AS VARCHAR) AS total, '' AS summary_values, d.review_status, d.updated_at,
  CASE WHEN d.current_extraction_id IS NOT NULL THEN (SELECT count(*) FROM v_checked f WHERE f.extraction_id = d.current_extraction_id AND needs_attention) END AS open_issues,
  s.page AS total_page, coalesce(s.has_box, false) AS total_has_box
FROM v_sel d LEFT JOIN (SELECT f.extraction_id, s.page, s.has_box FROM v_fields f JOIN v_sources s ON s.field_id = f.field_id WHERE f.path = 'total'
   QUALIFY row_number() OVER (PARTITION BY f.field_id ORDER BY coalesce(candidate_rank, 2147483647), ref_id) = 1) s
  ON s.extraction_id = d.selected_extraction_id
WHERE {TRUST} AND d.total BETWEEN 1000 AND 450000 AND d.invoice_date >= '1995-01-01'
  AND EXISTS (SELECT 1 FROM v_extractions e WHERE e.extraction_id = d.selected_extraction_id AND e.schema_key = 'invoice')
  AND {_exists("schema_field_key = 'priority' AND contains(lower(value_text), 'i')")}
  AND (contains(lower(original_filename), 'customer') OR contains(lower(vendor_name), 'customer') OR {_exists("contains(lower(value_text), 'customer')")})"""),
)
def _(spark, sf):
    f = V.checked_fields(spark, sf)
    found = records.match_records(V.docs(spark, sf), f, V.extractions(spark, sf), FULL)
    rows = records.result_rows(found, f, V.sources(spark, sf))
    return rows.withColumn("total", F.col("total").cast("string"))


QUEUE = [O.DOCS, O.CHECKED, O.RECORDS]
SCORE = """(CASE validation_state WHEN 'invalid' THEN 100 WHEN 'warning' THEN 20 ELSE 0 END
  + CASE confidence_state WHEN 'conflicting' THEN 60 WHEN 'missing' THEN 50 WHEN 'low' THEN 25 WHEN 'inferred' THEN 12 WHEN 'medium' THEN 10 ELSE 0 END
  + CASE WHEN required THEN 20 ELSE 0 END + CASE WHEN material THEN 15 ELSE 0 END)"""
ISSUES = f"""
v_issues AS (SELECT f.* EXCLUDE (doc_id), d.doc_id, d.original_filename, d.review_status AS doc_status, r.vendor_name, {SCORE} AS score,
  CASE WHEN validation_state = 'invalid' THEN message
    WHEN confidence_state = 'conflicting' THEN 'Conflicting values found for ' || label || ' — choose the correct one.'
    WHEN confidence_state = 'missing' AND required THEN label || ' is required but was not found.'
    WHEN confidence_state = 'missing' THEN label || ' was not found — add it if it applies.'
    WHEN confidence_state = 'low' THEN 'Low-confidence reading for ' || label || ' — verify against the document.'
    WHEN confidence_state = 'inferred' THEN label || ' was inferred — confirm it matches the document.'
    WHEN confidence_state = 'medium' THEN 'Please verify ' || label || '.'
    ELSE label || ' needs review.' END AS text,
  CASE WHEN required OR validation_state = 'invalid' OR confidence_state = 'missing' THEN 'Blocking approval' ELSE 'Needs verification' END AS severity,
  CASE WHEN validation_state = 'invalid' THEN 'Validation failed' WHEN confidence_state = 'conflicting' THEN 'Conflicting values'
    WHEN confidence_state = 'missing' AND required THEN 'Required value missing' WHEN confidence_state = 'missing' THEN 'Value not found'
    WHEN confidence_state = 'low' THEN 'Low confidence' WHEN confidence_state = 'inferred' THEN 'Inferred value' ELSE 'Review suggested' END AS reason
  FROM v_checked f JOIN v_docs d ON d.current_extraction_id = f.extraction_id LEFT JOIN v_rec r ON r.doc_id = d.doc_id
  WHERE f.needs_attention AND d.review_status <> 'approved')"""


def issues(spark, sf):
    return queue.open_issues(V.checked_fields(spark, sf), V.docs(spark, sf), V.invoice_records(spark, sf))


@check(
    "u1_open_issues",
    O.sql([*QUEUE, ISSUES], "SELECT doc_id, field_id, path, doc_status AS review_status, vendor_name FROM v_issues"),
)
def _(spark, sf):
    return issues(spark, sf).select("doc_id", "field_id", "path", "review_status", "vendor_name")


@check("u2_issue_priority", O.sql([*QUEUE, ISSUES], "SELECT field_id, score::BIGINT AS score FROM v_issues"))
def _(spark, sf):
    return issues(spark, sf).select("field_id", queue.issue_priority().cast("bigint").alias("score"))


@check("u3_issue_labels", O.sql([*QUEUE, ISSUES], "SELECT field_id, text AS message, severity, reason FROM v_issues"))
def _(spark, sf):
    return issues(spark, sf).select(
        "field_id", queue.issue_message().alias("message"), queue.issue_severity().alias("severity"),
        queue.issue_reason().alias("reason"),
    )


@check(
    "u4_top_issue",
    O.sql([*QUEUE, ISSUES], """SELECT doc_id, path, text AS message, score::BIGINT AS score, cnt AS open_issue_count FROM (SELECT *,
      row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sort_order, field_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS cnt FROM v_issues) WHERE rn = 1"""),
)
def _(spark, sf):
    return queue.top_issues(issues(spark, sf)).select(
        "doc_id", "path", "message", F.col("score").cast("bigint").alias("score"), "open_issue_count"
    )


@check(
    "u5_review_queue",
    O.sql([*QUEUE, ISSUES], """SELECT doc_id, vendor_name, path, cnt AS open_issue_count,
      (SELECT count(DISTINCT doc_id) FROM v_issues) AS total_documents, (SELECT count(*) FROM v_issues) AS total_open_issues
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sort_order, field_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS cnt
      FROM v_issues) WHERE rn = 1 ORDER BY score DESC, cnt DESC, doc_id LIMIT 50"""),
)
def _(spark, sf):
    found = issues(spark, sf)
    return queue.review_queue(found, 50).select("doc_id", "vendor_name", "path", "open_issue_count").join(
        F.broadcast(queue.queue_totals(found)), F.lit(True)
    )


@check(
    "q24_workspace_kpis",
    O.sql([*QUEUE, ISSUES], """SELECT (SELECT count(*) FROM v_docs) AS total, (SELECT count(*) FROM v_docs WHERE processing_status IN ('queued','processing')) AS active,
      count(DISTINCT doc_id) AS needs_review, count(*) AS open_issues,
      greatest(0, (SELECT count(*) FROM v_docs) - count(DISTINCT doc_id)) AS clear FROM v_issues"""),
)
def _(spark, sf):
    return records.workspace_kpis(V.docs(spark, sf), issues(spark, sf))
