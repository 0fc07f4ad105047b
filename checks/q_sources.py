"""Checks of sources, sinks, request tagging and streams."""

import os
import tempfile

from pyspark.sql import functions as F

from docrecords.operators import records, tagging
from docrecords.plans import processing
from docrecords.plans.stages import stage_root
from docrecords.sources import export, files, store
from docrecords.streaming import events, ingest

from . import oracle_base as O
from . import oracle_text as X
from . import q_canonical, q_records, q_rules, q_structure
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


def folder(spark, name):
    """New folder for the files of one check, below the shared folder."""
    root = stage_root(spark)
    os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=root)


@V.view
def page_files(spark, sf):
    """The pages written as one text file each; returns the folder as a one-row plan."""
    path = folder(spark, "pages")
    pages = V.table(spark, sf, "pages").select("html", F.col("page_id").alias("id"))
    pages.withColumn("page", F.col("id")).select("html", "page").repartition("page").write.mode("append").partitionBy("page").option("lineSep", "\n\n").text(f"{path}/files")
    return spark.createDataFrame([(f"{path}/files",)], "path string")


@check("s01_load_documents", "SELECT page_id, sha256(html || chr(10) || chr(10)) AS sha256, octet_length(encode(html)) + 2 AS size_bytes FROM pages")
def _(spark, sf):
    root = page_files(spark, sf).first()["path"]
    docs = files.load_documents(spark, root).filter(F.col("original_filename").startswith("part-"))
    return docs.select(F.regexp_extract("path", "page=(\\d+)", 1).cast("bigint").alias("page_id"), "sha256", "size_bytes")


NAMES = """
v_names AS (SELECT event_id, 'file.' || event_id || (['.PDF','.txt','.markdown','.tsv','.HTM','','.exe','.text'])[event_id % 8 + 1] AS n,
  (['TEXT/HTML; charset=x','application/pdf',NULL,'text/tab-separated-values ','image/png'])[event_id % 5 + 1] AS m FROM events)"""


def names(spark, sf):
    i = F.col("event_id")
    ext = F.array(*[F.lit(x) for x in (".PDF", ".txt", ".markdown", ".tsv", ".HTM", "", ".exe", ".text")])
    mime = F.array(*[F.lit(x) for x in ("TEXT/HTML; charset=x", "application/pdf", None, "text/tab-separated-values ", "image/png")])
    return V.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("file."), i.cast("string"), F.element_at(ext, (i % 8 + 1).cast("int"))).alias("n"),
        F.element_at(mime, (i % 5 + 1).cast("int")).alias("m"), "props",
    )


_FMT = """coalesce(CASE lower(regexp_extract(n, '\\.([^.]*)\\z', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'txt' WHEN 'text' THEN 'txt' WHEN 'markdown' THEN 'markdown' WHEN 'tsv' THEN 'csv' WHEN 'htm' THEN 'html' END,
  CASE trim(split_part(lower(m), ';', 1)) WHEN 'text/html' THEN 'html' WHEN 'application/pdf' THEN 'pdf' WHEN 'text/tab-separated-values' THEN 'csv' END)"""


@check("s02_detect_format", O.sql([NAMES], f"SELECT event_id, {_FMT} AS format FROM v_names"))
def _(spark, sf):
    return names(spark, sf).select("event_id", files.detect_format(F.col("n"), F.col("m")).alias("format"))


@check(
    "s03_decode_text",
    "SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN text || repeat(chr(1), (doc_id % 3)::INT) END AS text, CASE WHEN doc_id % 3 = 2 THEN 'UNSUPPORTED_FILE' END AS error FROM documents",
)
def _(spark, sf):
    n = (F.col("doc_id") % 3).cast("int")
    content = F.concat(F.repeat(F.lit("\x00"), n), F.lit("﻿"), F.col("text"))
    content = F.when(n == 0, F.concat(F.lit("﻿"), F.col("text"))).otherwise(content).cast("binary")
    decoded = V.table(spark, sf, "documents").select("doc_id", n.alias("n"), files.decode_text(content).alias("d"))
    clean = F.concat(F.regexp_replace("d.text", "^\x00﻿", ""), F.repeat(F.lit("\x01"), F.col("n")))
    return decoded.select("doc_id", clean.alias("text"), "d.error")


@check(
    "s04_triage",
    O.sql([NAMES], f"""SELECT event_id, CASE WHEN f IS NULL THEN 'UNSUPPORTED_FILE' WHEN event_id % 11 = 0 THEN 'FILE_TOO_LARGE' WHEN f = 'pdf' AND (event_id % 2 = 0 OR event_id % 7 = 0) THEN 'UNSUPPORTED_FILE' WHEN f = 'pdf' THEN 'OCR_REQUIRED'
      WHEN event_id % 7 = 0 THEN 'EMPTY_DOCUMENT' END AS reject_code FROM (SELECT event_id, {_FMT} AS f FROM v_names)"""),
)
def _(spark, sf):
    i = F.col("event_id")
    content = F.when(i % 11 == 0, F.repeat("props", 30)).when(i % 7 == 0, F.lit(" \n\t")).when(i % 2 == 1, F.concat(F.lit("%PDF-1.7 "), "props")).otherwise(F.col("props")).cast("binary")
    return names(spark, sf).select("event_id", files.triage(F.col("n"), F.col("m"), content, max_bytes=200).alias("reject_code"))


@check(
    "s05_dedupe",
    """SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 4 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY sha256(text)""",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return files.dedupe_by_hash(d.filter("doc_id % 4 <> 0"), d.filter("doc_id % 4 = 0")).select("doc_id")


@check(
    "s06_read_csv",
    """SELECT p_partkey::VARCHAR || '¦' || trim(p_name) || ', "new"' || '¦' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END || '¦' || p_size AS cells FROM part
       UNION ALL SELECT 'long' || '¦' || r_name || '¦c¦d¦e¦f' FROM region""",
)
def _(spark, sf):
    path = folder(spark, "csv")
    part = V.table(spark, sf, "part")
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""new"""'))
    rows = part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")), F.col("p_size").cast("string"), F.lit("  ")).alias("v"))
    wide = V.table(spark, sf, "region").select(F.concat_ws(",", F.lit("long"), F.col("r_name"), F.lit("c,d,e,f")).alias("v"))
    rows.unionByName(wide).unionByName(wide.select(F.lit(" ,, ").alias("v"))).write.text(f"{path}/rows")
    return files.read_csv_documents(spark, f"{path}/rows").select(F.array_join("cells", "¦").alias("cells"))


def results(spark, sf):
    d = V.docs(spark, sf)
    return records.select_values(d, V.fields(spark, sf)).select(
        F.concat(F.when(F.col("doc_id") % 3 == 0, "=").when(F.col("doc_id") % 3 == 1, "-").otherwise(""), "original_filename").alias("original_filename"),
        "document_type", "schema_name", "vendor_name", "invoice_number", "invoice_date", "currency",
        F.col("total").cast("decimal(18,2)").alias("total"), F.concat(F.lit('A "b", '), F.col("vendor_name")).alias("summary_values"), "review_status", "updated_at",
        F.lit(1).alias("open_issues"), "doc_id",
    )


_G = "CASE doc_id % 3 WHEN 0 THEN '''=' WHEN 1 THEN '''-' ELSE '' END || original_filename"


@check(
    "s07_export_csv",
    O.sql(q_records.SEL, f"""SELECT concat_ws(',', {_G}, document_type, coalesce(schema_name, ''), coalesce(vendor_name, ''), coalesce(invoice_number, ''), coalesce(invoice_date, ''), coalesce(currency, ''),
      coalesce(CAST(total::DECIMAL(18,2) AS VARCHAR), ''), CASE WHEN vendor_name IS NULL THEN '' ELSE '"A ""b"", ' || vendor_name || '"' END, review_status, updated_at, '1', doc_id::VARCHAR) AS line FROM v_sel"""),
)
def _(spark, sf):
    path = folder(spark, "export")
    export.export_csv(results(spark, sf), f"{path}/csv")
    # Every file starts with the header.
    return spark.read.text(f"{path}/csv").filter(F.col("value") != ",".join(export.EXPORT_COLUMNS)).select(F.col("value").alias("line"))


@check("s08_export_json", O.sql(q_records.SEL, "SELECT '{\"doc_id\":' || doc_id || ',\"vendor_name\":' || coalesce('\"' || vendor_name || '\"', 'null') || ',\"review_status\":\"' || review_status || '\"}' AS line FROM v_sel"))
def _(spark, sf):
    path = folder(spark, "export")
    export.export_json(results(spark, sf).select("doc_id", "vendor_name", "review_status"), f"{path}/json")
    return spark.read.text(f"{path}/json").select(F.col("value").alias("line"))


@check("s09_store_round_trip", O.sql([O.EXTRACTIONS, O.RAW_FIELDS], "SELECT field_id, extraction_id, path, extracted_value FROM v_raw"))
def _(spark, sf):
    path = folder(spark, "store")
    store.save_table(store.conform(V.raw_fields(spark, sf), "fields"), path, "fields")
    return store.load_table(spark, path, "fields").select("field_id", "extraction_id", "path", "extracted_value")


# --- requests ------------------------------------------------------------------------------

REQUESTS = f"""
v_req AS (SELECT 'o' || o_orderkey AS id, (['Show invoices from ' || lower(c_name) || ' over $1,234.567', 'USD invoices between 500 and 1,000.5 in 1997 in 2021', 'approved ' || c_name || ' at least 20 eur', 'needs review before 2024-05-06 after 2023-01-02 €',
   'pending amounts at most 7 or above 9', 'mention ' || c_mktsegment || ' Trucks', '   ', 'less than £5 dollars'])[o_orderkey % 8 + 1] AS text FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations)"""


@V.view
def requests(spark, sf):
    k = F.col("o_orderkey")
    s = F.lit
    shapes = F.array(
        F.concat(s("Show invoices from "), F.lower("c_name"), s(" over $1,234.567")), s("USD invoices between 500 and 1,000.5 in 1997 in 2021"),
        F.concat(s("approved "), "c_name", s(" at least 20 eur")), s("needs review before 2024-05-06 after 2023-01-02 €"), s("pending amounts at most 7 or above 9"),
        F.concat(s("mention "), "c_mktsegment", s(" Trucks")), s("   "), s("less than £5 dollars"),
    )
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    turns = V.table(spark, sf, "conversations")
    return o.select(F.concat(s("o"), k.cast("string")).alias("id"), F.element_at(shapes, (k % 8 + 1).cast("int")).alias("text")).unionByName(
        turns.select(F.concat(s("c"), F.col("conv_id").cast("string"), s("_"), F.col("turn").cast("string")).alias("id"), "text")
    )


def vendors(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_name").alias("vendor_name"))
    return c.unionByName(V.table(spark, sf, "part").select(F.initcap("p_name").alias("vendor_name"))).unionByName(c.select(F.concat("vendor_name", F.lit(" Co")).alias("vendor_name")))


_NUM = "\\$?€?([0-9][0-9,]*(?:\\.[0-9]+)?)"
_SP = f"{O.WS}+"


def _n(p, g=1):
    return f"CAST(round(CAST(regexp_replace(replace(regexp_extract(text, '{p}', {g}), ',', ''), '(\\.[0-9]{{4}}).*', '\\1') AS DECIMAL(38,4)), 2)::DECIMAL(38,2) AS VARCHAR)"


_PATTERNS = [
    ("between", f"(?i)between{_SP}{_NUM}{_SP}and{_SP}{_NUM}"), ("gte", f"(?i)(?:at least|>=){_SP}{_NUM}"), ("lte", f"(?i)(?:at most|<=|no more than){_SP}{_NUM}"),
    ("gt", f"(?i)(?:above|over|greater than|more than|>){_SP}{_NUM}"), ("lt", f"(?i)(?:below|under|less than|<){_SP}{_NUM}"),
]
AMOUNTS = f"""
v_t AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _PATTERNS)} END AS amount_comparator,
  CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN {_n(p)}" for n, p in _PATTERNS)} END AS amount_value,
  CASE WHEN regexp_matches(text, '{_PATTERNS[0][1]}') THEN {_n(_PATTERNS[0][1], 2)} END AS amount_value_to,
  CASE WHEN regexp_matches(text, '(?i)\\beur\\b|€') THEN 'EUR' WHEN regexp_matches(text, '(?i)\\busd\\b|\\bdollars?\\b|\\$') THEN 'USD' WHEN regexp_matches(text, '(?i)\\bgbp\\b|£') THEN 'GBP' END AS currency,
  CASE WHEN regexp_matches(text, '(?i)\\bapproved\\b') THEN 'approved' WHEN regexp_matches(text, '(?i)\\b(needs review|pending|unapproved|draft|to review)\\b') THEN 'needs_review,ready,reopened' END AS review_status,
  coalesce(nullif(regexp_extract(text, '(?i)\\bin{_SP}(20[0-9]{{2}})\\b', 1), '') || '-01-01', nullif(regexp_extract(text, '(?i)\\bafter{_SP}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1), '')) AS date_from,
  coalesce(nullif(regexp_extract(text, '(?i)\\bin{_SP}(20[0-9]{{2}})\\b', 1), '') || '-12-31', nullif(regexp_extract(text, '(?i)\\bbefore{_SP}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1), '')) AS date_to
  FROM (SELECT id, {O.trim("text")} AS text FROM v_req) WHERE text <> '')"""
VENDORS = """
v_vend AS (SELECT DISTINCT vendor_name, list_filter(string_split_regex(lower(vendor_name), '\\s+'), lambda w: length(w) > 2) AS words FROM (SELECT c_name AS vendor_name FROM customer UNION ALL SELECT c_name || ' Co' FROM customer
  UNION ALL SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') FROM part)),
v_hit AS (SELECT id, arg_min(vendor_name, (-length(vendor_name), vendor_name)) AS vendor FROM v_t, v_vend WHERE len(words) > 0 AND contains(lower(text), words[1]) AND (len(words) < 2 OR contains(lower(text), words[2])) GROUP BY id)"""


@check("t01_amounts", O.sql([REQUESTS, AMOUNTS], "SELECT id, amount_comparator, amount_value, amount_value_to FROM v_t"))
def _(spark, sf):
    return tagged(spark, sf).select("id", "amount_comparator", "amount_value", "amount_value_to")


@check("t02_mentions", O.sql([REQUESTS, AMOUNTS], "SELECT id, currency, review_status, date_from, date_to FROM v_t"))
def _(spark, sf):
    return tagged(spark, sf).select("id", "currency", "review_status", "date_from", "date_to")


def tagged(spark, sf):
    return tagging.tag_requests(requests(spark, sf), vendors(spark, sf))


@check("t03_vendors", O.sql([REQUESTS, AMOUNTS, VENDORS], "SELECT * FROM v_hit"))
def _(spark, sf):
    return tagging.match_vendors(requests(spark, sf), vendors(spark, sf))


STOP = str(list(tagging.V.STOPWORDS))
LEFT = f"""
v_left AS (SELECT t.*, vendor, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({STOP}, w) AND NOT regexp_matches(w, '^[0-9]')
   AND NOT coalesce(w IN (amount_value, amount_value_to), false) AND NOT (currency IS NOT NULL AND list_contains({list(tagging.V.CURRENCY_WORDS)}, w)) AND NOT coalesce(contains(lower(vendor), w), false)) AS lft
  FROM v_t t LEFT JOIN v_hit h ON h.id = t.id),
v_fb AS (SELECT *, coalesce(vendor, amount_comparator, currency, review_status, date_from, date_to) IS NULL AS none FROM v_left)"""


@check(
    "t04_left_over_terms",
    O.sql([REQUESTS, AMOUNTS, VENDORS, LEFT], f"""SELECT id, CASE WHEN none AND len(lft) > 0 THEN array_to_string(lft, ' ') END AS search, CASE WHEN none THEN '' ELSE array_to_string(lft, ', ') END AS unparsed_terms,
      concat_ws(' | ', CASE WHEN amount_comparator IS NOT NULL AND currency IS NULL THEN '{tagging.NO_CURRENCY}' END, CASE WHEN NOT none AND len(lft) > 0 THEN 'Ignored: ' || array_to_string(lft, ', ') || '. Only recognized filters are applied.' END) AS warnings,
      none AND len(lft) = 0 AS needs_clarification FROM v_fb"""),
)
def _(spark, sf):
    return tagged(spark, sf).select("id", "search", "unparsed_terms", "warnings", "needs_clarification")


# --- streams -------------------------------------------------------------------------------


# Pages as HTML, documents as Markdown, customers of a nation as CSV, and files that cannot be taken.
_CELLS = "c_custkey || chr(9) || c_name || ', ' || c_mktsegment || chr(9) || c_mktsegment || chr(9)"
INGESTED = f"""
v_files AS (SELECT 'p' || page_id || '.html' AS doc_id, page_id % 2 AS part, 'html' AS kind, sha256('<!-- ' || page_id || ' -->' || html) AS hash FROM pages
  UNION ALL SELECT 'd' || doc_id || '.md', doc_id % 2, 'md', sha256(text) FROM documents
  UNION ALL SELECT 'n' || n_nationkey || '.csv', n_nationkey % 2, 'csv', 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'x' || r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN '.exe' ELSE '.txt' END, r_regionkey % 2, 'bad', 'x' || r_regionkey FROM region),
v_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY part, doc_id) AS nth FROM v_files) WHERE nth = 1),
v_html AS ({q_canonical._html_sql()}),
v_csv AS (SELECT n_nationkey, 'Customer No' || chr(9) || 'Name' || chr(9) || 'Segment' || chr(9) || 'Note' || coalesce(string_agg(chr(10) || {_CELLS}, '' ORDER BY c_custkey), '') AS text
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
v_all_text AS (SELECT 'p' || page_id || '.html' AS doc_id, text FROM v_html
  UNION ALL SELECT 'd' || doc_id || '.md', regexp_replace(text, '\\r\\n?', chr(10), 'g') FROM documents UNION ALL SELECT 'n' || n_nationkey || '.csv', text FROM v_csv),
v_docs_text AS MATERIALIZED (SELECT doc_id, text FROM v_all_text SEMI JOIN v_first USING (doc_id) WHERE {O.trim("text")} <> '')"""
COMMITTED = [
    INGESTED if part is X.TEXTS else part for part in q_structure.FULL
]


@check(
    "i01_incremental_ingest",
    O.sql([*COMMITTED, """
      v_n AS (SELECT *, doc_id AS extraction_id, 'adhoc' AS schema_key, value AS extracted_value, NULL::VARCHAR AS corrected_value, 'needs_review' AS review_state,
        row_number() OVER (PARTITION BY doc_id ORDER BY stage, major, minor, row_no, column_no) AS sort_order, row_number() OVER () AS field_id,
        CASE WHEN confidence_score >= 0.85 THEN 'high' ELSE 'medium' END AS confidence_state FROM v_all)""", O.typed("v_n", "v_t"), O.single("v_t", "v_one"), q_rules.RULES],
        """SELECT extraction_id AS original_filename, path, sort_order, value_text, CAST(value_numeric AS VARCHAR) AS value_numeric, value_date, validation_state,
           CASE WHEN needs_attention THEN 'needs_review' ELSE 'auto_accepted' END AS review_state FROM v_valid
         UNION ALL SELECT f.doc_id, NULL, NULL, CASE WHEN t.doc_id IS NOT NULL THEN NULL WHEN f.doc_id LIKE '%.exe' THEN 'UNSUPPORTED_FILE' ELSE 'EMPTY_DOCUMENT' END, NULL, NULL, NULL,
           CASE WHEN t.doc_id IS NULL THEN 'failed' ELSE 'succeeded' END FROM v_first f LEFT JOIN v_docs_text t ON t.doc_id = f.doc_id"""),
)
def _(spark, sf):
    """Two runs over one folder, the second with a new checkpoint: it meets the first run's files again."""
    path = folder(spark, "ingest")
    for part in (0, 1):
        _write_files(ingest_files(spark, sf).filter(F.col("part") == part), f"{path}/in")
        ingest.ingest_stream(spark, f"{path}/in", f"{path}/store", f"{path}/state{part}").awaitTermination()
    documents = processing.committed_table(spark, f"{path}/store", "documents")
    fields = processing.committed_table(spark, f"{path}/store", "fields").join(documents.select("doc_id", "original_filename"), "doc_id")
    null = F.lit(None).cast("string")
    return fields.select(
        "original_filename", "path", "sort_order", "value_text", F.col("value_numeric").cast("string").alias("value_numeric"), "value_date", "validation_state", "review_state"
    ).unionByName(
        documents.select(
            "original_filename", null.alias("path"), F.lit(None).cast("int").alias("sort_order"), F.col("reject_code").alias("value_text"),
            null.alias("value_numeric"), null.alias("value_date"), null.alias("validation_state"), F.col("processing_status").alias("review_state"),
        )
    )


def ingest_files(spark, sf):
    """(name, part, content) of the files of the check."""

    def file(key, letter, ending, content):
        name = F.concat(F.lit(letter), key.cast("string"), ending)
        return (name.alias("name"), (key % 2).cast("int").alias("part"), content.alias("content"))

    k = F.col("page_id")
    pages = V.table(spark, sf, "pages").select(*file(k, "p", F.lit(".html"), F.concat(F.lit("<!-- "), k.cast("string"), F.lit(" -->"), "html")))
    documents = V.table(spark, sf, "documents").select(*file(F.col("doc_id"), "d", F.lit(".md"), F.col("text")))
    quoted = F.concat(F.lit('"'), "c_name", F.lit(", "), "c_mktsegment", F.lit('"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, "c_mktsegment", F.lit("\r\n"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda r: r["line"]), "")
    customers = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(lines.alias("lines"))
    nations = V.table(spark, sf, "nation").join(customers, "n_nationkey", "left")
    text = F.concat(F.lit("Customer No,Name,Segment,Note\r\n"), F.coalesce("lines", F.lit("")))
    tables = nations.select(*file(F.col("n_nationkey"), "n", F.lit(".csv"), text))
    r = F.col("r_regionkey")
    blank = F.concat(F.lit(" \n"), F.repeat(F.lit("\t"), r.cast("int")))
    bad = V.table(spark, sf, "region").select(*file(r, "x", F.when(r % 2 == 0, ".exe").otherwise(".txt"), blank))
    return pages.unionByName(documents).unionByName(tables).unionByName(bad)


def _write_files(rows, target):
    """One file for each row, written by the executors."""

    def write(rows):
        os.makedirs(target, exist_ok=True)
        for r in rows:
            with open(f"{target}/.{r.name}.tmp", "w", encoding="utf8", newline="") as out:
                out.write(r.content)
            os.replace(f"{target}/.{r.name}.tmp", f"{target}/{r.name}")

    rows.foreachPartition(write)


@check("i02_stream_dedupe", "SELECT sha256(html) AS sha256 FROM pages GROUP BY 1")
def _(spark, sf):
    path = folder(spark, "dedupe")
    pages = V.table(spark, sf, "pages").select(F.col("html").cast("binary").alias("content"))
    pages.unionByName(pages).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("content binary").parquet(f"{path}/in")
    query = (
        ingest.distinct_stream(stream).select("sha256").writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


KINDS = ("view", "purchase", "signup", "error", "click")


@check(
    "i03_document_state",
    """SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS last_kind, count(*) AS n_events, """
    + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS) + " FROM events GROUP BY user_id",
)
def _(spark, sf):
    path = folder(spark, "state")
    log = V.table(spark, sf, "events")
    # The log in four files, two to a batch.
    log.repartitionByRange(4, "event_id").write.parquet(f"{path}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/log")
    log = source.select(F.col("user_id").alias("doc_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    events.keep_state(events.document_state(log, KINDS), f"{path}/state", f"{path}/check").awaitTermination()
    return events.current_state(spark, f"{path}/state").drop("last_at")


@check(
    "i04_failure_isolation",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS processing_status, CASE WHEN doc_id % 5 = 0 THEN 'UNSUPPORTED_FILE' END AS reject_code FROM documents""",
)
def _(spark, sf):
    bad = F.col("doc_id") % 5 == 0
    content = F.when(bad, F.concat(F.lit("\x00\x00"), "text")).otherwise(F.col("text")).cast("binary")
    raw = V.table(spark, sf, "documents").select(
        F.concat(F.lit("/in/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"), F.length("text").alias("length")
    )
    return ingest.parse_files(raw).select(
        F.regexp_extract("original_filename", "d(\\d+)", 1).cast("bigint").alias("doc_id"), "processing_status", "reject_code"
    )
