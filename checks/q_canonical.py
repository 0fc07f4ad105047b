"""Checks of the canonical text structure."""

from pyspark.sql import functions as F

from docrecords.functions import text
from docrecords.operators import canonical

from . import oracle_base as O
from . import oracle_text as X
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


def lines(spark, sf):
    return V.lines(spark, sf)


@check(
    "c01_normalize_text",
    """SELECT doc_id, regexp_replace(regexp_replace(t, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g') AS text FROM (
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) ELSE '' END || replace(text, '. ', chr(13) || chr(10)) || chr(13) AS t FROM documents)""",
)
def _(spark, sf):
    raw = F.concat(
        F.when(F.col("doc_id") % 2 == 0, "﻿").otherwise(""), F.replace("text", F.lit(". "), F.lit("\r\n")), F.lit("\r")
    )
    return V.table(spark, sf, "documents").select("doc_id", text.normalize_text(raw).alias("text"))


def _html_sql():
    x = "regexp_replace(html, '\\r\\n?', chr(10), 'g')"
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<head\\b[^>]*>.*?</head>', ' ', 'g')"
    x = f"regexp_replace({x}, '{O.WS}*((?i)</?(?:table|thead|tbody|tfoot|tr|td|th)\\b[^>]*>){O.WS}*', '\\1', 'g')"
    h = "|".join(f"<h{i}\\b[^>]*>.*?</h{i}>" for i in range(1, 7))
    inner = O.trim("regexp_replace(regexp_extract(m, '(?is)^<h[1-6]\\b[^>]*>(.*)</h[1-6]>$', 1), '<[^>]+>', ' ', 'g')")
    step1 = f"SELECT page_id, string_split_regex(x, '(?is)(?:{h})') AS b, regexp_extract_all(x, '(?is)(?:{h})') AS m FROM (SELECT page_id, {x} AS x FROM pages)"
    conv = f"list_transform(m, lambda m: chr(10) || repeat('#', regexp_extract(m, '(?i)^<h([1-6])', 1)::INT) || ' ' || {inner} || chr(10))"
    step2 = f"SELECT page_id, array_to_string(list_transform(list_zip(b, {conv}), lambda z: z[1] || coalesce(z[2], '')), '') AS y FROM ({step1})"
    y = "y"
    for p, r in (
        ("(?i)<li\\b[^>]*>", "chr(10) || '- '"), ("(?i)</tr>", "chr(10)"), ("(?i)<t[dh]\\b[^>]*>", "chr(9)"),
        ("(?i)</(p|div|section|article|header|footer|ul|ol|table|tr|br)>", "chr(10)"),
    ):
        y = f"regexp_replace({y}, '{p}', {r}, 'g')"
    y = f"replace(regexp_replace({y}, '(?i)<br{O.WS}*/?>', chr(1), 'g'), chr(1) || chr(10), '<br>' || chr(10))"
    y = f"replace({y}, chr(1), chr(10))"
    y = f"regexp_replace({y}, '(?i)<(p|div|section|article|header|footer|ul|ol|table)\\b[^>]*>', chr(10), 'g')"
    y = f"regexp_replace({y}, '<[^>]+>', ' ', 'g')"
    y = _entities_sql(y)
    line = f"regexp_replace(regexp_replace(regexp_replace(l, '[ \\x{{00A0}}]{{2,}}', ' ', 'g'), '[ \\t]+\\z', ''), '^{O.WS}+', '')"
    z = f"array_to_string(list_transform(string_split({y}, chr(10)), lambda l: {line}), chr(10))"
    z = f"regexp_replace({z}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, {O.trim('z')} AS text FROM (SELECT page_id, {z} AS z FROM ({step2}))"


def _entities_sql(x):
    # One pass over the named entities: protect the ampersands that come from &amp; itself.
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")):
        x = f"regexp_replace({x}, '(?i)&{name};', '{value}', 'g')"
    return f"replace(regexp_replace({x}, '(?i)&amp;', '&', 'g'), '&#39;', '''')"


@check("c02_html_to_text", _html_sql())
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@check(
    "c03_decode_entities",
    "SELECT page_id, " + _entities_sql("replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '***', '😀A')")
    + " AS text FROM pages",
)
def _(spark, sf):
    marked = F.replace("html", F.lit("&copy;"), F.lit("&#169;"))
    marked = F.replace(marked, F.lit("&middot;"), F.lit("&#xB7;"))
    marked = F.replace(marked, F.lit("***"), F.lit("&#128512;&#x41;"))
    return V.table(spark, sf, "pages").select("page_id", text.decode_entities(marked).alias("text"))


@check("c04_lines", O.sql([X.TEXTS, X.LINES], 'SELECT doc_id, line_no, text, start, start + length(text) AS "end" FROM v_l1'))
def _(spark, sf):
    return canonical.explode_lines(V.texts(spark, sf))


@check(
    "c05_tabular_cells",
    O.sql(X.PARSE, f"""SELECT doc_id, line_no, k = 'tabular' AS tabular, array_to_string({X.cells("text")}, '¦') AS cells FROM v_l WHERE kind <> 'blank'"""),
)
def _(spark, sf):
    t = F.col("text")
    return canonical.explode_lines(V.texts(spark, sf)).filter(t.rlike("[^ ]")).select(
        "doc_id", "line_no", canonical.looks_tabular(t).alias("tabular"), F.array_join(canonical.split_cells(t), "¦").alias("cells")
    )


@check(
    "c06_tables",
    O.sql([*X.PARSE, X.TABLES], """SELECT doc_id, table_no, row_count, width, array_to_string(list_resize(h, width, ''), '¦') AS headers, start, "end" FROM v_tables"""),
)
def _(spark, sf):
    return canonical.tables(lines(spark, sf)).withColumn("headers", F.array_join("headers", "¦")).drop("heading")


@check(
    "c07_table_cells",
    O.sql([*X.PARSE, X.TABLES], 'SELECT doc_id, table_no, row_no, column_no, header, value, start, "end" FROM v_cells'),
)
def _(spark, sf):
    return canonical.table_cells(lines(spark, sf)).drop("table_start", "heading")


@check(
    "c08_blocks",
    O.sql([*X.PARSE, X.KV, X.BLOCKS], 'SELECT doc_id, block_no, kind, text, start, "end", level FROM v_blocks'),
)
def _(spark, sf):
    return canonical.blocks(lines(spark, sf)).drop("heading", "section_no")


@check(
    "c09_heading_like",
    O.sql([X.TEXTS, X.LINES], f"SELECT doc_id, line_no FROM v_l1 WHERE {X.HEADING_LIKE}"),
)
def _(spark, sf):
    found = canonical.explode_lines(V.texts(spark, sf))
    return found.filter(canonical.is_heading_like(text.trim_ws(F.col("text")))).select("doc_id", "line_no")


@check("c10_key_values", O.sql([*X.PARSE, X.KV], 'SELECT doc_id, line_no, pair_no, key, value, start, "end" FROM v_kv'))
def _(spark, sf):
    return canonical.key_values(lines(spark, sf)).drop("heading")


PAGES = "v_pages AS (SELECT doc_id, p + 1 AS page, p * 700 AS page_start FROM (SELECT doc_id, unnest(range(0, (length(text) // 700) + 1)) AS p FROM v_docs_text))"


@check(
    "c11_page_of_offset",
    O.sql([*X.PARSE, PAGES], """SELECT l.doc_id, l.line_no, max(p.page) AS page FROM v_l1 l JOIN v_pages p ON p.doc_id = l.doc_id AND p.page_start <= l.start GROUP BY ALL"""),
)
def _(spark, sf):
    t = V.texts(spark, sf)
    spans = canonical.explode_lines(t).select("doc_id", "line_no", "start")
    return canonical.page_for_offset(spans, text_pages(t)).select("doc_id", "line_no", "page")


def text_pages(t):
    starts = t.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 700).cast("int"))).alias("p"))
    return starts.select("doc_id", (F.col("p") + 1).alias("page"), (F.col("p") * 700).alias("page_start"))


@check(
    "c12_utf16_length",
    """SELECT conv_id, turn, (length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS units
      FROM (SELECT conv_id, turn, replace(text, 'e', '😀') AS t FROM conversations)""",
)
def _(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.utf16_len(F.replace("text", F.lit("e"), F.lit("😀"))).alias("units")
    )


@check(
    "c13_latest_parse",
    """SELECT doc_id, parse_id, content_hash FROM (SELECT user_id AS doc_id, event_id AS parse_id, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'parse.v1' END AS v,
      sha256(props) AS content_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND v = 'parse.v1'""",
)
def _(spark, sf):
    parses = V.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("parse_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 5 == 0, "old").otherwise("parse.v1").alias("parser_version"),
        canonical.content_hash(F.col("props")).alias("content_hash"),
    )
    return canonical.latest_parse(parses).select("doc_id", "parse_id", "content_hash")


# Quotes: every second line exactly, the others in upper case with doubled spaces, some unknown.
QUOTES = """
v_quotes AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN text WHEN line_no % 7 = 1 THEN text || ' (unknown)' ELSE replace(replace(upper(text), 'ẞ', 'ß'), ' ', '  ') END AS quote FROM v_l1)"""
GROUND = f"""
v_ground AS (SELECT *, CASE WHEN quote_t = '' THEN 'none' WHEN ex > 0 OR hit <> '' THEN 'grounded' ELSE 'unresolved' END AS status,
   strpos(text, hit) - 1 AS loose FROM (
  SELECT q.doc_id, q.line_no, d.text, {O.trim("q.quote")} AS quote_t, strpos(d.text, {O.trim("q.quote")}) AS ex,
    CASE WHEN {O.trim("q.quote")} <> '' AND strpos(d.text, {O.trim("q.quote")}) = 0 THEN
      regexp_extract(d.text, '(?i)' || regexp_replace(regexp_replace({O.trim("q.quote")}, '([\\\\.\\[\\]{{}}()*+?^$|#&~])', '\\\\\\1', 'g'), '{O.WS}+', '{O.WS.replace(chr(92), chr(92) * 2)}+', 'g')) ELSE '' END AS hit
  FROM v_quotes q JOIN v_docs_text d ON d.doc_id = q.doc_id))"""


@check(
    "c14_resolve_quotes",
    O.sql([*X.PARSE, QUOTES, GROUND], f"""SELECT *, CASE WHEN grounding_status = 'grounded' THEN start // 700 + 1 END AS page FROM (SELECT doc_id, line_no, status AS grounding_status,
      (CASE WHEN status <> 'grounded' THEN 0 WHEN ex > 0 THEN ex - 1 ELSE loose - CASE WHEN loose = length(regexp_extract(left(text, loose), '{O.WS}*\\z')) THEN loose
        ELSE greatest(0, length(regexp_extract(left(text, loose), '{O.WS}*\\z')) - 1) END END)::INT AS start,
      (CASE WHEN status <> 'grounded' THEN 0 WHEN ex > 0 THEN ex - 1 + length(quote_t) ELSE loose + length(hit) END)::INT AS "end" FROM v_ground)"""),
)
def _(spark, sf):
    t = V.texts(spark, sf)
    line = F.col("text")
    no = F.col("line_no")
    quote = F.when(no % 2 == 0, line).when(no % 7 == 1, F.concat(line, F.lit(" (unknown)"))).otherwise(
        F.replace(F.replace(F.upper(F.replace(line, F.lit("ß"), F.lit("\u0001"))), F.lit("\u0001"), F.lit("ß")), F.lit(" "), F.lit("  "))
    )
    quotes = canonical.explode_lines(t).select("doc_id", "line_no", quote.alias("quote"))
    return canonical.resolve_quotes(quotes, t, text_pages(t)).drop("quote")


@check(
    "c15_span_text",
    O.sql([*X.PARSE, X.KV], """SELECT k.doc_id, k.line_no, k.pair_no, substr(d.text, k.start + 1, length(k.value)) AS snippet FROM v_kv k JOIN v_docs_text d ON d.doc_id = k.doc_id"""),
)
def _(spark, sf):
    t = V.texts(spark, sf)
    found = canonical.key_values(lines(spark, sf)).join(t, "doc_id")
    return found.select("doc_id", "line_no", "pair_no", canonical.span_text(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))
