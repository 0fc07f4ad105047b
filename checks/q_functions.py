"""Checks of the column functions."""

from pyspark.sql import functions as F

from docrecords.functions import money, paths, text, typing

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


def texts(spark, sf):
    """Labels of every kind: names, segments, priorities and whole conversation turns."""
    t = V.table
    return (
        t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit("_"), "p_brand", F.lit("Type-"), "p_type").alias("s"))
        .unionByName(t(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  orderPriority")).alias("s")))
        .unionByName(t(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("s")))
        .unionByName(t(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.concat("event_type", F.lit("Total_%\\x")).alias("s")))
        .unionByName(t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.translate("n_name", "NATIO_0123456789", "-- _").alias("s")))
    )


TEXTS = """
v_texts AS (
  SELECT 'p' || p_partkey::VARCHAR AS id, p_name || '_' || p_brand || 'Type-' || p_type AS s FROM part
  UNION ALL SELECT 'o' || o_orderkey::VARCHAR, ' ' || o_orderpriority || '  orderPriority' FROM orders
  UNION ALL SELECT 'c' || conv_id::VARCHAR || '_' || turn::VARCHAR, text FROM conversations
  UNION ALL SELECT 'e' || event_id::VARCHAR, event_type || 'Total_%\\x' FROM events
  UNION ALL SELECT 'n' || n_nationkey::VARCHAR, translate(n_name, 'NATIO_0123456789', '-- _') FROM nation)"""


def camel(x):
    return f"""coalesce(nullif(array_to_string(list_transform(string_split(trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')), ' '),
      lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ''), ''), 'field')"""


def snake(x):
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'schema')"


def up1(x):
    return f"CASE WHEN left({x}, 1) = 'ß' THEN 'SS' ELSE upper(left({x}, 1)) END || substr({x}, 2)"


def human(x):
    spaced = O.trim(f"regexp_replace(regexp_replace(regexp_replace({x}, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '{O.WS}+', ' ', 'g')")
    return f"CASE WHEN {spaced} = '' THEN {x} ELSE {up1(spaced)} END"


def human_key(x):
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')"
    return f"CASE WHEN regexp_matches({spaced}, '^[A-Za-z0-9_]') THEN upper(left({spaced}, 1)) || substr({spaced}, 2) ELSE {spaced} END"


@check("f01_slug_camel", O.sql([TEXTS], f"SELECT id, {camel('s')} AS slug FROM v_texts"))
def _(spark, sf):
    return texts(spark, sf).select("id", text.slug_camel(F.col("s")).alias("slug"))


@check("f02_slug_snake", O.sql([TEXTS], f"SELECT id, {snake('s')} AS slug FROM v_texts"))
def _(spark, sf):
    return texts(spark, sf).select("id", text.slug_snake(F.col("s")).alias("slug"))


@check("f03_humanize_label", O.sql([TEXTS], f"SELECT id, {human('s')} AS label, {human_key('s')} AS key_label FROM v_texts"))
def _(spark, sf):
    return texts(spark, sf).select(
        "id", text.humanize_label(F.col("s")).alias("label"), text.humanize_key(F.col("s")).alias("key_label")
    )


@check(
    "f04_normalize_vendor",
    O.sql([TEXTS], "SELECT id, CASE WHEN s <> '' THEN trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) END AS vendor FROM v_texts"),
)
def _(spark, sf):
    return texts(spark, sf).select("id", text.normalize_vendor(F.col("s")).alias("vendor"))


def values(spark, sf):
    """Field samples in many spellings, one per order, and the texts."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    plain = V.cents_text(cents)
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    shapes = [
        iso, F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" yes "), F.lit("FALSE"), F.substring("o_orderpriority", 3, 3), F.lit("USD"),
        F.regexp_replace(plain, r"(\d)(\d{3})\.", "$1,$2."), F.concat(F.lit("$"), F.regexp_replace(plain, r"(\d)(\d{3})\.", "$1,$2.")), F.concat(F.lit("-"), plain),
        k.cast("string"), F.concat(F.lit("€ "), (k % 900).cast("string")), F.repeat(F.concat(plain, F.lit(" ")), 14), F.lit("   "), F.concat(iso, F.lit("T10:00")),
        F.concat(plain, F.lit("77")), F.lit("$"), F.regexp_replace((k * 100003).cast("string"), r"(\d)(\d{3})(\d{3})\z", "$1,$2,$3"),
    ]
    return V.table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int")).alias("s"),
        F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.floor(k / 17) % len(TYPES) + 1).cast("int")).alias("type"),
    ).unionByName(texts(spark, sf).select("id", "s", F.lit("string").alias("type")))


TYPES = ("string", "text", "integer", "decimal", "date", "datetime", "boolean", "currency", "enum", "object")
_PLAIN = O.cents_text(O.cents("o_totalprice"))
_COMMA = f"regexp_replace({_PLAIN}, '([0-9])([0-9]{{3}})\\.', '\\1,\\2.')"
VALUES = ",".join([TEXTS, f"""
v_values AS (SELECT o_orderkey::VARCHAR AS id, ([{O.iso('o_orderdate')}, strftime(o_orderdate, '%m/%d/%Y'), ' yes ', 'FALSE', substr(o_orderpriority, 3, 3), 'USD',
  {_COMMA}, '$' || {_COMMA}, '-' || {_PLAIN}, o_orderkey::VARCHAR, '€ ' || (o_orderkey % 900)::VARCHAR, repeat({_PLAIN} || ' ', 14), '   ',
  {O.iso('o_orderdate')} || 'T10:00', {_PLAIN} || '77', '$', regexp_replace((o_orderkey * 100003)::VARCHAR, '([0-9])([0-9]{{3}})([0-9]{{3}})\\z', '\\1,\\2,\\3')])[o_orderkey % 17 + 1] AS s,
  ({list(TYPES)})[(o_orderkey // 17) % {len(TYPES)} + 1] AS type FROM orders
  UNION ALL SELECT id, s, 'string' FROM v_texts)"""])
MONEY_DEC = f"^-?\\$?€?£?{O.WS}?[0-9]{{1,3}}(,[0-9]{{3}})*(\\.[0-9]+)?\\z|^-?[0-9]+(\\.[0-9]+)?\\z"


def infer(x):
    v = O.trim(x)
    return f"""CASE WHEN {v} = '' THEN 'string' WHEN regexp_matches({v}, '^[A-Z]{{3}}\\z') THEN 'currency'
      WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\z|^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\\z') THEN 'date'
      WHEN lower({v}) IN ('true','false','yes','no') THEN 'boolean'
      WHEN regexp_matches(replace({v}, ',', ''), '^-?[0-9]{{1,15}}\\z') THEN 'integer'
      WHEN regexp_matches({v}, '[$€£]') AND regexp_matches({v}, '{MONEY_DEC}') THEN 'currency'
      WHEN regexp_matches({v}, '{MONEY_DEC}') THEN 'decimal' WHEN length({v}) > 120 THEN 'text' ELSE 'string' END"""


def norm(t, x):
    v = O.trim(x)
    bare = f"regexp_replace({v}, '[$€£,{O.WS_CLASS}]', '', 'g')"
    return f"""CASE WHEN {v} = '' THEN NULL
      WHEN {t} = 'integer' THEN CASE WHEN regexp_matches(replace({v}, ',', ''), '^-?[0-9]{{1,15}}\\z') THEN replace({v}, ',', '') ELSE {v} END
      WHEN {t} = 'currency' AND regexp_matches({v}, '^[A-Z]{{3}}\\z') THEN {v}
      WHEN {t} IN ('decimal','currency') THEN CASE WHEN regexp_matches({bare}, '{O.DEC}') THEN {bare} ELSE {v} END
      WHEN {t} = 'boolean' AND lower({v}) IN ('true','yes') THEN 'true' WHEN {t} = 'boolean' AND lower({v}) IN ('false','no') THEN 'false' ELSE {v} END"""


@check("f05_infer_type", O.sql([VALUES], f"SELECT id, {infer('s')} AS type FROM v_values"))
def _(spark, sf):
    return values(spark, sf).select("id", typing.infer_type(F.col("s")).alias("type"))


@check("f06_normalize_value", O.sql([VALUES], f"SELECT id, type, {norm('type', 's')} AS value FROM v_values"))
def _(spark, sf):
    return values(spark, sf).select("id", "type", typing.normalize_value(F.col("type"), F.col("s")).alias("value"))


@check(
    "f07_typed_index",
    O.sql([VALUES, O.typed("(SELECT *, 'confirmed' AS review_state, NULL::VARCHAR AS corrected_value, s AS extracted_value FROM v_values)", "t")],
          "SELECT id, value_text, CAST(value_numeric AS VARCHAR) AS value_numeric, value_date, value_boolean FROM t"),
)
def _(spark, sf):
    index = typing.typed_index(F.col("type"), F.col("s"))
    index["value_numeric"] = index["value_numeric"].cast("string")
    return values(spark, sf).select("id", *[c.alias(n) for n, c in index.items()])


@check(
    "f08_effective_value",
    O.sql([O.EXTRACTIONS, O.RAW_FIELDS], """SELECT field_id, CASE WHEN review_state <> 'not_applicable' THEN coalesce(corrected_value, extracted_value) END AS value FROM v_raw"""),
)
def _(spark, sf):
    return V.raw_fields(spark, sf).select(
        "field_id", typing.effective_value(F.col("review_state"), F.col("corrected_value"), F.col("extracted_value")).alias("value")
    )


MONEY = f"""
v_money AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 3 = 0 THEN '-' ELSE '' END || {O.cents_text(O.cents("l_extendedprice"))} || lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS a,
  l_quantity::BIGINT::VARCHAR || '.' || lpad((l_suppkey * 7919 % 100000)::VARCHAR, 5, '0') AS b FROM lineitem)"""
_CUT = "CAST(regexp_replace({}, '^(-?[0-9]+\\.[0-9]{{4}}).*\\z', '\\1') AS DECIMAL(18,4))"


@check(
    "f09_money",
    O.sql([MONEY], f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(ca, 2)::DECIMAL(38,2) AS VARCHAR) AS cents,
      CAST((CASE WHEN a LIKE '-%' THEN -1 ELSE 1 END * CAST(floor(abs((ca * cb)::DECIMAL(30,8)) * 10000) AS DECIMAL(30,0)) * 0.0001::DECIMAL(5,4))::DECIMAL(38,4) AS VARCHAR) AS product,
      round(ca, 2) = round(cb, 2) AS equal FROM (SELECT *, {_CUT.format('a')} AS ca, {_CUT.format('b')} AS cb FROM v_money)"""),
)
def _(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    a = F.concat(
        F.when(F.col("l_partkey") % 3 == 0, "-").otherwise(""), V.cents_text(cents),
        F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
    )
    b = F.concat(
        F.col("l_quantity").cast("bigint").cast("string"), F.lit("."),
        F.lpad((F.col("l_suppkey") * 7919 % 100000).cast("string"), 5, "0"),
    )
    rows = V.table(spark, sf, "lineitem").withColumns({"a": a, "b": b})
    rows = rows.withColumns({"ma": money.to_money(F.col("a")), "mb": money.to_money(F.col("b"))})
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        money.normalize_decimal(F.col("a")).alias("cents"),
        money.multiply_money(money.to_factor(F.col("a")), money.to_factor(F.col("b"))).cast("string").alias("product"),
        money.equals_cents(F.col("ma"), F.col("mb")).alias("equal"),
    )


_RP = "'^([A-Za-z0-9_]+)\\[([0-9]+)\\]\\.(.+)\\z'"


@check(
    "f10_parse_path",
    O.sql([O.ALL_FIELDS], f"""SELECT field_id, nullif(regexp_extract(path, {_RP}, 1), '') AS array_key,
      CAST(nullif(regexp_extract(path, {_RP}, 2), '') AS INT) AS row_index, nullif(regexp_extract(path, {_RP}, 3), '') AS column_key,
      regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS schema_key,
      regexp_replace(path, '^lineItems\\[[0-9]+\\]\\.(description|quantity|unitPrice|lineTotal)\\z', 'lineItems[].\\1') AS invoice_key FROM v_all"""),
)
def _(spark, sf):
    return V.all_fields(spark, sf).withColumn("p", paths.parse_path(F.col("path"))).select(
        "field_id", "p.array_key", "p.row_index", "p.column_key", paths.schema_key_of(F.col("path")).alias("schema_key"),
        paths.invoice_schema_key(F.col("path")).alias("invoice_key"),
    )


@check(
    "f11_confidence_band",
    "SELECT event_id, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM events",
)
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", typing.confidence_band(F.col("value") / 100).alias("band"))


_WORDS = "name|title|owner|customer|client|company|project|ticket|status|priority|date|budget|currency|total|amount|hours"


@check(
    "f12_field_importance",
    O.sql([VALUES], f"""SELECT id, imp AND type <> 'text' AS required, imp OR type IN ('decimal','integer','currency','date') AS material FROM (
      SELECT id, type, regexp_matches(lower({snake('s')} || ' ' || s), '(^|[^a-z0-9_])({_WORDS})([^a-z0-9_]|$)') AS imp FROM v_values)"""),
)
def _(spark, sf):
    s = F.col("s")
    return values(spark, sf).withColumn(
        "i", typing.field_importance(text.slug_snake(s), s, F.col("type"))
    ).select("id", "i.required", "i.material")


@check(
    "f13_ilike",
    O.sql([TEXTS], """SELECT id, regexp_replace(s, '([\\\\%_])', '\\\\\\1', 'g') AS escaped, contains(lower(s), 'l_%') AS has, lower(s) = 'clicktotal_%\\x' AS same,
      s ILIKE '%L_%' AS wild FROM v_texts"""),
)
def _(spark, sf):
    s = F.col("s")
    return texts(spark, sf).select(
        "id", text.escape_like(s).alias("escaped"), text.contains_ci(s, F.lit("L_%")).alias("has"),
        text.equals_ci(s, F.lit("CLICKTotal_%\\x")).alias("same"), text.like_ci(s, F.lit("L_")).alias("wild"),
    )


@check(
    "f14_schema_hash",
    """SELECT p_partkey, lower(to_base(list_reduce(string_split(p_name || ':' || p_type || '|' || p_brand, ''),
      lambda h, c: ((h::BIGINT * 31 + ascii(c)) & 4294967295)::VARCHAR, '0')::BIGINT, 36)) AS hash FROM part""",
)
def _(spark, sf):
    basis = F.concat("p_name", F.lit(":"), "p_type", F.lit("|"), "p_brand")
    return V.table(spark, sf, "part").select("p_partkey", typing.schema_hash(basis).alias("hash"))
