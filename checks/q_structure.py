"""Checks of the structuring operators."""

from pyspark.sql import functions as F

from docrecords.functions import text as T
from docrecords.functions import typing
from docrecords.operators import canonical, structure
from docrecords.plans.stages import dealt_stage

from . import oracle_base as O
from . import oracle_text as X
from . import q_canonical
from . import views as V
from .q_functions import camel, human, infer, norm

QUERIES = {}
ORACLE = {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


lines = V.lines


@V.view
def keyed(spark, sf):
    return dealt_stage(structure.keyed_candidates(lines(spark, sf)), "keyed", "doc_id", V.texts(spark, sf).buckets)


@V.view
def cells(spark, sf):
    return canonical.table_cells(lines(spark, sf))


def _words(x):
    return f"regexp_matches(lower({x}), '(^|[^a-z0-9_])(name|title|owner|customer|client|company|project|ticket|status|priority|date|budget|currency|total|amount|hours)([^a-z0-9_]|$)')"


NARRATIVE = f"""
v_gate AS (SELECT doc_id FROM v_l WHERE kind <> 'blank' GROUP BY doc_id HAVING bool_or(kind IN ('heading','list-item'))
  OR (coalesce((SELECT count(*) FROM v_kv q WHERE q.doc_id = v_l.doc_id), 0) < 4 AND bool_or(kind = 'paragraph'))),
v_nb AS (SELECT * FROM v_blocks WHERE kind IN ('paragraph','line','list-item') AND doc_id IN (SELECT doc_id FROM v_gate)),
v_prose AS (SELECT doc_id, section_no, string_agg({O.trim("text")}, chr(10) || chr(10) ORDER BY block_no) AS value, arg_min(start, block_no) AS start, arg_max("end", block_no) AS "end", any_value(heading) AS heading
  FROM v_nb WHERE kind <> 'list-item' GROUP BY ALL),
v_lists AS (SELECT doc_id, section_no, any_value(heading) AS heading, count(*) AS n FROM v_nb WHERE kind = 'list-item' GROUP BY doc_id, section_no)"""
CAND = f"""
v_cand AS (
  SELECT doc_id, 0 AS stage, line_no AS major, pair_no AS minor, {camel("key")} AS base, key AS raw_label, value, start, "end", heading FROM v_kv
  UNION ALL SELECT doc_id, 1, table_no, 0, CASE WHEN heading IS NULL THEN CASE WHEN table_no = 0 THEN 'records' ELSE 'table' || (table_no + 1) END ELSE {camel("heading")} END,
    CASE WHEN heading IS NULL THEN CASE WHEN table_no = 0 THEN 'Records' ELSE 'Table ' || (table_no + 1) END ELSE {human("heading")} END, NULL, start, "end", heading FROM v_rows WHERE table_row = 0
  UNION ALL SELECT doc_id, 2, section_no, 0, CASE WHEN heading IS NULL THEN 'content' ELSE {camel("heading")} END, CASE WHEN heading IS NULL THEN 'Details' ELSE {human("heading")} END, value, start, "end", heading FROM v_prose
  UNION ALL SELECT doc_id, 2, section_no, 1, CASE WHEN heading IS NULL AND n = 1 THEN 'items' WHEN heading IS NULL THEN 'itemsEntries' ELSE {camel("heading")} || 'Entries' END,
    CASE WHEN heading IS NULL THEN 'Items' ELSE {human("heading")} END, NULL, NULL, NULL, heading FROM v_lists),
v_perdoc AS (SELECT doc_id, list(base ORDER BY stage, major, minor) AS bases FROM v_cand GROUP BY doc_id),
v_keys0 AS (SELECT doc_id, list_reduce(bases, lambda u, b: list_append(u, CASE WHEN NOT list_contains(u, b) THEN b
    ELSE b || (list_filter(range(2, len(u) + 3), lambda n: NOT list_contains(u, b || n::VARCHAR)))[1]::VARCHAR END), CAST([] AS VARCHAR[])) AS keys FROM v_perdoc),
v_keyed AS MATERIALIZED (SELECT c.*, k.keys[c.rn] AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, major, minor) AS rn FROM v_cand) c JOIN v_keys0 k ON k.doc_id = c.doc_id)"""
_ST = "CASE WHEN heading IS NULL THEN 'details' ELSE " + camel("heading") + " END"
KVF = f"""
v_kvf AS (SELECT doc_id, stage, major, minor, -1 AS row_no, -1 AS column_no, key AS path, key AS schema_field_key, {human("raw_label")} AS label, {_ST} AS field_group, type, imp AND type <> 'text' AS required,
   imp OR type IN ('decimal','integer','currency','date') AS material, 'present' AS presence_state, 'extracted' AS value_origin, {norm("type", "value")} AS value,
   CASE WHEN type = 'text' THEN 0.7 ELSE 0.9 END AS confidence_score, start, "end", true AS grounded FROM (
     SELECT *, {infer("value")} AS type, {_words("key || ' ' || raw_label")} AS imp FROM v_keyed WHERE stage = 0))"""
COLS = f"""
v_ct0 AS (SELECT doc_id, table_no, column_no, header, CASE WHEN {O.trim("value")} <> '' THEN {infer("value")} END AS t, row_no FROM v_cells),
v_ct1 AS (SELECT doc_id, table_no, column_no, header, t, count(*) AS n, min(row_no) AS first FROM v_ct0 GROUP BY ALL),
v_ct AS (SELECT doc_id, table_no, column_no, header, sum(n) FILTER (t IS NULL) IS NULL AS complete, CASE WHEN max(n) FILTER (t IS NOT NULL) IS NULL THEN 'string'
   WHEN arg_max(t, (n, -first)) FILTER (t IS NOT NULL) IN ('decimal','integer','date','currency') AND max(n) FILTER (t IS NOT NULL) / sum(n) FILTER (t IS NOT NULL) < 0.6 THEN 'string'
   ELSE arg_max(t, (n, -first)) FILTER (t IS NOT NULL) END AS type FROM v_ct1 GROUP BY doc_id, table_no, column_no, header),
v_colk AS (SELECT c.*, k.keys[c.rn] AS column_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY column_no) AS rn FROM v_ct WHERE {O.trim("header")} <> '') c JOIN (
   SELECT doc_id, table_no, list_reduce(list({camel("header")} ORDER BY column_no), lambda u, b: list_append(u, CASE WHEN NOT list_contains(u, b) THEN b
    ELSE b || (list_filter(range(2, len(u) + 3), lambda n: NOT list_contains(u, b || n::VARCHAR)))[1]::VARCHAR END), CAST([] AS VARCHAR[])) AS keys
   FROM v_ct WHERE {O.trim("header")} <> '' GROUP BY ALL) k ON k.doc_id = c.doc_id AND k.table_no = c.table_no)"""
TABF = f"""
v_tabf AS (SELECT c.doc_id, 1 AS stage, c.table_no AS major, 0 AS minor, c.row_no, c.column_no, a.key || '[' || c.row_no || '].' || k.column_key AS path, a.key || '[].' || k.column_key AS schema_field_key,
   {human("k.header")} AS label, a.key AS field_group, k.type, false AS required, false AS material, CASE WHEN c.value <> '' THEN 'present' ELSE 'empty' END AS presence_state, 'extracted' AS value_origin,
   CASE WHEN c.value <> '' THEN {norm("k.type", "c.value")} END AS value, 0.85 AS confidence_score, c.start, c."end", c.value <> '' AS grounded
   FROM v_cells c JOIN v_colk k ON k.doc_id = c.doc_id AND k.table_no = c.table_no AND k.column_no = c.column_no JOIN v_keyed a ON a.doc_id = c.doc_id AND a.stage = 1 AND a.major = c.table_no)"""
_PT = f"CASE WHEN length(value) > 120 OR contains(value, chr(10)) THEN 'text' ELSE {infer('value')} END"
NARF = f"""
v_prosef AS (SELECT doc_id, stage, major, minor, -1 AS row_no, -1 AS column_no, key AS path, key AS schema_field_key, raw_label AS label, {_ST} AS field_group, {_PT} AS type, false AS required, false AS material,
   'present' AS presence_state, 'extracted' AS value_origin, value, 0.78 AS confidence_score, start, "end", true AS grounded FROM v_keyed WHERE stage = 2 AND minor = 0),
v_listf AS (SELECT b.doc_id, 2 AS stage, k.major, 1 AS minor, b.i AS row_no, -1 AS column_no, k.key || '[' || b.i || '].text' AS path, k.key || '[].text' AS schema_field_key, 'Text' AS label, k.key AS field_group, 'text' AS type,
   false AS required, false AS material, 'present' AS presence_state, 'extracted' AS value_origin, {O.trim("b.text")} AS value, 0.82 AS confidence_score, b.start, b."end", true AS grounded
   FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY block_no) - 1 AS i FROM v_nb WHERE kind = 'list-item') b JOIN v_keyed k ON k.doc_id = b.doc_id AND k.stage = 2 AND k.minor = 1 AND k.major = b.section_no)"""
FALL = """
v_struct AS MATERIALIZED (SELECT * FROM v_kvf UNION ALL SELECT * FROM v_tabf UNION ALL SELECT * FROM v_prosef UNION ALL SELECT * FROM v_listf),
v_bare AS (SELECT * FROM v_docs_text WHERE doc_id NOT IN (SELECT doc_id FROM v_struct)),
v_fallf AS (SELECT doc_id, 3 AS stage, 0 AS major, minor, -1 AS row_no, -1 AS column_no, key AS path, key AS schema_field_key, label, 'details' AS field_group, type, false AS required, false AS material, 'present' AS presence_state,
   origin AS value_origin, value, score AS confidence_score, start, "end", true AS grounded FROM (
   SELECT b.doc_id, 0 AS minor, 'title' AS key, 'Title' AS label, 'string' AS type, 'inferred' AS origin, t.text AS value, 0.6 AS score, t.start, t."end" FROM v_bare b JOIN
     (SELECT doc_id, arg_min(text, block_no) AS text, arg_min(start, block_no) AS start, arg_min("end", block_no) AS "end" FROM v_blocks WHERE kind = 'heading' GROUP BY doc_id) t ON t.doc_id = b.doc_id
   UNION ALL SELECT doc_id, 1, 'content', 'Content', 'text', 'extracted', text, 0.45, 0, length(text) FROM v_bare)),
v_all AS MATERIALIZED (SELECT * FROM v_struct UNION ALL SELECT * FROM v_fallf)"""
BASE = [*X.PARSE, X.KV, X.BLOCKS, X.TABLES, NARRATIVE, CAND]
FULL = [*BASE, KVF, COLS, TABF, NARF, FALL]
SHOWN = 'doc_id, stage, major, minor, row_no, column_no, path, schema_field_key, label, field_group, type, required, material, presence_state, value_origin, value, confidence_score::DOUBLE AS confidence_score, start, "end", grounded'


def shown(df):
    return df.drop("confidence_state").withColumn("confidence_score", F.col("confidence_score").cast("double"))


@check(
    "x01_assign_section",
    O.sql([*X.PARSE, X.KV, X.BLOCKS], "SELECT doc_id, line_no, pair_no, heading FROM v_kv"),
)
def _(spark, sf):
    spans = canonical.key_values(lines(spark, sf)).select("doc_id", "line_no", "pair_no", "start")
    return canonical.assign_section(spans, canonical.blocks(lines(spark, sf))).select("doc_id", "line_no", "pair_no", "heading")


@check("x02_fields_from_kv", O.sql([*BASE, KVF], f"SELECT {SHOWN} FROM v_kvf"))
def _(spark, sf):
    return shown(structure.fields_from_kv(keyed(spark, sf)))


@check("x03_column_types", O.sql([*X.PARSE, X.TABLES, COLS], "SELECT doc_id, table_no, column_no, header, type, complete FROM v_ct"))
def _(spark, sf):
    return structure.infer_column_types(cells(spark, sf))


@check("x04_fields_from_tables", O.sql([*BASE, COLS, TABF], f"SELECT {SHOWN} FROM v_tabf"))
def _(spark, sf):
    return shown(structure.fields_from_tables(cells(spark, sf), keyed(spark, sf)))


@check("x05_fields_from_prose", O.sql([*BASE, NARF], f"SELECT {SHOWN} FROM v_prosef"))
def _(spark, sf):
    return shown(structure.fields_from_prose(keyed(spark, sf)))


@check("x06_fields_from_lists", O.sql([*BASE, NARF], f"SELECT {SHOWN} FROM v_listf"))
def _(spark, sf):
    return shown(structure.fields_from_lists(keyed(spark, sf)))


@check("x07_narrative_gate", O.sql([*X.PARSE, X.KV, X.BLOCKS, NARRATIVE], "SELECT doc_id FROM v_gate"))
def _(spark, sf):
    return structure.narrative_gate(lines(spark, sf))


def structured(spark, sf):
    k = keyed(spark, sf)
    return V.union_all(
        [structure.fields_from_kv(k), structure.fields_from_tables(cells(spark, sf), k), structure.fields_from_prose(k), structure.fields_from_lists(k)]
    )


def fallback(spark, sf):
    t = V.texts(spark, sf)
    # Short turns are the documents without any structure.
    return structure.fallback_fields(t, lines(spark, sf), keyed(spark, sf))


def every_field(spark, sf):
    return structured(spark, sf).unionByName(fallback(spark, sf))


@check("x08_fallback_fields", O.sql(FULL, f"SELECT {SHOWN} FROM v_fallf"))
def _(spark, sf):
    return shown(fallback(spark, sf))


_OK = "(presence_state = 'present' AND confidence_score >= 0.75 AND grounded)"
QUALITY = f"""
v_q AS (SELECT doc_id, count(*) FILTER ({_OK}) AS usable_leaves, count(*) AS total_leaves, count(*) FILTER ({_OK}) / count(*) AS usable_ratio,
  bool_or({_OK} AND contains(schema_field_key, '[].')) AS has_usable_table,
  CASE WHEN count(*) FILTER (required OR material) = 0 THEN 1.0 ELSE count(*) FILTER ((required OR material) AND {_OK}) / count(*) FILTER (required OR material) END AS material_usable_ratio,
  count(*) FILTER ((required OR material) AND {_OK}) < count(*) FILTER (required OR material) AS any_material_unusable,
  bool_or(required AND presence_state <> 'present') AS missing_required, bool_and(stage = 3) AS fallback_only FROM v_all GROUP BY doc_id)"""
QCOLS = "doc_id, usable_leaves, total_leaves, CAST(round(usable_ratio::DOUBLE, 6) AS DECIMAL(10,6))::VARCHAR AS usable_ratio, has_usable_table, CAST(round(material_usable_ratio::DOUBLE, 6) AS DECIMAL(10,6))::VARCHAR AS material_usable_ratio, any_material_unusable, missing_required"


def ratios(df):
    return df.withColumns(
        {c: F.round(F.col(c).cast("double"), 6).cast("decimal(10,6)").cast("string") for c in ("usable_ratio", "material_usable_ratio")}
    )


@V.view
def quality(spark, sf):
    return structure.field_quality(every_field(spark, sf), F.col("stage") == structure.FALLBACK_STAGE)


@check("x09_field_quality", O.sql([*FULL, QUALITY], f"SELECT {QCOLS} FROM v_q"))
def _(spark, sf):
    return ratios(quality(spark, sf)).drop("fallback_only")


@check(
    "x10_run_status",
    O.sql([*FULL, QUALITY], """SELECT doc_id, CASE WHEN fallback_only THEN 'degraded' WHEN usable_ratio < 0.5 THEN 'partial' ELSE 'succeeded' END AS status,
      CASE WHEN fallback_only THEN 'This document has little detectable structure. The raw text is captured for review.' WHEN usable_ratio < 0.5
        THEN 'Some values were extracted with low confidence — please verify.' END AS status_note FROM v_q"""),
)
def _(spark, sf):
    return structure.run_status(quality(spark, sf)).select("doc_id", "status", "status_note")


SCHEMA = f"""
v_nodes AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, major, minor)::INT AS position, row_number() OVER (PARTITION BY doc_id, stage ORDER BY major, minor) AS rn2 FROM (
  SELECT doc_id, stage, major, minor, key AS schema_key, CASE WHEN stage = 0 THEN {human("raw_label")} ELSE raw_label END AS label, type, CASE WHEN type = 'array' THEN 'array' ELSE 'scalar' END AS node_kind,
    stage = 0 AND {_words("key || ' ' || raw_label")} AND type <> 'text' AS required, stage = 0 AND ({_words("key || ' ' || raw_label")} OR type IN ('decimal','integer','currency','date')) AS material
  FROM (SELECT *, CASE WHEN stage = 1 OR (stage = 2 AND minor = 1) THEN 'array' WHEN stage = 0 THEN {infer("value")} ELSE {_PT} END AS type FROM v_keyed)
  UNION ALL SELECT doc_id, stage, major, minor, schema_field_key, label, type, 'scalar', false, false FROM v_fallf)),
v_schema AS (SELECT doc_id, position, schema_key, label, type, node_kind, required, material, CASE WHEN stage = 3 THEN schema_key = 'title' ELSE node_kind = 'scalar' AND rn2 <= 4 END AS is_summary FROM v_nodes
  UNION ALL SELECT k.doc_id, NULL, a.key || '[].' || column_key, {human("k.header")}, type, 'scalar', {_words("column_key || ' ' || k.header")} AND type <> 'text' AND complete,
    {_words("column_key || ' ' || k.header")} OR type IN ('decimal','integer','currency','date'), false FROM v_colk k JOIN v_keyed a ON a.doc_id = k.doc_id AND a.stage = 1 AND a.major = k.table_no
  UNION ALL SELECT doc_id, NULL, key || '[].text', 'Text', 'text', 'scalar', false, false, false FROM v_keyed WHERE stage = 2 AND minor = 1),
v_adhoc AS (SELECT doc_id, 'adhoc_' || lower(to_base(list_reduce(string_split(string_agg(schema_key || ':' || type, '|' ORDER BY position), ''), lambda h, c: ((h::BIGINT * 31 + ascii(c)) & 4294967295)::VARCHAR, '0')::BIGINT, 36)) AS adhoc_key
  FROM v_schema WHERE position IS NOT NULL GROUP BY doc_id)"""


@V.view
def schema(spark, sf):
    return structure.infer_schema(keyed(spark, sf), structure.table_columns(cells(spark, sf)), fallback(spark, sf))


@check("x11_infer_schema", O.sql([*FULL, SCHEMA], "SELECT s.*, a.adhoc_key FROM v_schema s JOIN v_adhoc a ON a.doc_id = s.doc_id"))
def _(spark, sf):
    s = schema(spark, sf)
    return s.join(structure.schema_keys(s).withColumnRenamed("schema_key", "adhoc_key"), "doc_id")


LEAVES = f"""
v_assigned AS (SELECT doc_id, abs(doc_id) % 2 AS schema_version_id FROM v_docs_text),
v_leafs AS (SELECT v AS schema_version_id, s AS leaf_key, s AS key, label, 'details' AS field_group, type, length(s) % 3 = 0 AS required, length(s) % 2 = 0 AS material FROM (
   SELECT {camel("key")} AS s, min(key) AS label, min({infer("value")}) AS type FROM v_kv GROUP BY 1 UNION ALL SELECT DISTINCT event_type, 'The ' || event_type, 'string' FROM events), (SELECT unnest([0, 1]) AS v)
   WHERE v = 1 OR length(s) % 2 = 0),
v_alt AS MATERIALIZED (SELECT DISTINCT schema_version_id, leaf_key, unnest([{camel("key")}, {camel("label")}]) AS slug FROM v_leafs),
v_first AS MATERIALIZED (SELECT doc_id, slug, arg_min({{'line_no': line_no, 'pair_no': pair_no, 'value': value, 'start': start, 'end': "end"}}, (line_no, pair_no)) AS hit FROM (SELECT *, {camel("key")} AS slug FROM v_kv) GROUP BY ALL),
v_with AS (SELECT a.doc_id, l.leaf_key AS path, l.leaf_key AS schema_field_key, l.label, l.field_group, l.type, l.required, l.material, CASE WHEN h IS NULL THEN 'not_found' ELSE 'present' END AS presence_state,
   CASE WHEN h IS NOT NULL THEN {norm("l.type", "h.value")} END AS value, CASE WHEN h IS NULL THEN 0.2 WHEN l.type = 'text' THEN 0.7 ELSE 0.85 END AS confidence_score, h.start AS start, h."end" AS "end", h IS NOT NULL AS grounded
   FROM v_assigned a JOIN v_leafs l ON l.schema_version_id = a.schema_version_id LEFT JOIN (
     SELECT a.doc_id, l.leaf_key, arg_min(f.hit, (f.hit.line_no, f.hit.pair_no)) AS h FROM v_assigned a JOIN v_alt l ON l.schema_version_id = a.schema_version_id
       JOIN v_first f ON f.doc_id = a.doc_id AND f.slug = l.slug GROUP BY ALL) m ON m.doc_id = a.doc_id AND m.leaf_key = l.leaf_key)"""
WSHOWN = 'doc_id, path, schema_field_key, label, field_group, type, required, material, presence_state, value, confidence_score::DOUBLE AS confidence_score, start, "end", grounded'


@V.view
def assigned(spark, sf):
    return V.texts(spark, sf).select("doc_id", (F.abs("doc_id") % 2).alias("schema_version_id"))


@V.view
def leaves(spark, sf):
    kv = canonical.key_values(lines(spark, sf))
    learned = kv.groupBy(T.slug_camel(F.col("key")).alias("key")).agg(
        F.min("key").alias("label"), F.min(typing.infer_type(F.col("value"))).alias("type")
    )
    e = F.col("event_type")
    known = V.table(spark, sf, "events").select(e.alias("key"), F.concat(F.lit("The "), e).alias("label"), F.lit("string").alias("type")).distinct()
    n = F.length("key")
    return (
        learned.unionByName(known)
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("schema_version_id"))
        .filter((F.col("schema_version_id") == 1) | (n % 2 == 0))
        .select("schema_version_id", F.col("key").alias("leaf_key"), "key", "label", F.lit("details").alias("field_group"), "type",
                (n % 3 == 0).alias("required"), (n % 2 == 0).alias("material"))
    )


@check("x12_extract_with_schema", O.sql([*X.PARSE, X.KV, LEAVES], f"SELECT {WSHOWN} FROM v_with"))
def _(spark, sf):
    return shown(structure.extract_with_schema(lines(spark, sf), assigned(spark, sf), leaves(spark, sf)))


COLUMN_LEAVES = f"""
v_hs AS (SELECT s, min(header) AS header FROM (SELECT {camel("header")} AS s, header FROM v_cells WHERE header <> '' UNION ALL SELECT event_type, event_type FROM events) GROUP BY s),
v_cleaf AS (SELECT v AS schema_version_id, 'goods' AS array_key, 'goods[].' || s AS leaf_key, s AS key, header AS label, 'goods' AS field_group, 'decimal' AS type, false AS required, true AS material
   FROM v_hs, (SELECT unnest([0, 1]) AS v) WHERE v = 1 OR s IN ('item', 'qty', 'code'))"""
TABLE_SCORE = f"""
v_heads AS (SELECT doc_id, table_no, {camel("hh")} AS slug FROM (SELECT doc_id, table_no, unnest(h) AS hh FROM v_rows WHERE table_row = 0)),
v_score AS (SELECT a.doc_id, r.table_no, count(*) AS score FROM v_assigned a JOIN v_heads r ON r.doc_id = a.doc_id
   WHERE EXISTS (SELECT 1 FROM v_cleaf l WHERE l.schema_version_id = a.schema_version_id AND r.slug IN ({camel("l.key")}, {camel("l.label")})) GROUP BY ALL),
v_best AS (SELECT doc_id, arg_max(table_no, (score, -table_no)) AS table_no, max(score) AS score FROM v_score GROUP BY doc_id)"""
ARRAYS = [*X.PARSE, X.KV, X.TABLES, LEAVES, COLUMN_LEAVES, TABLE_SCORE]


@V.view
def column_leaves(spark, sf):
    heads = cells(spark, sf).filter("header <> ''").select(T.slug_camel(F.col("header")).alias("key"), F.col("header").alias("label"))
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_type").alias("label"))
    return (
        heads.unionByName(e).groupBy("key").agg(F.min("label").alias("label"))
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("schema_version_id"))
        .filter((F.col("schema_version_id") == 1) | F.col("key").isin("item", "qty", "code"))
        .select("schema_version_id", F.lit("goods").alias("array_key"), F.concat(F.lit("goods[]."), "key").alias("leaf_key"), "key", "label",
                F.lit("goods").alias("field_group"), F.lit("decimal").alias("type"), F.lit(False).alias("required"), F.lit(True).alias("material"))
    )


@check("x13_match_table", O.sql(ARRAYS, "SELECT doc_id, 'goods' AS array_key, table_no, score FROM v_best"))
def _(spark, sf):
    return structure.match_tables(lines(spark, sf), assigned(spark, sf), column_leaves(spark, sf))


@check(
    "x13b_extract_arrays",
    O.sql(ARRAYS, f"""SELECT r.doc_id, 'goods[' || r.row_no || '].' || l.key AS path, CASE WHEN c.value <> '' THEN 'present' ELSE 'not_found' END AS presence_state,
      CASE WHEN c.value <> '' THEN {norm("'decimal'", "c.value")} END AS value, CASE WHEN c.value <> '' THEN c.start END AS start
      FROM (SELECT DISTINCT c.doc_id, c.table_no, c.row_no FROM v_cells c JOIN v_best b ON b.doc_id = c.doc_id AND b.table_no = c.table_no) r
      JOIN v_assigned a ON a.doc_id = r.doc_id JOIN v_cleaf l ON l.schema_version_id = a.schema_version_id
      LEFT JOIN (SELECT doc_id, table_no, row_no, {camel("header")} AS slug, arg_max(value, column_no) AS value, arg_max(start, column_no) AS start FROM v_cells WHERE header <> '' GROUP BY ALL) c
        ON c.doc_id = r.doc_id AND c.table_no = r.table_no AND c.row_no = r.row_no AND c.slug = l.key"""),
)
def _(spark, sf):
    return structure.extract_arrays(lines(spark, sf), assigned(spark, sf), column_leaves(spark, sf)).select("doc_id", "path", "presence_state", "value", "start")


@check(
    "x14_fill_missing",
    O.sql([*BASE, KVF, LEAVES], """SELECT doc_id, path, presence_state, value FROM v_kvf UNION ALL
      SELECT a.doc_id, l.leaf_key, 'not_found', NULL FROM v_assigned a JOIN v_leafs l ON l.schema_version_id = a.schema_version_id
      WHERE NOT EXISTS (SELECT 1 FROM v_kvf f WHERE f.doc_id = a.doc_id AND f.schema_field_key = l.leaf_key)"""),
)
def _(spark, sf):
    filled = structure.fill_missing(structure.fields_from_kv(keyed(spark, sf)), assigned(spark, sf), leaves(spark, sf))
    return filled.select("doc_id", "path", "presence_state", "value")


PROPOSALS = f"""
v_prop0 AS (SELECT doc_id, (line_no * 10 + pair_no)::INT AS position, CASE WHEN line_no % 2 = 0 THEN {camel("key")} ELSE 'view' END AS key, CASE WHEN line_no % 3 = 0 THEN '' ELSE key END AS label,
   CASE WHEN line_no % 5 = 0 THEN '' WHEN line_no % 5 = 1 THEN 'rows[0].x' ELSE {camel("key")} END AS path, 'string' AS type, CASE WHEN line_no % 4 <> 3 THEN value END AS value, 'present' AS presence,
   CASE WHEN line_no % 3 <> 0 THEN (50 + line_no * 9) / 100.0 END AS confidence, CASE WHEN pair_no = 1 THEN 'never ' || value ELSE value END AS quote FROM v_kv),
v_prop AS (SELECT *, CASE WHEN g THEN base ELSE least(base, 0.5) END AS confidence_score FROM (SELECT *, strpos(text, quote) > 0 AS g, strpos(text, quote) - 1 AS found_at, greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS base
   FROM (SELECT p.*, d.text FROM v_prop0 p JOIN v_docs_text d ON d.doc_id = p.doc_id)))"""
_BAND = "CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.6 THEN 'medium' ELSE 'low' END"


@V.view
def proposals(spark, sf):
    kv = canonical.key_values(lines(spark, sf))
    no, pair = F.col("line_no"), F.col("pair_no")
    slug = T.slug_camel(F.col("key"))
    rows = kv.select(
        "doc_id", (no * 10 + pair).alias("position"), F.when(no % 2 == 0, slug).otherwise("view").alias("key"),
        F.when(no % 3 == 0, "").otherwise(F.col("key")).alias("label"), F.when(no % 5 == 0, "").when(no % 5 == 1, "rows[0].x").otherwise(slug).alias("path"),
        F.lit("string").alias("type"), F.when(no % 4 != 3, F.col("value")).alias("value"), F.lit("present").alias("presence"),
        F.when(no % 3 != 0, (no * 9 + 50) / 100.0).alias("confidence"),
        F.when(pair == 1, F.concat(F.lit("never "), "value")).otherwise(F.col("value")).alias("quote"),
    )
    return structure.ground_proposals(rows, V.texts(spark, sf), q_canonical.text_pages(V.texts(spark, sf)))


@check(
    "x16_ground_proposals",
    O.sql([*X.PARSE, X.KV, PROPOSALS], f"""SELECT doc_id, position, CASE WHEN path = '' THEN key ELSE path END AS path, CASE WHEN label = '' THEN {human("key")} ELSE label END AS label,
      CASE WHEN contains(path, '[') THEN 'records' ELSE 'details' END AS field_group, CASE WHEN value IS NULL THEN 'not_found' ELSE presence END AS presence_state, value,
      CAST(confidence_score AS DECIMAL(6,4))::VARCHAR AS confidence_score, {_BAND} AS confidence_state, CASE WHEN g THEN 'grounded' ELSE 'unresolved' END AS grounding_status, (CASE WHEN g THEN found_at ELSE 0 END)::INT AS start,
      CASE WHEN g THEN found_at // 700 + 1 END::INT AS page FROM v_prop"""),
)
def _(spark, sf):
    return proposals(spark, sf).select(
        "doc_id", "position", "path", "label", "field_group", "presence_state", "value",
        F.col("confidence_score").cast("decimal(6,4)").cast("string").alias("confidence_score"), "confidence_state", "grounding_status", "start", "page",
    )


OVERLAY = f"""
v_weak AS MATERIALIZED (SELECT *, NOT (presence_state = 'present' AND confidence_score >= 0.75) AS weak FROM v_with),
v_wn AS MATERIALIZED (SELECT doc_id, path, min(r) AS r, slug FROM (SELECT doc_id, path, unnest([0, 1, 2]) AS r, unnest([{camel("schema_field_key")}, {camel("path")}, {camel("label")}]) AS slug FROM v_weak WHERE weak) GROUP BY ALL),
v_cn AS MATERIALIZED (SELECT doc_id, slug, arg_min({{'value': value, 'ps': ps, 'confidence_score': confidence_score}}, position) AS c FROM (
  SELECT doc_id, position, value, CASE WHEN value IS NULL THEN 'not_found' ELSE 'present' END AS ps, confidence_score, {camel("n")} AS slug FROM (
    SELECT *, unnest([key, CASE WHEN path = '' THEN key ELSE path END, CASE WHEN label = '' THEN {human("key")} ELSE label END]) AS n FROM v_prop)) GROUP BY ALL),
v_take AS (SELECT * FROM (SELECT w.doc_id, w.path, arg_min(x.c, w.r) AS c FROM v_wn w JOIN v_cn x ON x.doc_id = w.doc_id AND x.slug = w.slug GROUP BY ALL) WHERE c.value IS NOT NULL)"""


@check(
    "x15_overlay_candidates",
    O.sql([*X.PARSE, X.KV, LEAVES, PROPOSALS, OVERLAY], """
      SELECT w.doc_id, w.path, CASE WHEN m.c IS NOT NULL THEN m.c.value ELSE w.value END AS value, CASE WHEN m.c IS NOT NULL THEN m.c.ps ELSE w.presence_state END AS presence_state,
        CAST(CASE WHEN m.c IS NOT NULL THEN m.c.confidence_score ELSE w.confidence_score END AS DECIMAL(6,4))::VARCHAR AS confidence_score
      FROM v_weak w LEFT JOIN v_take m ON m.doc_id = w.doc_id AND m.path = w.path AND w.weak"""),
)
def _(spark, sf):
    base = structure.extract_with_schema(lines(spark, sf), assigned(spark, sf), leaves(spark, sf))
    cands = proposals(spark, sf).select(
        "doc_id", "position", F.col("key").alias("schema_field_key"), "path", "label", "value", "presence_state", "confidence_score",
        "confidence_state", "start", "end", (F.col("grounding_status") == "grounded").alias("grounded"),
    )
    return structure.overlay_candidates(base, cands).select(
        "doc_id", "path", "value", "presence_state", F.col("confidence_score").cast("decimal(6,4)").cast("string").alias("confidence_score")
    )


@check(
    "x17_route_low_coverage",
    O.sql([*FULL, QUALITY], """SELECT doc_id, reason NOT IN ('structural_sufficient','empty') AS open, reason FROM (SELECT q.doc_id,
      CASE WHEN length(d.text) < 8 THEN 'empty' WHEN usable_leaves < 3 AND NOT has_usable_table THEN 'adhoc_sparse'
      WHEN usable_ratio < 0.5 THEN 'adhoc_low_coverage' ELSE 'structural_sufficient' END AS reason FROM v_q q JOIN v_docs_text d ON d.doc_id = q.doc_id)"""),
)
def _(spark, sf):
    parses = V.texts(spark, sf).select(
        "doc_id", "text", F.floor(F.length("text") / 300).alias("page_count"), F.lit(1).alias("schema_fields")
    )
    return structure.route_low_coverage(parses, quality(spark, sf))


_PH = f"(?:\\+[0-9]{{1,3}}[{O.WS_CLASS}.-]?)?(?:\\(?[0-9]{{2,4}}\\)?[{O.WS_CLASS}.-]?)?[0-9]{{3,5}}[{O.WS_CLASS}.-]?[0-9]{{3,5}}"
_CONTACTS = {
    "email": "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}", "phone": _PH,
    "linkedin": f"(?i)(?:https?://)?(?:www\\.)?linkedin\\.com/[^{O.WS_CLASS}|,;]+", "github": f"(?i)(?:https?://)?(?:www\\.)?github\\.com/[^{O.WS_CLASS}|,;]+",
}


@check(
    "x18_contacts",
    O.sql([X.TEXTS], 'SELECT doc_id, key, value, (strpos(text, value) - 1)::INT AS start, (strpos(text, value) - 1 + length(value))::INT AS "end" FROM (' + " UNION ALL ".join(
        f"SELECT doc_id, text, '{n}' AS key, regexp_extract(text, '{p}') AS value FROM v_docs_text" for n, p in _CONTACTS.items()) + ") WHERE value <> ''"),
)
def _(spark, sf):
    return structure.extract_contacts(V.texts(spark, sf))
