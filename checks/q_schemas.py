"""Checks of schemas as data, review batches and projections."""

from pyspark.sql import functions as F

from docrecords.operators import review, rules, schemas
from docrecords.plans import structuring
from docrecords.plans.stages import stage

from . import oracle_base as O
from . import q_rules, q_structure
from . import views as V
from .q_functions import snake

QUERIES = {}
ORACLE = {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@V.view
def versions(spark, sf):
    """One nested definition per part; some have repeated or blank keys, some are empty."""
    k = F.col("p_partkey")
    s = F.lit

    def scalar(key, label):
        return F.concat(s('{"key":"'), key, s('","label":"'), label, s('","type":"string","nodeKind":"scalar","group":"g","required":true}'))

    parts = F.concat(
        s("["), scalar(F.lower("p_type"), F.col("p_name")), s(","),
        scalar(F.when(k % 5 == 0, F.lower("p_type")).when(k % 7 == 0, " ").otherwise("brand"), F.when(k % 11 == 0, "").otherwise(F.col("p_brand"))),
        s(',{"key":"maker","label":"Maker","type":"object","nodeKind":"object","group":"m","children":['), scalar(s("name"), s("Name")),
        s(',{"key":"deep","label":"Deep","type":"object","nodeKind":"object","group":"m","children":['), scalar(F.concat(s("n"), (k % 9).cast("string")), s("N")), s("]}]}"),
        s(',{"key":"sizes","label":"Sizes","type":"array","nodeKind":"array","group":"z","item":{"children":['), scalar(s("v"), s("Value")),
        s(',{"key":"o","label":"O","type":"object","nodeKind":"object","group":"z","children":['), scalar(s("hidden"), s("H")), s("]}]}}]"),
    )
    return V.table(spark, sf, "part").select(
        k.alias("schema_version_id"), F.concat(s("f"), (k % 40).cast("string")).alias("family_key"),
        F.when(k % 3 == 0, "draft").otherwise(F.concat(s("v"), F.floor(k / 40).cast("string"))).alias("version"),
        F.when(k % 3 == 0, "draft").otherwise("published").alias("status"),
        F.when(k % 13 == 0, "[]").otherwise(parts).alias("definition"), (k % 4).cast("int").alias("revision"),
    )


VERSIONS = """
v_ver AS (SELECT p_partkey AS schema_version_id, 'f' || (p_partkey % 40) AS family_key, CASE WHEN p_partkey % 3 = 0 THEN 'draft' ELSE 'v' || (p_partkey // 40) END AS version,
  CASE WHEN p_partkey % 3 = 0 THEN 'draft' ELSE 'published' END AS status, p_partkey % 13 = 0 AS is_empty, p_partkey % 4 AS revision, lower(p_type) AS t, p_name, p_partkey AS k,
  CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'brand' END AS b, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS bl FROM part)"""


@check(
    "m01_schema_leaves",
    O.sql([VERSIONS], """SELECT schema_version_id, unnest([t, b, 'maker.name', 'maker.deep.n' || (k % 9), 'sizes[].v']) AS leaf_key,
      unnest([p_name, bl, 'Name', 'N', 'Value']) AS label FROM v_ver WHERE NOT is_empty"""),
)
def _(spark, sf):
    return schemas.schema_leaves(versions(spark, sf)).select("schema_version_id", "leaf_key", "label")


@check(
    "m02_schema_errors",
    O.sql([VERSIONS], """SELECT schema_version_id, 'fields.1.key' AS path, 'Field key "' || b || '" is duplicated at this level.' AS message FROM v_ver WHERE NOT is_empty AND b = t
      UNION ALL SELECT schema_version_id, 'fields.1.key', 'Field key cannot be empty.' FROM v_ver WHERE NOT is_empty AND b = ' '
      UNION ALL SELECT schema_version_id, 'fields.1.label', 'Field label cannot be empty.' FROM v_ver WHERE NOT is_empty AND bl = ''
      UNION ALL SELECT schema_version_id, 'fields', 'Add at least one field before publishing.' FROM v_ver WHERE is_empty"""),
)
def _(spark, sf):
    return schemas.schema_errors(versions(spark, sf), publishing=True)


NEXT = """
v_next AS (SELECT family_key, 'v' || (coalesce(max(try_cast(regexp_extract(version, '^v([0-9]+)\\z', 1) AS INT)), 0) + 1) AS next_version FROM v_ver GROUP BY family_key)"""


@check("m03_next_version", O.sql([VERSIONS, NEXT], "SELECT * FROM v_next"))
def _(spark, sf):
    return schemas.next_versions(versions(spark, sf))


@check(
    "m04_apply_changes",
    O.sql([VERSIONS, NEXT], """, v_one AS (SELECT * FROM v_ver WHERE status = 'published' OR schema_version_id IN (SELECT min(schema_version_id) FROM v_ver WHERE status = 'draft' GROUP BY family_key)),
      v_chg AS (SELECT 'f' || n_nationkey AS family_key, CASE WHEN n_nationkey % 2 = 0 THEN 'publish' ELSE 'draft' END AS action FROM nation
        UNION ALL SELECT 'new' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'publish' ELSE 'draft' END FROM region)
      SELECT family_key, version, status, revision::INT AS revision, is_empty AND true AS cleared FROM v_one WHERE status = 'published'
      UNION ALL SELECT coalesce(d.family_key, c.family_key), CASE WHEN action = 'publish' THEN next_version ELSE 'draft' END, CASE WHEN action = 'publish' THEN 'published' ELSE 'draft' END,
        (CASE WHEN d.family_key IS NOT NULL AND action = 'draft' THEN revision + 1 ELSE coalesce(revision, 1) END)::INT, CASE WHEN action = 'draft' THEN true ELSE is_empty END
      FROM (SELECT * FROM v_one WHERE status = 'draft') d FULL JOIN v_chg c ON c.family_key = d.family_key LEFT JOIN v_next n ON n.family_key = d.family_key
      WHERE d.family_key IS NOT NULL OR action = 'draft'""".replace(", v_one AS", "SELECT * FROM (WITH v_one AS", 1) + ")"),
)
def _(spark, sf):
    v = versions(spark, sf)
    first = v.filter("status = 'draft'").groupBy("family_key").agg(F.min("schema_version_id").alias("schema_version_id"))
    one = v.filter("status = 'published'").unionByName(v.join(first.select("schema_version_id"), "schema_version_id", "left_semi"))
    even = F.when(F.col("k") % 2 == 0, "publish").otherwise("draft").alias("action")
    n = V.table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("family_key"), F.col("n_nationkey").alias("k"))
    r = V.table(spark, sf, "region").select(F.concat(F.lit("new"), F.col("r_regionkey").cast("string")).alias("family_key"), F.col("r_regionkey").alias("k"))
    changes = n.unionByName(r).select("family_key", even, F.lit("[]").alias("definition"))
    return schemas.apply_schema_changes(one, changes).select(
        "family_key", "version", "status", "revision", (F.col("definition") == "[]").alias("cleared")
    )


USAGE = """
v_sv AS (SELECT DISTINCT schema_version_id, 'fam' || (right(schema_version_id, 1)::INT % 3) AS family_key, '2020-01-0' || (right(schema_version_id, 1)::INT % 4 + 1) AS created_at FROM v_extractions),
v_use AS (SELECT s.*, coalesce(u.n, 0) AS document_count, u.last_used_at FROM v_sv s LEFT JOIN (SELECT schema_version_id, count(*) AS n, max(updated_at) AS last_used_at FROM v_extractions e
  JOIN v_docs d ON d.current_extraction_id = e.extraction_id GROUP BY 1) u ON u.schema_version_id = s.schema_version_id)"""


def usage(spark, sf):
    n = F.substring("schema_version_id", 3, 1).cast("int")
    sv = V.extractions(spark, sf).select("schema_version_id").distinct().select(
        "schema_version_id", F.concat(F.lit("fam"), (n % 3).cast("string")).alias("family_key"),
        F.concat(F.lit("2020-01-0"), (n % 4 + 1).cast("string")).alias("created_at"), F.lit("v1").alias("version"), F.lit("draft").alias("status"),
    )
    return schemas.schema_usage(sv, V.extractions(spark, sf), V.docs(spark, sf))


@check("m05_schema_usage", O.sql([O.DOCS, O.EXTRACTIONS, USAGE], "SELECT schema_version_id, document_count, last_used_at FROM v_use"))
def _(spark, sf):
    return usage(spark, sf).select("schema_version_id", "document_count", "last_used_at")


@check(
    "m06_list_schemas",
    O.sql([O.DOCS, O.EXTRACTIONS, USAGE], """SELECT f.family_key, f.built_in, coalesce(sum(document_count), 0)::BIGINT AS document_count, max(last_used_at) AS last_used_at,
      string_agg(schema_version_id, ',' ORDER BY created_at DESC, schema_version_id DESC) AS versions FROM (SELECT 'fam' || r_regionkey AS family_key, r_regionkey % 2 = 0 AS built_in FROM region) f
      LEFT JOIN v_use u ON u.family_key = f.family_key GROUP BY ALL"""),
)
def _(spark, sf):
    r = F.col("r_regionkey")
    families = V.table(spark, sf, "region").select(
        F.concat(F.lit("fam"), r.cast("string")).alias("family_key"), F.col("r_name").alias("name"), (r % 2 == 0).alias("built_in")
    )
    names = F.when(F.col("versions").isNotNull(), F.array_join(F.transform("versions", lambda v: v["schema_version_id"]), ","))
    return schemas.list_schemas(families, usage(spark, sf)).select("family_key", "built_in", "document_count", "last_used_at", names.alias("versions"))


PUBLISHED = f"""
v_inf AS (SELECT s.doc_id, schema_key AS leaf_key, label FROM v_schema s WHERE node_kind = 'scalar'),
v_is AS (SELECT DISTINCT doc_id, unnest([{snake("replace(leaf_key, '[].', '.')")}, {snake("label")}]) AS slug FROM v_inf),
v_pub AS (SELECT o_custkey % 30 AS schema_version_id, leaf_key, label FROM v_inf JOIN orders ON o_orderkey = doc_id
  UNION ALL SELECT abs(doc_id) % 30, leaf_key, label FROM v_inf WHERE doc_id < 0),
v_ps AS (SELECT DISTINCT schema_version_id, unnest([{snake("replace(leaf_key, '[].', '.')")}, {snake("label")}]) AS slug FROM v_pub),
v_sc AS (SELECT doc_id, schema_version_id, overlap, least(1.0, overlap / ps * 0.65 + overlap / isz * 0.35 + CASE WHEN abs(doc_id) % 3 = schema_version_id % 3 THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM (
  SELECT i.doc_id, p.schema_version_id, count(*) AS overlap, any_value(isz) AS isz, any_value(ps) AS ps FROM v_is i JOIN v_ps p ON p.slug = i.slug
    JOIN (SELECT doc_id, count(*) AS isz FROM v_is GROUP BY 1) a ON a.doc_id = i.doc_id JOIN (SELECT schema_version_id, count(*) AS ps FROM v_ps GROUP BY 1) b ON b.schema_version_id = p.schema_version_id
    GROUP BY 1, 2))"""
MATCH = [*q_structure.FULL, q_structure.SCHEMA, PUBLISHED]


@V.view
def match_inputs(spark, sf):
    """Inferred leaves, published leaves, and the names of both: every text publishes to one of 30 versions."""
    inferred = stage(
        q_structure.schema(spark, sf).filter("node_kind = 'scalar'").select("doc_id", F.col("schema_key").alias("leaf_key"), "label"), "inferred"
    )
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 30).alias("schema_version_id"))
    d = V.texts(spark, sf).filter("doc_id < 0").select("doc_id", (F.abs("doc_id") % 30).alias("schema_version_id"))
    published = inferred.join(o.unionByName(d), "doc_id").select("schema_version_id", "leaf_key", "label").distinct()
    third = (F.abs("doc_id") % 3).cast("string")
    names = inferred.select("doc_id").distinct().select("doc_id", F.concat(F.lit("n"), third).alias("schema_name"))
    vnames = published.select("schema_version_id").distinct().select(
        "schema_version_id", F.concat(F.lit("N"), (F.col("schema_version_id") % 3).cast("string")).alias("schema_name")
    )
    return inferred, published, names, vnames


@check("m07_schema_match", O.sql(MATCH, "SELECT doc_id, schema_version_id, overlap, score FROM v_sc"))
def _(spark, sf):
    return schemas.schema_match(*match_inputs(spark, sf))


@check(
    "m08_best_match",
    O.sql(MATCH, """SELECT doc_id, schema_version_id, overlap, score FROM v_sc WHERE overlap >= 2 AND score >= 0.1
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, schema_version_id) = 1"""),
)
def _(spark, sf):
    # A version of many documents has many keys, of which one document holds few.
    return schemas.best_schemas(*match_inputs(spark, sf), min_score=0.1)


@check(
    "m09_synthesize_schema",
    O.sql([O.ALL_FIELDS], "SELECT extraction_id, schema_field_key AS key, label, type, field_group, required, material FROM v_all WHERE NOT contains(schema_field_key, '[].')"),
)
def _(spark, sf):
    return schemas.synthesize_schema(V.all_fields(spark, sf)).select("extraction_id", "key", "label", "type", "field_group", "required", "material")


# --- review --------------------------------------------------------------------------------

ACTIONS = ("confirm", "correct", "not_applicable", "resolve_conflict", "add_item")
CHANGES = f"""
v_chg AS (SELECT field_id, ({list(ACTIONS)})[field_id % 5 + 1] AS action, CASE WHEN field_id % 10 = 1 THEN '42.00' END AS value, CASE WHEN field_id % 3 = 0 THEN 'b' ELSE 'x' END AS candidate_id
  FROM v_raw WHERE field_id % 4 = 1),
v_ap AS (SELECT r.*, c.action, c.value AS cv, c.candidate_id, CASE WHEN review_state <> 'not_applicable' THEN coalesce(corrected_value, extracted_value) END AS before,
  CASE WHEN action = 'correct' AND c.value IS NULL THEN 'A value is required to correct ' || label || '.'
    WHEN action = 'not_applicable' AND required THEN label || ' is required and cannot be marked not applicable.'
    WHEN action = 'resolve_conflict' AND NOT (confidence_state = 'conflicting' AND c.candidate_id = 'b') THEN 'Candidate ' || c.candidate_id || ' is not valid for ' || label || '.'
    WHEN action = 'add_item' THEN 'Unsupported action for ' || label || '.' END AS rej FROM v_raw r LEFT JOIN v_chg c ON c.field_id = r.field_id),
v_new AS (SELECT * REPLACE (CASE WHEN action IS NULL OR rej IS NOT NULL OR action = 'confirm' THEN corrected_value WHEN action = 'correct' THEN cv WHEN action = 'resolve_conflict' THEN '99.00' END AS corrected_value,
  CASE WHEN action IS NULL OR rej IS NOT NULL THEN review_state WHEN action = 'confirm' THEN 'confirmed' WHEN action = 'not_applicable' THEN 'not_applicable' ELSE 'corrected' END AS review_state) FROM v_ap)"""
RAW = [O.EXTRACTIONS, O.RAW_FIELDS]


def changes(spark, sf):
    i = F.col("field_id")
    return V.raw_fields(spark, sf).filter(i % 4 == 1).select(
        "field_id", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (i % 5 + 1).cast("int")).alias("action"),
        F.when(i % 10 == 1, "42.00").alias("value"), F.when(i % 3 == 0, "b").otherwise("x").alias("candidate_id"),
    )


@V.view
def applied(spark, sf):
    return V.stage(review.apply_changes(V.raw_fields(spark, sf), changes(spark, sf))[0], "applied")


@check("r01_apply_changes", O.sql([*RAW, CHANGES], "SELECT field_id, corrected_value, review_state FROM v_new"))
def _(spark, sf):
    return applied(spark, sf).select("field_id", "corrected_value", "review_state")


@check(
    "r02_stale_split",
    O.sql([O.DOCS, O.EXTRACTIONS], """SELECT event_id, CASE WHEN e.extraction_id IS NULL THEN 'unknown document' WHEN event_id % 5 = 0 THEN 'reprocessed' WHEN event_id % 3 + 1 <> version THEN 'changed' END AS conflict
      FROM events LEFT JOIN (SELECT d.doc_id, x.extraction_id, x.version FROM v_docs d JOIN v_extractions x ON x.extraction_id = d.current_extraction_id) e ON e.doc_id = user_id * 7"""),
)
def _(spark, sf):
    i = F.col("event_id")
    batches = V.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") * 7).alias("doc_id"), F.when(i % 5 == 0, F.lit(-1)).cast("bigint").alias("expected_extraction_id"),
        (i % 3 + 1).alias("expected_version"),
    )
    return review.split_stale(batches, V.extractions(spark, sf), V.docs(spark, sf)).select("event_id", "conflict")


@check(
    "r03_correction_log",
    O.sql([*RAW, CHANGES], """SELECT n.extraction_id, path AS field_path, action, before AS from_value, CASE WHEN review_state <> 'not_applicable' THEN coalesce(corrected_value, extracted_value) END AS to_value,
      (version + 1)::INT AS extraction_version FROM v_new n JOIN v_extractions e ON e.extraction_id = n.extraction_id WHERE action IS NOT NULL AND rej IS NULL"""),
)
def _(spark, sf):
    log = review.apply_changes(V.raw_fields(spark, sf), changes(spark, sf))[1]
    return review.correction_log(log, V.extractions(spark, sf))


@check("r03b_rejected_changes", O.sql([*RAW, CHANGES], "SELECT field_id, action, rej AS error FROM v_new WHERE rej IS NOT NULL"))
def _(spark, sf):
    log = review.apply_changes(V.raw_fields(spark, sf), changes(spark, sf))[1]
    return log.filter(F.col("error").isNotNull()).select("field_id", "action", "error")


RULED = [*RAW, CHANGES, O.typed("v_new", "v_t"), O.single("v_t", "v_one"), q_rules.RULES]


@check(
    "r04_recompute",
    O.sql(RULED, """SELECT field_id, value_text, CAST(value_numeric AS VARCHAR) AS value_numeric, value_date, value_boolean, validation_state, needs_attention,
      CASE WHEN review_state = 'not_applicable' THEN 'not_applicable' ELSE presence_state END AS presence_state FROM v_valid"""),
)
def _(spark, sf):
    return review.recompute(applied(spark, sf)).select(
        "field_id", "value_text", F.col("value_numeric").cast("string").alias("value_numeric"), "value_date", "value_boolean", "validation_state", "needs_attention", "presence_state"
    )


PROGRESS = """
v_pr AS (SELECT extraction_id, CASE WHEN bool_or(validation_state = 'invalid' OR (needs_attention AND (required OR material))) THEN 'needs_review' ELSE 'ready' END AS st FROM v_valid GROUP BY 1)"""


@check(
    "r05_reopen_edited",
    O.sql([O.DOCS, *RULED, PROGRESS], """SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN review_status WHEN review_status = 'approved' THEN 'reopened' ELSE coalesce(p.st, review_status) END AS review_status,
      CASE WHEN e.doc_id IS NOT NULL AND review_status = 'approved' THEN NULL ELSE approved_at END AS approved_at FROM v_docs d LEFT JOIN (SELECT DISTINCT doc_id FROM v_new WHERE action IS NOT NULL) e ON e.doc_id = d.doc_id
      LEFT JOIN v_pr p ON p.extraction_id = d.current_extraction_id"""),
)
def _(spark, sf):
    progress = rules.review_progress(review.recompute(applied(spark, sf)))
    edited = V.raw_fields(spark, sf).filter(F.col("field_id") % 4 == 1).select("doc_id")
    return review.reopen_edited(V.docs(spark, sf), edited, progress).select("doc_id", "review_status", "approved_at")


@check(
    "r06_approve",
    O.sql([O.DOCS, *q_rules.BASE, q_rules.BLOCKERS], """SELECT doc_id, CASE WHEN ok THEN 'approved' ELSE review_status END AS review_status, CASE WHEN ok THEN '2024-01-01' ELSE approved_at END AS approved_at,
      CASE WHEN ok THEN current_extraction_id ELSE last_approved_extraction_id END AS last_approved_extraction_id FROM (SELECT *, doc_id % 2 = 0 AND current_extraction_id IS NOT NULL
        AND current_extraction_id NOT IN (SELECT extraction_id FROM v_block) AS ok FROM v_docs)"""),
)
def _(spark, sf):
    d = V.docs(spark, sf)
    done, _fields = review.approve(d, q_rules.valid(spark, sf), d.filter(F.col("doc_id") % 2 == 0), F.lit("2024-01-01"))
    return done.select("doc_id", "review_status", "approved_at", "last_approved_extraction_id")


_EFF = "CASE WHEN review_state <> 'not_applicable' THEN nullif(coalesce(corrected_value, extracted_value), '') END"


@check(
    "r07_invoice_records",
    O.sql(RAW, f"""SELECT extraction_id, max({_EFF}) FILTER (path = 'vendorName') AS vendor_name, max({_EFF}) FILTER (path = 'invoiceNumber') AS invoice_number, max({_EFF}) FILTER (path = 'total') AS total,
      max({_EFF}) FILTER (path = 'dueDate') AS due_date, trim(regexp_replace(lower(max({_EFF}) FILTER (path = 'vendorName')), '[^a-z0-9]+', ' ', 'g')) AS vendor_name_normalized FROM v_raw GROUP BY extraction_id"""),
)
def _(spark, sf):
    return review.invoice_records(V.raw_fields(spark, sf)).select("extraction_id", "vendor_name", "invoice_number", "total", "due_date", "vendor_name_normalized")


@check(
    "r08_line_items",
    O.sql([O.LINE_FIELDS], """SELECT extraction_id, regexp_extract(path, '([0-9]+)', 1)::INT AS position, max(sample) FILTER (schema_field_key = 'lineItems[].quantity') AS quantity,
      max(sample) FILTER (schema_field_key = 'lineItems[].unitPrice') AS unit_price, max(sample) FILTER (schema_field_key = 'lineItems[].lineTotal') AS line_total FROM v_line GROUP BY 1, 2"""),
)
def _(spark, sf):
    return review.line_items(V.line_fields(spark, sf)).drop("description")


DERIVED = f"""
v_j AS (SELECT extraction_id, path, sort_order, coalesce(to_json(CASE WHEN review_state <> 'not_applicable' THEN coalesce(corrected_value, extracted_value) END)::VARCHAR, 'null') AS j, regexp_extract(path, '\\[([0-9]+)\\]', 1) AS idx,
   regexp_extract(path, '\\.([A-Za-z]+)$', 1) AS col FROM v_both),
v_lines_j AS (SELECT extraction_id, idx::INT AS i, '{{' || string_agg('"' || col || '":' || j, ',' ORDER BY sort_order) || '}}' AS o FROM v_j WHERE idx <> '' GROUP BY ALL),
v_tops AS (SELECT extraction_id, sort_order, '"' || path || '":' || j AS e FROM v_j WHERE idx = '' UNION ALL SELECT extraction_id, 100, '"lineItems":[' || string_agg(o, ',' ORDER BY i) || ']' FROM v_lines_j GROUP BY extraction_id)"""
DATA = [O.ALL_FIELDS, DERIVED]


@check("r09_derive_data", O.sql(DATA, "SELECT extraction_id, '{' || string_agg(e, ',' ORDER BY sort_order) || '}' AS data FROM v_tops GROUP BY extraction_id"))
def _(spark, sf):
    return review.derive_data(V.all_fields(spark, sf))


@check(
    "r10_upsert_snapshots",
    O.sql([O.DOCS], """SELECT doc_id, last_approved_extraction_id AS extraction_id FROM v_docs WHERE review_status = 'approved' UNION ALL
      SELECT doc_id, current_extraction_id FROM v_docs WHERE review_status = 'reopened' AND doc_id NOT IN (SELECT doc_id FROM v_docs WHERE review_status = 'approved')"""),
)
def _(spark, sf):
    d = V.docs(spark, sf)
    old = d.filter("review_status IN ('approved', 'reopened')").select("doc_id", F.col("current_extraction_id").alias("extraction_id"))
    new = d.filter("review_status = 'approved'").select("doc_id", F.col("last_approved_extraction_id").alias("extraction_id"))
    return review.upsert_snapshots(old, new)


@check(
    "r11_commit_fields",
    O.sql([*q_structure.FULL, """
      v_n AS (SELECT *, doc_id AS extraction_id, 'purchase' AS schema_key, value AS extracted_value, NULL::VARCHAR AS corrected_value, 'needs_review' AS review_state,
        row_number() OVER (PARTITION BY doc_id ORDER BY stage, major, minor, row_no, column_no) AS sort_order, row_number() OVER () AS field_id,
        CASE WHEN confidence_score >= 0.85 THEN 'high' ELSE 'medium' END AS confidence_state FROM v_all)""", O.typed("v_n", "v_t"), O.single("v_t", "v_one"), q_rules.RULES],
        """SELECT extraction_id, path, value_text, CAST(value_numeric AS VARCHAR) AS value_numeric, value_date, validation_state, CASE WHEN needs_attention THEN 'needs_review' ELSE 'auto_accepted' END AS review_state FROM v_valid"""),
)
def _(spark, sf):
    place = F.struct("stage", "major", "minor", "row_no", "column_no")
    # The rules read some fields apart from the others: stored, fields are made once.
    rows = V.stage(q_structure.every_field(spark, sf), "every-field").withColumns({"extraction_id": F.col("doc_id"), "sort_order": place, "field_id": place})
    done = structuring.committed_fields(rows, "purchase")
    return done.select("extraction_id", "path", "value_text", F.col("value_numeric").cast("string").alias("value_numeric"), "value_date", "validation_state", "review_state")


@check(
    "r11b_duplicate_paths",
    O.sql([O.ALL_FIELDS], "SELECT extraction_id, schema_field_key AS path, count(*) AS n FROM v_all GROUP BY ALL HAVING count(*) > 1"),
)
def _(spark, sf):
    return structuring.duplicate_paths(V.all_fields(spark, sf).withColumn("path", F.col("schema_field_key")))


@check(
    "r12_history",
    "SELECT user_id AS doc_id, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at")
    )
    return review.history(e).select("doc_id", "event_id", "kind", "position")


@check(
    "r13_backfill_typed",
    O.sql([*RAW, O.typed("v_raw", "v_t")], f"""SELECT field_id, vt AS value_text, CAST(coalesce(value_numeric, CASE WHEN type IN ('decimal','integer') AND regexp_matches(vt, '{O.DEC}') THEN vt::DECIMAL(38,6) END) AS VARCHAR) AS value_numeric,
      coalesce(value_date, CASE WHEN type IN ('date','datetime') AND regexp_matches(vt, '{O.ISO}') THEN vt END) AS value_date,
      CASE WHEN type = 'boolean' THEN CASE WHEN lower(vt) IN ('true','yes') THEN true WHEN lower(vt) IN ('false','no') THEN false END END AS value_boolean
      FROM (SELECT * REPLACE (CASE WHEN field_id % 2 = 0 THEN value_numeric END AS value_numeric, CASE WHEN field_id % 2 = 0 THEN value_date END AS value_date),
        coalesce(CASE WHEN field_id % 2 = 0 THEN value_text END, coalesce(corrected_value, extracted_value)) AS vt FROM v_t)"""),
)
def _(spark, sf):
    keep = F.col("field_id") % 2 == 0
    holes = V.fields(spark, sf).withColumns(
        {**{c: F.when(keep, F.col(c)) for c in ("value_text", "value_numeric", "value_date")}, "value_boolean": F.lit(None).cast("boolean")}
    )
    return review.backfill_typed(holes).select(
        "field_id", "value_text", F.col("value_numeric").cast("string").alias("value_numeric"), "value_date", "value_boolean"
    )


@check(
    "r14_record_tables",
    O.sql([O.LINE_FIELDS], f"""SELECT extraction_id, 'lineItems' AS array_key, 'Line Items' AS array_label, regexp_extract(path, '([0-9]+)', 1)::INT AS row_index, substr(schema_field_key, 13) AS column_key, label AS column_label,
      CASE substr(schema_field_key, 13) WHEN 'quantity' THEN 1 WHEN 'unitPrice' THEN 2 ELSE 3 END::INT AS column_order, sample AS value FROM v_line"""),
)
def _(spark, sf):
    return review.record_tables(V.all_fields(spark, sf))


@check(
    "r14b_scalar_sections",
    O.sql(RAW, """SELECT extraction_id, field_group, count(*) AS n_fields, CASE field_group WHEN 'identity' THEN 'Identity' WHEN 'dates' THEN 'Dates and terms' WHEN 'amounts' THEN 'Amounts' ELSE 'Metadata' END AS section_label,
      row_number() OVER (PARTITION BY extraction_id ORDER BY min(sort_order)) AS section_order FROM v_raw GROUP BY extraction_id, field_group"""),
)
def _(spark, sf):
    return review.scalar_sections(V.all_fields(spark, sf))
