"""Schemas of the stored tables.

Document schemas (which fields an invoice has, say) are rows of data, never Spark schemas: one
DataFrame mixes thousands of them.  Values are kept as text beside typed index columns.
"""

from pyspark.sql import types as T

ISSUE = T.StructType(
    [T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())]
)
CANDIDATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("original_filename", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("processing_status", T.StringType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("failure_code", T.StringType()),
        T.StructField("current_extraction_id", T.LongType()),
        T.StructField("last_approved_extraction_id", T.LongType()),
        T.StructField("approved_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
EXTRACTIONS = T.StructType(
    [
        T.StructField("extraction_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("schema_key", T.StringType()),
        T.StructField("schema_version_id", T.StringType()),
        T.StructField("parent_extraction_id", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)
FIELDS = T.StructType(
    [
        T.StructField("field_id", T.LongType()),
        T.StructField("extraction_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("schema_field_key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("field_group", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("node_kind", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("material", T.BooleanType()),
        T.StructField("presence_state", T.StringType()),
        T.StructField("value_origin", T.StringType()),
        T.StructField("extracted_value", T.StringType()),
        T.StructField("corrected_value", T.StringType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("value_numeric", T.DecimalType(38, 6)),
        T.StructField("value_date", T.StringType()),
        T.StructField("value_boolean", T.BooleanType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("confidence_state", T.StringType()),
        T.StructField("validation_state", T.StringType()),
        T.StructField("validation_issues", T.ArrayType(ISSUE)),
        T.StructField("review_state", T.StringType()),
        T.StructField("needs_attention", T.BooleanType()),
        T.StructField("conflict_candidates", T.ArrayType(CANDIDATE)),
        T.StructField("sort_order", T.IntegerType()),
    ]
)
SOURCES = T.StructType(
    [
        T.StructField("ref_id", T.StringType()),
        T.StructField("field_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("has_box", T.BooleanType()),
        T.StructField("offset_start", T.IntegerType()),
        T.StructField("offset_end", T.IntegerType()),
        T.StructField("grounding_status", T.StringType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("candidate_rank", T.IntegerType()),
    ]
)
# One node per row: the flat form of a schema's field tree.
SCHEMA_NODE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nodeKind", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("material", T.BooleanType()),
    ]
)


def schema_tree(depth: int) -> T.StructType:
    """Spark type of a field tree node with `depth` levels of children below it."""
    fields = list(SCHEMA_NODE.fields)
    if depth > 0:
        below = T.ArrayType(schema_tree(depth - 1))
        fields.append(T.StructField("children", below))
        fields.append(T.StructField("item", T.StructType([T.StructField("children", below)])))
    return T.StructType(fields)


TABLES = {
    "documents": DOCUMENTS,
    "extractions": EXTRACTIONS,
    "fields": FIELDS,
    "sources": SOURCES,
}
