"""Record search: scope, selected values, filter algebra, sorting, paging, buckets, summaries.

The field table is by far the largest input.  Every operator reads it once, reduces it to one row
per extraction with a map-side combined aggregate, and only then joins it to the documents.
"""

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.arrays import scan
from ..functions.paths import RECORD_PATH
from ..functions.text import contains_ci, equals_ci, like_ci
from ..plans.stages import stage
from ..session import small_side
from ..sources.files import detect_format

INVOICE_TYPE = "invoice"
SUMMARY_VALUES = 4
FIRST_ROW_CELLS = 2


@dataclass(frozen=True)
class AmountFilter:
    comparator: str
    value: str
    value_to: str | None = None


@dataclass(frozen=True)
class FieldFilter:
    path: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class RecordFilter:
    """Allow-listed filters; everything given is ANDed."""

    search: str | None = None
    schema_key: str | None = None
    vendor: str | None = None
    amount: AmountFilter | None = None
    currency: str | None = None
    invoice_date: tuple[str | None, str | None] = (None, None)
    due_date: tuple[str | None, str | None] = (None, None)
    review_status: tuple[str, ...] = ()
    processing_status: tuple[str, ...] = ()
    document_type: str | None = None
    fields: tuple[FieldFilter, ...] = field(default_factory=tuple)


# --- scope and selected values -------------------------------------------------------------


def selected_extraction(scope: str) -> Column:
    """Which extraction a document is read through: the approved one (if any) or the current."""
    current = F.col("current_extraction_id")
    if scope == "current":
        return current
    return F.coalesce(F.col("last_approved_extraction_id"), current)


def scoped(docs: DataFrame, scope: str = "approved") -> DataFrame:
    return docs.withColumn("selected_extraction_id", selected_extraction(scope))


def _raw_value() -> Column:
    return F.coalesce(F.col("corrected_value"), F.col("extracted_value"))


def _text_value() -> Column:
    return F.coalesce(F.col("value_text"), _raw_value())


def _numeric_value() -> Column:
    raw = _raw_value()
    guarded = F.when(raw.rlike(V.PLAIN_DECIMAL), raw.try_cast("decimal(38,6)"))
    return F.coalesce(F.col("value_numeric"), guarded)


def _date_value() -> Column:
    raw = _raw_value()
    return F.coalesce(F.col("value_date"), F.when(raw.rlike(V.ISO_DATE), raw))


_SELECTED = {
    "vendor_name": ("vendorName", _text_value),
    "invoice_number": ("invoiceNumber", _text_value),
    "invoice_date": ("invoiceDate", _date_value),
    "due_date": ("dueDate", _date_value),
    "currency": ("currency", _text_value),
    "total": ("total", _numeric_value),
}


def _selected_aggs() -> list[Column]:
    return [
        F.max(F.when(F.col("path") == path, value())).alias(name)
        for name, (path, value) in _SELECTED.items()
    ]


def values_by_extraction(fields: DataFrame) -> DataFrame:
    """One row per extraction with the six record values: one scan, one combined aggregate."""
    wanted = [path for path, _ in _SELECTED.values()]
    return (
        fields.filter(F.col("path").isin(*wanted)).groupBy("extraction_id").agg(*_selected_aggs())
    )


def select_values(docs: DataFrame, fields: DataFrame, scope: str = "approved") -> DataFrame:
    """Documents with the text, numeric and date values of their selected extraction."""
    values = values_by_extraction(fields).withColumnRenamed(
        "extraction_id", "selected_extraction_id"
    )
    return scoped(docs, scope).join(values, "selected_extraction_id", "left")


# --- filters -------------------------------------------------------------------------------


def status_predicate(spec: RecordFilter, scope: str) -> Column:
    """A given status list replaces the default trust predicate of the approved scope."""
    if spec.review_status:
        return F.col("review_status").isin(*spec.review_status)
    if scope == "approved":
        return (F.col("review_status") == "approved") | F.col(
            "last_approved_extraction_id"
        ).isNotNull()
    return F.lit(True)


def amount_predicate(amount: AmountFilter, total: Column) -> Column:
    low = F.lit(Decimal(amount.value))
    if amount.comparator == "between":
        if amount.value_to is None:
            return F.lit(True)
        return total.between(low, F.lit(Decimal(amount.value_to)))
    return {"gt": total > low, "gte": total >= low, "lt": total < low, "lte": total <= low}[
        amount.comparator
    ]


def date_predicate(bounds: tuple[str | None, str | None], value: Column) -> Column:
    """Inclusive range over ISO text: dates are compared as text, as they are stored."""
    start, end = bounds
    test = F.lit(True)
    if start:
        test = test & (value >= start)
    if end:
        test = test & (value <= end)
    return test


def field_predicate(spec: FieldFilter) -> Column:
    """Test of one field row against one predicate."""
    key = F.col("schema_field_key") == spec.path
    number = F.col("value_numeric")
    if spec.op == "exists":
        return key & (F.col("presence_state") == "present")
    if spec.op == "contains":
        return key & contains_ci(F.col("value_text"), F.lit(spec.value))
    if spec.op == "eq":
        return key & equals_ci(F.col("value_text"), F.lit(spec.value))
    bound = F.lit(Decimal(spec.value))
    tests = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}
    return key & tests[spec.op]


def _flag(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def matching_extractions(fields: DataFrame, specs: list[FieldFilter]) -> DataFrame:
    """Ids of the extractions for which every predicate holds on some field: one pass for all."""
    tests = [field_predicate(s) for s in specs]
    any_test = tests[0]
    for t in tests[1:]:
        any_test = any_test | t
    flags = [_flag(t).alias(f"p{i}") for i, t in enumerate(tests)]
    hits = fields.filter(any_test).groupBy("extraction_id").agg(*flags)
    for i in range(len(tests)):
        hits = hits.filter(F.col(f"p{i}"))
    return hits.select("extraction_id")


def field_filter(
    docs: DataFrame, fields: DataFrame, specs: list[FieldFilter], scope: str = "approved"
) -> DataFrame:
    hits = matching_extractions(fields, specs).withColumnRenamed(
        "extraction_id", "selected_extraction_id"
    )
    return scoped(docs, scope).join(hits, "selected_extraction_id", "left_semi")


def search_filter(
    docs: DataFrame, fields: DataFrame, needle: str, scope: str = "approved"
) -> DataFrame:
    """Documents whose filename, vendor or any field text contains the needle."""
    text = contains_ci(F.col("value_text"), F.lit(needle))
    vendor = (F.col("path") == "vendorName") & contains_ci(_text_value(), F.lit(needle))
    hits = (
        fields.filter(text | vendor)
        .select(F.col("extraction_id").alias("selected_extraction_id"))
        .distinct()
        .withColumn("field_hit", F.lit(True))
    )
    by_name = contains_ci(F.col("original_filename"), F.lit(needle))
    return (
        scoped(docs, scope)
        .join(hits, "selected_extraction_id", "left")
        .filter(by_name | F.col("field_hit"))
        .drop("field_hit")
    )


def schema_filter(
    docs: DataFrame, extractions: DataFrame, schema_key: str, scope: str = "approved"
) -> DataFrame:
    ids = extractions.filter(F.col("schema_key") == schema_key).select(
        F.col("extraction_id").alias("selected_extraction_id")
    )
    return scoped(docs, scope).join(ids, "selected_extraction_id", "left_semi")


def disallowed_paths(predicates: DataFrame, leaves: DataFrame) -> DataFrame:
    """Predicate rows whose path no schema declares, with the error message."""
    known = small_side(leaves.select(F.col("leaf_key").alias("path")).distinct())
    return predicates.join(known, "path", "left_anti").withColumn(
        "message", F.concat(F.col("path"), F.lit(" is not a queryable schema field."))
    )


# --- match set -----------------------------------------------------------------------------


def match_records(
    docs: DataFrame,
    fields: DataFrame,
    extractions: DataFrame,
    spec: RecordFilter,
    scope: str = "approved",
) -> DataFrame:
    """The full match set with its selected values.

    Value lookups, text search and field predicates share one aggregate over the field table.
    """
    tests = {f"pred_{i}": field_predicate(f) for i, f in enumerate(spec.fields)}
    if spec.search:
        vendor = (F.col("path") == "vendorName") & contains_ci(_text_value(), F.lit(spec.search))
        tests["search_hit"] = contains_ci(F.col("value_text"), F.lit(spec.search)) | vendor
    needed = F.col("path").isin(*[path for path, _ in _SELECTED.values()])
    for test in tests.values():
        needed = needed | test
    profile = (
        fields.filter(needed)
        .groupBy(F.col("extraction_id").alias("selected_extraction_id"))
        .agg(*_selected_aggs(), *[_flag(t).alias(n) for n, t in tests.items()])
    )

    candidates = scoped(docs, scope).filter(status_predicate(spec, scope))
    if spec.processing_status:
        candidates = candidates.filter(F.col("processing_status").isin(*spec.processing_status))
    if spec.document_type:
        candidates = candidates.filter(F.col("document_type") == spec.document_type)
    if spec.schema_key:
        candidates = schema_filter(candidates, extractions, spec.schema_key, scope)

    rows = candidates.join(profile, "selected_extraction_id", "left")
    if spec.search:
        rows = rows.filter(
            contains_ci(F.col("original_filename"), F.lit(spec.search)) | F.col("search_hit")
        )
    if spec.vendor:
        rows = rows.filter(contains_ci(F.col("vendor_name"), F.lit(spec.vendor)))
    if spec.currency:
        rows = rows.filter(F.col("currency") == spec.currency)
    if spec.amount:
        rows = rows.filter(amount_predicate(spec.amount, F.col("total")))
    rows = rows.filter(date_predicate(spec.invoice_date, F.col("invoice_date")))
    rows = rows.filter(date_predicate(spec.due_date, F.col("due_date")))
    for name in tests:
        if name.startswith("pred_"):
            rows = rows.filter(F.col(name))
    return rows.drop(*tests)


# --- order and page ------------------------------------------------------------------------

SORT_COLUMNS = {
    "total": "total",
    "invoiceDate": "invoice_date",
    "vendorName": "vendor_name",
    "filename": "original_filename",
    "schemaName": "schema_name",
    "approvedAt": "approved_at",
    "updatedAt": "updated_at",
}


def sort_columns(sort: str = "approvedAt", direction: str = "desc") -> list[Column]:
    """Chosen key with nulls last both ways; the document id breaks ties."""
    key = F.col(SORT_COLUMNS[sort])
    return [
        key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(),
        F.col("doc_id").asc(),
    ]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def ranked(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place in the whole order, from 1.

    Rows are dealt by ranges of the order and counted where they lie; each range starts behind the rows of
    the ranges before it.  No task holds more than its range, and only a count for each comes together.
    """
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumns({"_range": F.spark_partition_id(), "_index": index}), "ranges")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # One entry for each range.
    listed = F.sort_array(F.collect_list(F.struct("_range", "n")))
    starts = scan(
        F.col("all"), F.lit(0).cast("bigint"), lambda before, x: before + x["n"],
        lambda before, x: F.struct(x["_range"].alias("_range"), before.alias("before")), "struct<_range:int,before:bigint>",
    )
    before = counts.agg(listed.alias("all")).select(F.explode_outer(starts).alias("s")).select("s.*")
    met = placed.join(F.broadcast(before), "_range")
    return met.withColumn(name, F.col("before") + F.col("_index") + 1).drop("_range", "_index", "before")


def page_counts(rows: DataFrame, size: int = 20) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("total"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size)).alias("total_pages"),
    )


# --- aggregates ----------------------------------------------------------------------------


def currency_totals(matches: DataFrame) -> DataFrame:
    """Count and sum per currency; amounts are never mixed across currencies."""
    return (
        matches.filter(F.col("currency").isNotNull())
        .groupBy("currency")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
        .filter(F.col("total").isNotNull())
    )


def schema_counts(matches: DataFrame) -> DataFrame:
    return (
        matches.groupBy("document_type", "schema_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(
            F.col("n").desc(), F.coalesce("schema_name", "document_type").asc(), "document_type"
        )
    )


def first_source(fields: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """First source of every field (or of one path): smallest candidate rank, then id.

    A field without sources keeps a row with null page and no box.
    """
    wanted = fields if path is None else fields.filter(F.col("path") == path)
    first = sources.groupBy("field_id").agg(
        F.min_by(
            F.struct("page", "has_box"),
            F.struct(F.coalesce("candidate_rank", F.lit(2147483647)), "ref_id"),
        ).alias("first")
    )
    return (
        wanted.select("field_id", "extraction_id", "path")
        .join(first, "field_id", "left")
        .select(
            "field_id",
            "extraction_id",
            "path",
            F.col("first.page").alias("page"),
            F.coalesce(F.col("first.has_box"), F.lit(False)).alias("has_box"),
        )
    )


def _summary_candidates(docs: DataFrame, fields: DataFrame, scope: str) -> DataFrame:
    """Scalar fields of the selected extraction of every document that is not an invoice."""
    chosen = scoped(docs, scope).filter(
        (F.col("document_type") != INVOICE_TYPE) & F.col("selected_extraction_id").isNotNull()
    ).select("doc_id", F.col("selected_extraction_id").alias("extraction_id"))
    return fields.filter(F.col("node_kind") == "scalar").select(
        "extraction_id",
        "path",
        "label",
        "sort_order",
        "field_id",
        F.coalesce("schema_field_key", "path").alias("key"),
        _text_value().alias("value"),
    ).join(chosen, "extraction_id")


def summary_values(docs: DataFrame, fields: DataFrame, scope: str = "approved") -> DataFrame:
    """First four non-empty top-level values per document.

    The rank filter is pushed below the shuffle, so each task sends at most four rows a document.
    """
    order = Window.partitionBy("doc_id").orderBy("sort_order", "field_id")
    return (
        _summary_candidates(docs, fields, scope)
        .filter(~F.col("path").contains("[") & (F.col("value") != ""))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SUMMARY_VALUES)
        .select("doc_id", "rank", "key", "label", "value")
    )


def table_summaries(docs: DataFrame, fields: DataFrame, scope: str = "approved") -> DataFrame:
    """Fallback for documents with repeated records only: record count and two first-row cells."""
    candidates = _summary_candidates(docs, fields, scope)
    covered = candidates.filter(
        ~F.col("path").contains("[") & (F.col("value") != "")
    ).select("doc_id").distinct()
    repeated = (
        candidates.join(covered, "doc_id", "left_anti")
        .filter(F.col("path").rlike(RECORD_PATH) & (F.col("value") != ""))
        .withColumns(
            {
                "array_key": F.regexp_extract("path", RECORD_PATH, 1),
                "idx": F.regexp_extract("path", RECORD_PATH, 2),
            }
        )
    )
    per_doc = repeated.groupBy("doc_id").agg(
        F.count_distinct("idx").alias("records"),
        F.min_by(F.struct("array_key", "idx"), F.struct("sort_order", "field_id")).alias("first"),
    )
    counts = per_doc.select(
        "doc_id",
        F.lit(1).alias("rank"),
        F.concat("first.array_key", F.lit("Count")).alias("key"),
        F.lit("Records").alias("label"),
        F.col("records").cast("string").alias("value"),
    )
    order = Window.partitionBy("doc_id").orderBy("sort_order", "field_id")
    row = (
        repeated.join(per_doc, "doc_id")
        .filter(F.col("idx") == F.col("first.idx"))
        .withColumn("cell_no", F.row_number().over(order))
        .filter(F.col("cell_no") <= FIRST_ROW_CELLS)
        .select("doc_id", (F.col("cell_no") + 1).alias("rank"), "key", "label", "value")
    )
    return counts.unionByName(row)


def open_issue_counts(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Open issues of the current extraction; null for a document without extraction."""
    counts = (
        fields.filter(F.col("needs_attention"))
        .groupBy(F.col("extraction_id").alias("current_extraction_id"))
        .agg(F.count(F.lit(1)).alias("issues"))
    )
    return docs.join(counts, "current_extraction_id", "left").withColumn(
        "open_issues",
        F.when(
            F.col("current_extraction_id").isNotNull(),
            F.coalesce("issues", F.lit(0).cast("bigint")),
        ),
    ).drop("issues")


def known_vendors(records: DataFrame) -> DataFrame:
    return records.filter(F.col("vendor_name") != "").select("vendor_name").distinct()


# --- library list and attempts -------------------------------------------------------------

LIBRARY_SORT = {
    "vendorName": "vendor_name",
    "total": "total",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
}


def library_rows(
    docs: DataFrame,
    records: DataFrame,
    search: str | None = None,
    review_status: tuple[str, ...] = (),
    processing_status: tuple[str, ...] = (),
) -> DataFrame:
    """All documents with their record values, filtered (the search keeps LIKE wildcards)."""
    rows = docs.join(
        records.select("doc_id", "vendor_name", "invoice_number", "total", "currency"),
        "doc_id",
        "left",
    )
    if search:
        pattern = F.lit(search)
        rows = rows.filter(
            like_ci(F.col("original_filename"), pattern) | like_ci(F.col("vendor_name"), pattern)
        )
    if processing_status:
        rows = rows.filter(F.col("processing_status").isin(*processing_status))
    if review_status:
        rows = rows.filter(F.col("review_status").isin(*review_status))
    return rows


def library_order(sort: str = "updatedAt", direction: str = "desc") -> list[Column]:
    """The list sorts nulls as the largest values: last ascending, first descending."""
    key = F.col(LIBRARY_SORT[sort])
    return [
        key.asc_nulls_last() if direction == "asc" else key.desc_nulls_first(),
        F.col("doc_id").asc(),
    ]


def latest_attempts(docs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Latest attempt per document and whether a retry makes sense."""
    last = attempts.groupBy("doc_id").agg(
        F.max_by(F.struct("attempt_number", "status", "error_code"), "attempt_number").alias("a")
    )
    can_retry = (F.col("processing_status") == "failed") & ~F.coalesce(
        F.col("failure_code"), F.lit("")
    ).isin(*V.NON_RETRYABLE)
    return docs.join(last, "doc_id", "left").select(
        "doc_id",
        F.col("a.attempt_number").alias("attempt_number"),
        F.col("a.status").alias("attempt_status"),
        F.col("a.error_code").alias("error_code"),
        can_retry.alias("can_retry"),
    )


def active_count(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count_if(F.col("processing_status").isin("queued", "processing")).alias("active")
    )


def workspace_kpis(docs: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Total, documents waiting for review, open issues, clear and active documents: one row."""
    queue = open_issues.agg(
        F.count_distinct("doc_id").alias("needs_review"), F.count(F.lit(1)).alias("open_issues")
    )
    totals = docs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("processing_status").isin("queued", "processing")).alias("active"),
    )
    # Both sides are global aggregates, one row each.
    return totals.join(queue, F.lit(True)).withColumn(
        "clear",
        F.greatest(F.lit(0).cast("bigint"), F.col("total") - F.col("needs_review")),
    )


def result_rows(
    matches: DataFrame, fields: DataFrame, sources: DataFrame, scope: str = "approved"
) -> DataFrame:
    """Result rows of matched documents: format, values, summary text, issues, total source."""
    summaries = summary_values(matches, fields, scope).unionByName(
        table_summaries(matches, fields, scope)
    )
    summary = summaries.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "label", "value"))),
                lambda s: F.concat(s["label"], F.lit(": "), F.coalesce(s["value"], F.lit(""))),
            ),
            "; ",
        ).alias("summary_values")
    )
    issues = open_issue_counts(matches, fields).select("doc_id", "open_issues")
    total_source = first_source(fields, sources, "total").select(
        F.col("extraction_id").alias("selected_extraction_id"),
        F.col("page").alias("total_page"),
        F.col("has_box").alias("total_has_box"),
    )
    has_total = F.col("total").isNotNull()
    valid_date = F.col("invoice_date").rlike(V.ISO_DATE)
    return (
        matches.join(summary, "doc_id", "left")
        .join(issues, "doc_id")
        .join(total_source, "selected_extraction_id", "left")
        .select(
            "doc_id",
            "original_filename",
            "document_type",
            F.coalesce(
                detect_format(F.col("original_filename"), F.col("mime_type")), F.lit("txt")
            ).alias("document_format"),
            "schema_name",
            "vendor_name",
            "invoice_number",
            F.when(valid_date, F.col("invoice_date")).alias("invoice_date"),
            "currency",
            "total",
            F.coalesce("summary_values", F.lit("")).alias("summary_values"),
            "review_status",
            "updated_at",
            "open_issues",
            F.when(has_total, F.col("total_page")).alias("total_page"),
            F.when(has_total, F.col("total_has_box")).alias("total_has_box"),
        )
    )
