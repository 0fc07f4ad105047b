"""Record-quality rules: single-field checks, cross-field rules, attention, blockers, progress.

Cross-field rules look at the fields of one extraction.  The fields that such a rule reads are
hash-partitioned by extraction once and every rule is a window over that partitioning, so a chain of
rules costs one shuffle and no join; all other fields stay where they lie.  An extraction is bounded
by the size limit of the document it came from.

Rules read and refine two columns: `validation_state` and `validation_issues`.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.money import (
    equals_cents,
    format_cents,
    is_decimal_string,
    multiply_money,
    normalize_decimal,
    to_factor,
    to_money,
)
from ..functions.paths import INDEXED_PATH, LINE_ITEM_PATH
from ..functions.typing import effective_value

INVOICE_SCHEMA = "invoice"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?"


def value_column() -> Column:
    return effective_value(
        F.col("review_state"), F.col("corrected_value"), F.col("extracted_value")
    )


def issue(severity: str, message: Column) -> Column:
    return F.array(F.struct(F.lit(severity).alias("severity"), message.alias("message")))


def no_issues() -> Column:
    return F.array().cast("array<struct<severity:string,message:string>>")


def _within_extraction(value: Column) -> Column:
    return value.over(Window.partitionBy("extraction_id"))


# --- single fields -------------------------------------------------------------------------


def single_error(
    field_type: Column, value: Column, label: Column, required: Column, review_state: Column
) -> Column:
    """Error message of one field, null when it is valid."""
    blank = F.coalesce(value, F.lit("")) == ""
    missing = (review_state != "not_applicable") & required

    def unless(pattern: str, message: str) -> Column:
        return F.when(~value.rlike(pattern), message)

    typed = (
        F.when(field_type == "date", unless(V.ISO_DATE, "Enter a valid date (YYYY-MM-DD)."))
        .when(field_type == "datetime", unless(ISO_DATETIME, "Enter a valid date/time."))
        .when(
            field_type == "currency",
            unless(V.CURRENCY_CODE, "Enter a 3-letter currency code (e.g. USD)."),
        )
        .when(field_type == "decimal", unless(V.PLAIN_DECIMAL, "Enter a valid number."))
        .when(field_type == "integer", unless(V.WHOLE_NUMBER, "Enter a whole number."))
        .when(field_type == "boolean", unless(V.BOOLEAN_WORD, "Enter true or false."))
    )
    return F.when(blank, F.when(missing, F.concat(label, F.lit(" is required.")))).otherwise(typed)


def check_single(fields: DataFrame) -> DataFrame:
    valued = fields.withColumn("_checked", value_column())
    error = single_error(
        F.col("type"), F.col("_checked"), F.col("label"), F.col("required"), F.col("review_state")
    )
    failed = F.col("_error").isNotNull()
    return valued.withColumn("_error", error).withColumns(
        {
            "validation_state": F.when(failed, "invalid").otherwise("valid"),
            "validation_issues": F.when(failed, issue("error", F.col("_error"))).otherwise(
                no_issues()
            ),
        }
    ).drop("_checked", "_error")


# --- cross-field rules ---------------------------------------------------------------------


def by_extraction(fields: DataFrame) -> DataFrame:
    """Field rows partitioned for the rules, with their effective value."""
    return fields.repartition("extraction_id").withColumn("_value", value_column())


def _is_date() -> Column:
    """A date of a generic schema (needs `_value`)."""
    return _generic() & F.col("type").isin(*V.DATE_TYPES) & (F.col("_value") != "")


def meets_others() -> Column:
    """Whether a cross-field rule reads or warns a field (needs `_value`)."""
    invoice = F.col("schema_key") == INVOICE_SCHEMA
    sums = F.col("path").isin("subtotal", "total") | (invoice & (F.col("path") == "tax"))
    lines = invoice & F.col("path").rlike(LINE_ITEM_PATH)
    dates = _is_date() & (_named_like(V.START_DATE) | _named_like(V.END_DATE))
    return F.coalesce(sums, F.lit(False)) | F.coalesce(lines, F.lit(False)) | F.coalesce(dates, F.lit(False))


def _warn(fields: DataFrame, message: Column, replaces: tuple[str, ...]) -> DataFrame:
    """Set a warning where `message` is given and the current state may be replaced."""
    hit = message.isNotNull() & F.col("validation_state").isin(*replaces)
    return fields.withColumn("_hit", hit).withColumns(
        {
            "validation_issues": F.when(F.col("_hit"), issue("warning", message)).otherwise(
                F.col("validation_issues")
            ),
            "validation_state": F.when(F.col("_hit"), "warning").otherwise(
                F.col("validation_state")
            ),
        }
    ).drop("_hit")


_NOT_INVALID = ("valid", "warning", "not_checked")


def _decimal_text(col: Column) -> Column:
    return F.when(is_decimal_string(col), col)


def line_math(fields: DataFrame) -> DataFrame:
    """Quantity x unit price against the line total, at cents.  Adds `_line_off`."""
    column = F.regexp_extract("path", LINE_ITEM_PATH, 2)
    in_scope = (F.col("schema_key") == INVOICE_SCHEMA) & F.col("path").rlike(LINE_ITEM_PATH)
    line = F.when(in_scope, F.regexp_extract("path", LINE_ITEM_PATH, 1))
    per_line = Window.partitionBy("extraction_id", "_line")

    is_total = F.col("_line").isNotNull() & (F.col("_column") == "lineTotal")

    def cell(name: str) -> Column:
        own = F.when(F.col("_line").isNotNull() & (F.col("_column") == name), F.col("_value"))
        return F.max(own).over(per_line)

    rows = fields.withColumns({"_line": line, "_column": column}).withColumns(
        {"_qty": cell("quantity"), "_unit": cell("unitPrice"), "_total": cell("lineTotal")}
    )
    # Only a line's total is checked: other rows are spared the arithmetic.
    rows = rows.withColumns({c: F.when(is_total, _decimal_text(F.col(c))) for c in ("_qty", "_unit", "_total")})
    rows = rows.withColumns({"_a": to_factor(F.col("_qty")), "_b": to_factor(F.col("_unit")), "_t": to_money(F.col("_total"))})
    product = F.col("_product")
    factors = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = rows.withColumn("_product", F.when(factors & F.col("_t").isNotNull(), multiply_money(F.col("_a"), F.col("_b"))))
    # A product that no recorded total can hold is off as well.
    off = F.col("_t").isNotNull() & F.coalesce(~equals_cents(product, F.col("_t")), factors)
    rows = rows.withColumn("_line_off", F.coalesce(off, F.lit(False)))
    message = F.when(
        F.col("_line_off"),
        F.concat(
            "_qty",
            F.lit(" x "),
            normalize_decimal(F.col("_unit")),
            F.lit(" = "),
            F.coalesce(format_cents(product), F.lit("a value beyond 34 digits")),
            F.lit(", but "),
            normalize_decimal(F.col("_total")),
            F.lit(" was recorded."),
        ),
    )
    return _warn(rows, message, _NOT_INVALID).drop("_line", "_column", "_qty", "_unit", "_total", "_a", "_b", "_t", "_product")


def subtotal_after_lines(fields: DataFrame) -> DataFrame:
    """Warn a valid subtotal when any line of the extraction is off (needs `_line_off`)."""
    any_off = _within_extraction(F.bool_or("_line_off"))
    message = F.when(
        (F.col("path") == "subtotal") & any_off,
        "One or more line totals look mispriced; verify the subtotal.",
    )
    return _warn(fields.withColumn("_message", message), F.col("_message"), ("valid",)).drop(
        "_message"
    )


def total_reconciliation(fields: DataFrame) -> DataFrame:
    """Subtotal + tax against the total, at cents."""

    def amount(path: str) -> Column:
        own = (F.col("schema_key") == INVOICE_SCHEMA) & (F.col("path") == path)
        return _within_extraction(F.max(F.when(own, F.col("_value"))))

    is_total = F.col("path") == "total"
    rows = fields.withColumns({"_s": amount("subtotal"), "_t": amount("tax"), "_g": amount("total")})
    rows = rows.withColumns({c: F.when(is_total, _decimal_text(F.col(c))) for c in ("_s", "_t", "_g")})
    expected = to_money(F.col("_s")) + to_money(F.col("_t"))
    message = F.when(
        is_total & ~equals_cents(expected, to_money(F.col("_g"))),
        F.concat(
            F.lit("Subtotal + tax ("),
            format_cents(expected),
            F.lit(") does not equal the total ("),
            normalize_decimal(F.col("_g")),
            F.lit(")."),
        ),
    )
    return _warn(rows, message, _NOT_INVALID).drop("_s", "_t", "_g")


def _named_like(pattern: str) -> Column:
    return F.lower("path").rlike(pattern) | F.lower("label").rlike(pattern)


def _generic() -> Column:
    return F.col("schema_key").isNotNull() & (F.col("schema_key") != INVOICE_SCHEMA)


def date_order(fields: DataFrame) -> DataFrame:
    """An end-like date before a start-like date is warned; the last such start names the message.

    No pairs are formed.  A start is dominated when a later one is at least as late; among the
    others the values fall with the position, so the last start after an end date is the one with
    the smallest greater value: an as-of lookup in value order.
    """
    is_date = _is_date()
    start = F.when(is_date & _named_like(V.START_DATE), F.col("_value"))
    end = F.when(is_date & _named_like(V.END_DATE), F.col("_value"))
    later = (
        Window.partitionBy("extraction_id")
        .orderBy("sort_order", "field_id")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    falling = Window.partitionBy("extraction_id").orderBy(F.col("_date").desc_nulls_last())
    greater = (
        Window.partitionBy("extraction_id")
        .orderBy("_rank")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    rows = fields.withColumns({"_start": start, "_end": end})
    rows = rows.withColumn("_date", F.coalesce("_start", "_end"))
    beaten = F.max("_start").over(later) >= F.col("_start")
    rows = rows.withColumns(
        {
            "_step": F.col("_start").isNotNull() & ~F.coalesce(beaten, F.lit(False)),
            "_rank": F.dense_rank().over(falling),
        }
    )
    last_step = F.max(F.when(F.col("_step"), F.struct("_rank", "label"))).over(greater)
    rows = rows.withColumn("_by", F.when(F.col("_end").isNotNull(), last_step["label"]))
    message = F.when(
        F.col("_by").isNotNull(),
        F.concat(
            "label", F.lit(" is before "), "_by", F.lit("; verify the date order.")
        ),
    )
    return _warn(rows, message, _NOT_INVALID).drop("_start", "_end", "_date", "_step", "_rank", "_by")


def table_completeness(fields: DataFrame) -> DataFrame:
    """Material cells left empty in repeated records."""
    empty = _generic() & F.col("material") & F.col("path").rlike(INDEXED_PATH) & (
        F.coalesce("_value", F.lit("")) == ""
    )
    message = F.when(
        empty, F.concat("label", F.lit(" is empty in a repeated record; verify this row."))
    )
    return _warn(fields, message, _NOT_INVALID)


Rule = Callable[[DataFrame], DataFrame]
INVOICE_RULES: tuple[Rule, ...] = (line_math, subtotal_after_lines, total_reconciliation)
GENERIC_RULES: tuple[Rule, ...] = (date_order, table_completeness)
CROSS_FIELD_RULES: tuple[Rule, ...] = (*INVOICE_RULES, date_order)


def validate(fields: DataFrame, extra_rules: tuple[Rule, ...] = ()) -> DataFrame:
    """All checks in order.  Rules choose their rows by `schema_key`; invalid is never overwritten.

    `extra_rules` are functions over the same columns (with `_value`), applied last.
    """
    valued = check_single(fields.withColumn("_value", value_column()))
    alone = valued.filter(~meets_others()).withColumn("_line_off", F.lit(False))
    rows = valued.filter(meets_others()).repartition("extraction_id")
    for rule in CROSS_FIELD_RULES:
        rows = rule(rows)
    rows = rows.unionByName(alone)
    for rule in (table_completeness, *extra_rules):
        rows = rule(rows)
    return rows.drop("_value", "_line_off")


# --- attention, blockers, progress ---------------------------------------------------------


def needs_attention(
    review_state: Column, confidence_state: Column, validation_state: Column
) -> Column:
    unresolved = validation_state.isin("invalid", "warning")
    return (
        F.when(review_state.isin("confirmed", "not_applicable"), validation_state == "invalid")
        .when(review_state == "corrected", unresolved)
        .otherwise((confidence_state != "high") | unresolved)
    )


def with_attention(fields: DataFrame) -> DataFrame:
    return fields.withColumn(
        "needs_attention",
        needs_attention(
            F.col("review_state"), F.col("confidence_state"), F.col("validation_state")
        ),
    )


def _first_message() -> Column:
    return F.try_element_at("validation_issues", F.lit(1))["message"]


def approval_blockers(checked: DataFrame) -> DataFrame:
    """Fields that keep their extraction from being approved, with the reason."""
    invalid = F.col("validation_state") == "invalid"
    open_issue = F.col("needs_attention") & (F.col("required") | F.col("material"))
    message = (
        F.when(invalid, F.coalesce(_first_message(), F.concat("label", F.lit(" is invalid."))))
        .when(
            (F.col("validation_state") == "warning") & (_first_message() != ""), _first_message()
        )
        .otherwise(F.concat("label", F.lit(" needs your review before approval.")))
    )
    return checked.filter(invalid | open_issue).select(
        "extraction_id", "field_id", "path", message.alias("message")
    )


def review_progress(checked: DataFrame) -> DataFrame:
    """Review status and progress counts per extraction."""
    resolved = F.col("review_state").isin("confirmed", "corrected", "not_applicable")
    open_now = F.col("needs_attention")
    blocking = (F.col("validation_state") == "invalid") | (
        open_now & (F.col("required") | F.col("material"))
    )
    return checked.groupBy("extraction_id").agg(
        F.when(F.bool_or(blocking), "needs_review").otherwise("ready").alias("review_status"),
        F.count_if(resolved | open_now).alias("attention_fields"),
        F.count_if(resolved & ~open_now).alias("resolved_fields"),
    )
