"""Review queue: open issues, their priority, the top issue per document, queue order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V


def open_issues(checked: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    """Fields needing attention in the current extraction of documents that are not approved."""
    pending = docs.filter(F.col("review_status") != "approved").select(
        "doc_id",
        "original_filename",
        "processing_status",
        "review_status",
        F.col("current_extraction_id").alias("extraction_id"),
    )
    context = records.select("doc_id", "vendor_name", "invoice_number", "total", "currency")
    return (
        checked.filter("needs_attention")
        .drop("doc_id")
        .join(pending, "extraction_id")
        .join(context, "doc_id", "left")
    )


def _weights(col: Column, table: dict[str, int]) -> Column:
    score = F.lit(0)
    for state, weight in table.items():
        score = F.when(col == state, weight).otherwise(score)
    return score


def issue_priority() -> Column:
    return (
        _weights(F.col("validation_state"), V.VALIDATION_WEIGHT)
        + _weights(F.col("confidence_state"), V.CONFIDENCE_WEIGHT)
        + F.when(F.col("required"), V.REQUIRED_WEIGHT).otherwise(0)
        + F.when(F.col("material"), V.MATERIAL_WEIGHT).otherwise(0)
    )


def issue_message() -> Column:
    """What to do about an issue.  Invalid data speaks first, then the confidence state."""
    issues = F.col("validation_issues")
    errors = F.filter(issues, lambda i: i["severity"] == "error")
    first_error = F.coalesce(F.try_element_at(errors, F.lit(1)), F.try_element_at(issues, F.lit(1)))
    first = F.try_element_at(issues, F.lit(1))
    state = F.col("confidence_state")
    label = F.col("label")

    def say(before: str, after: str) -> Column:
        return F.concat(F.lit(before), label, F.lit(after))

    return (
        F.when((F.col("validation_state") == "invalid") & first_error.isNotNull(), first_error["message"])
        .when(state == "conflicting", say("Conflicting values found for ", " — choose the correct one."))
        .when((state == "missing") & F.col("required"), say("", " is required but was not found."))
        .when(state == "missing", say("", " was not found — add it if it applies."))
        .when(state == "low", say("Low-confidence reading for ", " — verify against the document."))
        .when(state == "inferred", say("", " was inferred — confirm it matches the document."))
        .when(state == "medium", say("Please verify ", "."))
        .when((F.col("validation_state") == "warning") & first.isNotNull(), first["message"])
        .otherwise(say("", " needs review."))
    )


def issue_severity() -> Column:
    blocking = (
        F.col("required")
        | (F.col("validation_state") == "invalid")
        | (F.col("confidence_state") == "missing")
    )
    return F.when(blocking, "Blocking approval").otherwise("Needs verification")


def issue_reason() -> Column:
    state = F.col("confidence_state")
    return (
        F.when(F.col("validation_state") == "invalid", "Validation failed")
        .when(state == "conflicting", "Conflicting values")
        .when((state == "missing") & F.col("required"), "Required value missing")
        .when(state == "missing", "Value not found")
        .when(state == "low", "Low confidence")
        .when(state == "inferred", "Inferred value")
        .when(F.col("validation_state") == "warning", "Validation warning")
        .otherwise("Review suggested")
    )


def top_issues(issues: DataFrame) -> DataFrame:
    """The most urgent issue of every document and its issue count, by one combined aggregate."""
    scored = issues.withColumn("score", issue_priority())
    rank = F.struct(-F.col("score"), "sort_order", "field_id")
    top = F.struct(
        "score",
        "path",
        "label",
        "confidence_state",
        "validation_state",
        "required",
        "material",
        "validation_issues",
    )
    carried = (
        "original_filename",
        "vendor_name",
        "invoice_number",
        "total",
        "currency",
        "processing_status",
        "review_status",
    )
    return (
        scored.groupBy("doc_id")
        .agg(
            F.min_by(top, rank).alias("top"),
            F.count(F.lit(1)).alias("open_issue_count"),
            *[F.min(c).alias(c) for c in carried],
        )
        .select("doc_id", *carried, "open_issue_count", "top.*")
        .withColumns(
            {
                "message": issue_message(),
                "severity": issue_severity(),
                "reason": issue_reason(),
            }
        )
        .drop("validation_issues")
    )


def review_queue(issues: DataFrame, limit: int | None = 50) -> DataFrame:
    ranked = top_issues(issues).orderBy(
        F.col("score").desc(), F.col("open_issue_count").desc(), F.col("doc_id").asc()
    )
    return ranked if limit is None else ranked.limit(limit)


def queue_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count_distinct("doc_id").alias("total_documents"),
        F.count(F.lit(1)).alias("total_open_issues"),
    )
