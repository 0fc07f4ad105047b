"""Exports of search results: CSV guarded against formula injection, and JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The export columns and where each comes from.
EXPORT_COLUMNS = {
    "Document": "original_filename",
    "Type": "document_type",
    "Schema": "schema_name",
    "Vendor": "vendor_name",
    "Invoice #": "invoice_number",
    "Invoice date": "invoice_date",
    "Currency": "currency",
    "Total": "total",
    "Summary values": "summary_values",
    "Review status": "review_status",
    "Updated": "updated_at",
    "Open issues": "open_issues",
    "Document ID": "doc_id",
}
FORMULA_START = r"^[=+\-@\t\r]"


def guard_cell(value: Column) -> Column:
    """Text of a cell; one that a spreadsheet could take for a formula gets an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def export_rows(results: DataFrame) -> DataFrame:
    return results.select(*[guard_cell(F.col(c)).alias(n) for n, c in EXPORT_COLUMNS.items()])


def export_csv(results: DataFrame, path: str) -> None:
    """Write all result rows as CSV files with a header, one per partition and without a cap.

    Cells with quotes, commas or line breaks are quoted, blanks at their ends stay, and an empty cell is empty.
    """
    options = {"header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    export_rows(results).write.options(**options).csv(path)


def export_json(results: DataFrame, path: str) -> None:
    """Write all result rows as JSON lines; empty fields are null, not left out."""
    results.write.option("ignoreNullFields", "false").json(path)
