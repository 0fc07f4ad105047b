"""Instance paths such as `lineItems[2].total`."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a repeated-record path, of an invoice line path, of any indexed path.
RECORD_PATH = r"^([A-Za-z0-9_]+)\[(\d+)\]\.(.+)\z"
LINE_ITEM_PATH = r"^lineItems\[(\d+)\]\.(description|quantity|unitPrice|lineTotal)\z"
INDEXED_PATH = r"^.+\[\d+\]\..+\z"


def is_record_path(path: Column) -> Column:
    return path.rlike(RECORD_PATH)


def parse_path(path: Column) -> Column:
    """struct(array_key, row_index, column_key), null for a top-level path."""
    return F.when(
        is_record_path(path),
        F.struct(
            F.regexp_extract(path, RECORD_PATH, 1).alias("array_key"),
            F.regexp_extract(path, RECORD_PATH, 2).cast("int").alias("row_index"),
            F.regexp_extract(path, RECORD_PATH, 3).alias("column_key"),
        ),
    )


def schema_key_of(path: Column) -> Column:
    """Stable schema key of an instance path: indexes become `[]`."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def invoice_schema_key(path: Column) -> Column:
    """Only the four declared line-item columns are rewritten; other paths stay."""
    return F.when(
        path.rlike(LINE_ITEM_PATH),
        F.concat(F.lit("lineItems[]."), F.regexp_extract(path, LINE_ITEM_PATH, 2)),
    ).otherwise(path)
