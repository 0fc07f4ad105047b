"""Field typing: type inference, value normalization, typed index columns, confidence, importance."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .arrays import let
from .text import trim_ws


# The tags `infer_type` gives.
INFERRED = ("string", "currency", "date", "boolean", "integer", "decimal", "text")


def infer_type(value: Column) -> Column:
    """Type tag of a sample value; the order of the tests decides."""

    def tag(v: Column) -> Column:
        return (
            F.when(v == "", "string")
            .when(v.rlike(V.CURRENCY_CODE), "currency")
            .when(v.rlike(V.ISO_DATE) | v.rlike(V.US_DATE), "date")
            .when(v.rlike(V.BOOLEAN_WORD), "boolean")
            .when(F.replace(v, F.lit(","), F.lit("")).rlike(V.INTEGER_15), "integer")
            .when(v.rlike(V.MONEY_SYMBOL) & v.rlike(V.MONEY_DECIMAL), "currency")
            .when(v.rlike(V.MONEY_DECIMAL), "decimal")
            .when(F.length(v) > V.LONG_TEXT_CHARS, "text")
            .otherwise("string")
        )

    # Bound: each test would trim again.
    return let(trim_ws(value), tag)


def normalize_value(field_type: Column, raw: Column) -> Column:
    """Value as stored for its type.  Text that does not parse is kept, never nulled."""

    def stored(v: Column) -> Column:
        whole = F.replace(v, F.lit(","), F.lit(""))
        bare = F.regexp_replace(v, f"[$\\u20ac\\u00a3,{V.WS_CHARS}]", "")
        number = let(bare, lambda b: F.when(b.rlike(V.PLAIN_DECIMAL), b).otherwise(v))
        return F.when(
            v != "",
            F.when(field_type == "integer", F.when(whole.rlike(V.INTEGER_15), whole).otherwise(v))
            .when((field_type == "currency") & v.rlike(V.CURRENCY_CODE), v)
            .when(field_type.isin("decimal", "currency"), number)
            .when(
                field_type == "boolean",
                F.when(v.rlike(V.TRUE_WORD), "true").when(v.rlike(V.FALSE_WORD), "false").otherwise(v),
            )
            .otherwise(v),
        )

    return let(trim_ws(raw), stored)


def effective_value(review_state: Column, corrected: Column, extracted: Column) -> Column:
    """The value that counts: nothing when not applicable, else corrected before extracted."""
    return F.when(review_state != "not_applicable", F.coalesce(corrected, extracted))


def typed_index(field_type: Column, value: Column) -> dict[str, Column]:
    """Typed index columns of a scalar value, kept next to it so that filters need no parsing."""
    numeric = F.when(
        field_type.isin(*V.NUMERIC_TYPES) & value.rlike(V.PLAIN_DECIMAL),
        value.try_cast("decimal(38,6)"),
    )
    return {
        "value_text": F.when((value != "") & ~field_type.isin(*V.NESTED_TYPES), value),
        "value_numeric": numeric,
        "value_date": F.when(
            field_type.isin(*V.DATE_TYPES) & value.rlike(V.ISO_DATE_PREFIX), F.left(value, F.lit(10))
        ),
        "value_boolean": F.when((field_type == "boolean") & (value != ""), value.rlike(V.TRUE_WORD)),
    }


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= V.HIGH_CONFIDENCE, "high")
        .when(score >= V.MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )


def field_importance(key: Column, label: Column, field_type: Column) -> Column:
    """struct(required, material) from the words of a key and label and from the type."""
    words = V.B_LEFT + "(?:" + "|".join(V.IMPORTANT_WORDS) + ")" + V.B_RIGHT
    important = F.lower(F.concat(key, F.lit(" "), label)).rlike(words)
    return F.struct(
        (important & (field_type != "text")).alias("required"),
        (important | field_type.isin(*V.MATERIAL_TYPES)).alias("material"),
    )


def schema_hash(basis: Column) -> Column:
    """Base-36 text of the 32-bit, multiplier-31 rolling hash over the characters of `basis`."""
    mask = F.lit(0xFFFFFFFF)
    code = F.aggregate(
        F.filter(F.split(basis, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(mask),
    )
    return F.lower(F.conv(code.cast("string"), 10, 36))
