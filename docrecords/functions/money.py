"""Fixed-point money: scale-4 values, cent rounding half away from zero.  No floating point."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .text import trim_ws

MONEY = "decimal(38,4)"


def is_decimal_string(col: Column) -> Column:
    return F.coalesce(col.rlike(V.PLAIN_DECIMAL), F.lit(False))


def _cut(col: Column) -> Column:
    # A cast would round the fifth digit; the digits beyond the fourth are cut instead.
    text = trim_ws(col)
    cut = F.regexp_replace(text, r"^(-?\d+(?:\.\d{1,4})?)\d*\z", "$1")
    return F.when(text.rlike(V.PLAIN_DECIMAL), cut)


def to_money(col: Column) -> Column:
    """Decimal string -> scale-4 value; null when the text is not a decimal."""
    return _cut(col).try_cast(MONEY)


def to_factor(col: Column) -> Column:
    """Operand of `multiply_money`."""
    return to_money(col)


def multiply_money(a: Column, b: Column) -> Column:
    """Product of two `to_factor` values, cut (not rounded) to four decimals.

    Factors of up to 14 integer digits are multiplied as they are.  Of larger ones whole and fractional parts
    are multiplied apart, in ten-thousandths, so that no digit is lost; null when the product has more than
    34 integer digits.
    """
    most = F.lit(10**14).cast("decimal(15,0)")
    product = a.try_cast("decimal(18,4)") * b.try_cast("decimal(18,4)")
    short = (product - product % F.lit("0.0001").cast("decimal(4,4)")).cast(MONEY)
    return F.when((F.abs(a) < most) & (F.abs(b) < most), short).otherwise(_long_product(a, b))


def _long_product(a: Column, b: Column) -> Column:
    scale = F.lit(10000).cast("decimal(5,0)")
    one = F.lit(1).cast("decimal(1,0)")

    def parts(x: Column) -> tuple[Column, Column]:
        return F.floor(F.abs(x)).cast("decimal(34,0)"), ((F.abs(x) % one) * scale).cast("decimal(4,0)")

    (wa, fa), (wb, fb) = parts(a), parts(b)
    terms = [F.try_multiply(F.try_multiply(wa, wb), scale), F.try_multiply(wa, fb), F.try_multiply(wb, fa)]
    total = F.floor(fa * fb / scale).cast("decimal(38,0)")
    for term in terms:
        total = F.try_add(total, term)
    cut = (total * F.lit("0.0001").cast("decimal(4,4)")).cast(MONEY)
    return F.when((a < 0) != (b < 0), -cut).otherwise(cut)


def to_cents(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(38,2)")


def format_cents(value: Column) -> Column:
    return to_cents(value).cast("string")


def normalize_decimal(col: Column) -> Column:
    """`1234.567` -> `1234.57`."""
    return format_cents(to_money(col))


def equals_cents(a: Column, b: Column) -> Column:
    return to_cents(a) == to_cents(b)
