"""Bulk tagging of request texts: amounts, currency, status, dates, vendors, left-over terms."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.money import normalize_decimal
from ..functions.text import trim_ws
from ..plans.stages import stage
from ..session import attach

_L, _R = V.B_LEFT, V.B_RIGHT
_A = V.WS + "+" + V.AMOUNT
# Comparator phrases, in order of precedence.
AMOUNT_PATTERNS = (
    ("between", f"(?i)between{_A}{V.WS}+and{_A}"),
    ("gte", f"(?i)(?:at least|>=){_A}"),
    ("lte", f"(?i)(?:at most|<=|no more than){_A}"),
    ("gt", f"(?i)(?:above|over|greater than|more than|>){_A}"),
    ("lt", f"(?i)(?:below|under|less than|<){_A}"),
)
CURRENCY_PATTERNS = (
    ("EUR", f"(?i){_L}eur{_R}|€"),
    ("USD", f"(?i){_L}usd{_R}|{_L}dollars?{_R}|\\$"),
    ("GBP", f"(?i){_L}gbp{_R}|£"),
)
APPROVED = f"(?i){_L}approved{_R}"
PENDING = f"(?i){_L}(?:needs review|pending|unapproved|draft|to review){_R}"
YEAR = f"(?i){_L}in{V.WS}+(20\\d{{2}}){_R}"
AFTER = f"(?i){_L}after{V.WS}+(\\d{{4}}-\\d{{2}}-\\d{{2}}){_R}"
BEFORE = f"(?i){_L}before{V.WS}+(\\d{{4}}-\\d{{2}}-\\d{{2}}){_R}"
NO_CURRENCY = "Amounts are compared without converting currencies. Add a currency to be precise."
GRAM_SIZES = (3, 4, 5)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def match_amount(text: Column) -> dict[str, Column]:
    """Comparator and values of the first amount phrase by precedence."""

    def number(pattern: str, group: int) -> Column:
        raw = F.regexp_extract(text, pattern, group)
        return normalize_decimal(F.replace(raw, F.lit(","), F.lit("")))

    comparator, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(AMOUNT_PATTERNS):
        hit = text.rlike(pattern)
        comparator = F.when(hit, name).otherwise(comparator)
        value = F.when(hit, number(pattern, 1)).otherwise(value)
    between = AMOUNT_PATTERNS[0][1]
    return {
        "amount_comparator": comparator,
        "amount_value": value,
        "amount_value_to": F.when(text.rlike(between), number(between, 2)),
    }


def match_mentions(text: Column) -> dict[str, Column]:
    """Currency, review states and invoice-date bounds a text mentions."""
    currency = F.lit(None).cast("string")
    for code, pattern in reversed(CURRENCY_PATTERNS):
        currency = F.when(text.rlike(pattern), code).otherwise(currency)
    year = _found(text, YEAR)
    return {
        "currency": currency,
        "review_status": F.when(text.rlike(APPROVED), "approved").when(
            text.rlike(PENDING), "needs_review,ready,reopened"
        ),
        "date_from": F.when(year.isNotNull(), F.concat(year, F.lit("-01-01"))).otherwise(_found(text, AFTER)),
        "date_to": F.when(year.isNotNull(), F.concat(year, F.lit("-12-31"))).otherwise(_found(text, BEFORE)),
    }


def _grams(word: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.transform(starts, lambda i: F.substring(word, i, F.lit(size))))


def _vendor_words(vendor: Column) -> Column:
    return F.filter(F.split(F.lower(vendor), V.WS + "+"), lambda w: F.length(w) > 2)


# Cells of the map of filed grams; the map has a byte for each and goes with the plan.
FILTER_CELLS = 1 << 20


def _cell(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FILTER_CELLS))


def _filed_cells(index: DataFrame) -> bytearray:
    """The map: 1 where a filed gram's hash falls.  At most `FILTER_CELLS` numbers come to the driver."""
    cells = index.select(_cell(F.col("gram")).alias("cell")).distinct().toArrow().column("cell").to_numpy()
    found = np.zeros(FILTER_CELLS, np.uint8)
    found[cells] = 1
    return bytearray(found.tobytes())


def match_vendors(texts: DataFrame, vendors: DataFrame) -> DataFrame:
    """Longest known vendor all of whose words (over two characters) occur in the text.

    Words may occur inside longer words, so this is no token join.  Instead of trying every text
    with every vendor, each vendor is filed under its rarest character gram (a text with the word
    has the gram), texts are joined on their grams, and the few candidates are verified exactly.

    A text's grams are met with a map of the filed ones before they become rows: `FILTER_CELLS` cells, of
    which one is set for each filed gram's hash.  What it lets through by chance finds no vendor.  A gram that
    very many texts have is broadcast with its vendors.
    """
    named = vendors.filter(F.col("vendor_name") != "").select("vendor_name").distinct()
    words = named.select("vendor_name", _vendor_words(F.col("vendor_name")).alias("words")).filter(
        F.size("words") > 0
    )
    longest = F.array_max(F.transform("words", lambda w: F.length(w)))
    size = F.least(longest, F.lit(max(GRAM_SIZES)))
    grams = F.flatten(
        F.transform(
            F.filter("words", lambda w: F.length(w) >= size),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, size)
            ),
        )
    )
    filed = words.select("vendor_name", "words", F.explode_outer(F.array_distinct(grams)).alias("gram"))
    spread = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    index = filed.join(spread, "gram").groupBy("vendor_name").agg(
        F.min_by(F.struct("gram", "words"), F.struct("n", "gram")).alias("k")
    ).select("vendor_name", "k.gram", "k.words")
    index = stage(index, "filed")

    lower = texts.select("id", F.lower("text").alias("_lower"))
    text_grams = F.flatten(F.array_compact(F.array(*[_grams(F.col("_lower"), s) for s in GRAM_SIZES])))
    # The grams travel without the text; the text joins back only for the candidates.
    known = F.lit(_filed_cells(index))
    filed_only = F.filter(
        text_grams, lambda g: F.substring(known, (_cell(g) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    )
    rows = lower.select("id", F.explode_outer(F.array_distinct(filed_only)).alias("gram")).filter(F.col("gram").isNotNull())
    by_gram = index.groupBy("gram").agg(F.collect_list(F.struct("vendor_name", "words")).alias("_vendors"))
    candidates = (
        attach(rows, by_gram, "gram").select("id", F.explode_outer("_vendors").alias("v")).select("id", "v.*")
    )
    hits = candidates.join(lower, "id").filter(
        F.forall("words", lambda w: F.contains(F.col("_lower"), w))
    )
    return hits.groupBy("id").agg(
        F.min_by("vendor_name", F.struct(-F.length("vendor_name"), "vendor_name")).alias("vendor")
    )


def tag_requests(texts: DataFrame, vendors: DataFrame) -> DataFrame:
    """Filters, left-over terms, warnings and the clarification flag of every request text."""
    cleaned = texts.select("id", trim_ws(F.col("text")).alias("text")).filter(F.col("text") != "")
    t = F.col("text")
    tagged = cleaned.withColumns({**match_amount(t), **match_mentions(t)}).join(
        match_vendors(cleaned, vendors), "id", "left"
    )
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    vendor = F.lower("vendor")
    consumed = F.concat(
        F.array_compact(F.array("amount_value", "amount_value_to")),
        F.when(F.col("currency").isNotNull(), F.array(*[F.lit(w) for w in V.CURRENCY_WORDS])).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.split(vendor, V.WS + "+"), F.array().cast("array<string>")),
        F.array(*[F.lit(w) for w in V.STOPWORDS]),
    )
    tagged = tagged.withColumn("_consumed", consumed)
    left = F.filter(
        tokens,
        lambda w: ~F.array_contains("_consumed", w)
        & ~w.rlike(r"^\d")
        & ~F.coalesce(F.contains(F.lower("vendor"), w), F.lit(False)),
    )
    tagged = tagged.withColumn("_left", left)
    filters = ("vendor", "amount_comparator", "currency", "review_status", "date_from", "date_to")
    none = F.lit(True)
    for name in filters:
        none = none & F.col(name).isNull()
    fallback = none & (F.size("_left") > 0)
    terms = F.array_join("_left", ", ")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("amount_comparator").isNotNull() & F.col("currency").isNull(), NO_CURRENCY),
            F.when(
                ~fallback & (F.size("_left") > 0),
                F.concat(F.lit("Ignored: "), terms, F.lit(". Only recognized filters are applied.")),
            ),
        )
    )
    return tagged.withColumns(
        {
            "search": F.when(fallback, F.array_join("_left", " ")),
            "unparsed_terms": F.when(fallback, "").otherwise(terms),
            "warnings": F.array_join(warnings, " | "),
            "needs_clarification": none & ~fallback,
        }
    ).drop("_consumed", "_left", "text")
