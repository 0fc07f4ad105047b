"""String functions: trimming, slugs, labels, LIKE escaping, text and HTML normalization."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .arrays import let, replace_matches


def trim_ws(col: Column) -> Column:
    """Trim Unicode white space on both ends (plain `trim` strips spaces only)."""
    return F.btrim(col, F.lit(V.WS_LITERAL))


def ltrim_ws(col: Column) -> Column:
    return F.ltrim(col, F.lit(V.WS_LITERAL))


def collapse_ws(col: Column) -> Column:
    return F.regexp_replace(col, f"{V.WS}+", " ")


def upper_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substr(col, F.lit(2)))


def slug_camel(label: Column) -> Column:
    """`Invoice No.` -> `invoiceNo`; `field` when nothing is left."""

    def joined(words: Column) -> Column:
        first = F.substring_index(words, " ", 1)
        rest = F.substr(words, F.length(first) + 1)
        slug = F.concat(F.lower(first), F.replace(F.initcap(rest), F.lit(" "), F.lit("")))
        return F.when(words == "", F.lit("field")).otherwise(slug)

    # Bound: each use would replace again.
    return let(F.trim(F.regexp_replace(label, "[^A-Za-z0-9]+", " ")), joined)


def slug_snake(text: Column) -> Column:
    """`Invoice No.` -> `invoice_no`; `schema` when nothing is left."""
    snake = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    snake = F.regexp_replace(snake, r"^_+|_+\z", "")
    return F.when(snake == "", F.lit("schema")).otherwise(snake)


def humanize_label(raw: Column) -> Column:
    """`invoice_number` or `invoiceNumber` -> `Invoice number` / `Invoice Number`."""
    spaced = F.regexp_replace(raw, "[_-]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    return let(trim_ws(collapse_ws(spaced)), lambda s: F.when(s == "", raw).otherwise(upper_first(s)))


def humanize_key(key: Column) -> Column:
    """Display label of an array or column key (keeps surrounding white space)."""
    spaced = F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "[_-]+", " ")
    return F.when(spaced.rlike("^[A-Za-z0-9_]"), upper_first(spaced)).otherwise(spaced)


def normalize_vendor(name: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(name != "", cleaned)


def escape_like(value: Column) -> Column:
    """Escape `\\`, `%` and `_` so that a LIKE pattern matches them literally."""
    return F.regexp_replace(value, r"([\\%_])", r"\\$1")


def contains_ci(col: Column, needle: Column) -> Column:
    """Case-insensitive literal containment."""
    return F.contains(F.lower(col), F.lower(needle))


def equals_ci(col: Column, value: Column) -> Column:
    """Case-insensitive literal equality."""
    return F.lower(col) == F.lower(value)


def like_ci(col: Column, pattern: Column) -> Column:
    """ILIKE containment in which `%` and `_` of the pattern keep their special meaning."""
    return F.ilike(col, F.concat(F.lit("%"), pattern, F.lit("%")), F.lit("\\"))


def utf16_len(col: Column) -> Column:
    """Length in UTF-16 code units; converts code-point offsets at the edge of the system."""
    return F.floor(F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def normalize_text(raw: Column) -> Column:
    """Drop a leading byte order mark and turn CRLF / CR into LF."""
    return F.regexp_replace(F.regexp_replace(raw, r"^\uFEFF", ""), r"\r\n?", "\n")


def is_blank(col: Column) -> Column:
    return trim_ws(F.coalesce(col, F.lit(""))) == ""


def _code_point(n: Column) -> Column:
    packed = F.unhex(F.lpad(F.hex(n), 8, "0"))
    valid = (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(packed, "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Decode decimal, then hexadecimal, then the seven named entities; keep unknown ones."""

    def decimal(m: Column) -> Column:
        n = F.regexp_extract(m, r"(\d+)", 1).try_cast("bigint")
        return F.coalesce(_code_point(n), m)

    def hexadecimal(m: Column) -> Column:
        n = F.conv(F.regexp_extract(m, "(?i)x([0-9a-f]+)", 1), 16, 10).try_cast("bigint")
        return F.coalesce(_code_point(n), m)

    def named(m: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in V.NAMED_ENTITIES.items() for x in kv])
        return F.coalesce(F.try_element_at(known, F.lower(m)), m)

    # Every step is bound once: an expression that names its input several times would otherwise
    # repeat all the steps before it.
    def step(source: Column, marker: str, pattern: str, convert: Callable[[Column], Column]) -> Column:
        return let(
            source,
            lambda t: F.when(t.rlike(marker), replace_matches(t, pattern, convert)).otherwise(t),
        )

    text = step(text, "&#[0-9]", r"&#(\d+);", decimal)
    text = step(text, "(?i)&#x[0-9a-f]", "(?i)&#x([0-9a-f]+);", hexadecimal)
    return step(text, "&", "(?i)&[a-z]+;|&#39;", named)


# The ordered cleaning steps of the HTML reduction, before and after headings.
_HTML_BEFORE_HEADINGS = (
    (r"(?is)<script\b[^>]*>.*?</script>", " "),
    (r"(?is)<style\b[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<head\b[^>]*>.*?</head>", " "),
    (V.WS + r"*((?i)</?(?:table|thead|tbody|tfoot|tr|td|th)\b[^>]*>)" + V.WS + "*", "$1"),
)
_HTML_HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
_HTML_AFTER_HEADINGS = (
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</tr>", "\n"),
    (r"(?i)<t[dh]\b[^>]*>", "\t"),
    (r"(?i)</(p|div|section|article|header|footer|ul|ol|table|tr|br)>", "\n"),
    (r"(?i)<br" + V.WS + r"*/?>(?!\n)", "\n"),
    (r"(?i)<(p|div|section|article|header|footer|ul|ol|table)\b[^>]*>", "\n"),
    (r"<[^>]+>", " "),
)
_LINE_START_WS = r"(?<![^\n])[" + V.WS_CHARS.replace(r"\n", "") + "]+"
_HTML_LINE_CLEANUP = (
    (r"[ \u00A0]{2,}", " "),
    (r"[ \t]+(?=\n|\z)", ""),
    (_LINE_START_WS, ""),
    (r"\n{3,}", "\n\n"),
)


def _steps(col: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def html_to_text(raw: Column) -> Column:
    """Reduce untrusted HTML to canonical plain text: headings as `#`, items as `-`, cells by tab."""

    def heading(m: Column) -> Column:
        level = F.regexp_extract(m, _HTML_HEADING, 1).cast("int")
        inner = trim_ws(F.regexp_replace(F.regexp_extract(m, _HTML_HEADING, 2), "<[^>]+>", " "))
        return F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), inner, F.lit("\n"))

    html = _steps(normalize_text(raw), _HTML_BEFORE_HEADINGS)
    html = replace_matches(html, _HTML_HEADING, heading)
    html = decode_entities(_steps(html, _HTML_AFTER_HEADINGS))
    return trim_ws(_steps(html, _HTML_LINE_CLEANUP))
