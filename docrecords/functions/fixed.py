"""Word lists, lookup tables, constants and patterns that decide results.

They are data, not logic, and are kept together here so that a reader can compare them with a
specification.  Patterns are Java regular expressions (what Spark runs).
"""

# White space as ECMAScript's \s understands it (Java's \s is ASCII only).  Java tests the parts of a class
# one by one: the rare ones are behind a range, so that most characters are told by two tests.
WS_CHARS = (
    r"\t\n\x0B\f\r \u00A0"
    r"[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
)
WS = f"[{WS_CHARS}]"
WS_LITERAL = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029])
) + "\u202F\u205F\u3000\uFEFF"
# Most characters are told by the range in front.
NOT_WS = f"[!-~[^{WS_CHARS}]]"

# File formats by extension and by MIME type.
FORMAT_BY_EXTENSION = {
    "pdf": "pdf",
    "txt": "txt",
    "text": "txt",
    "md": "markdown",
    "markdown": "markdown",
    "mdown": "markdown",
    "csv": "csv",
    "tsv": "csv",
    "html": "html",
    "htm": "html",
}
FORMAT_BY_MIME = {
    "application/pdf": "pdf",
    "text/plain": "txt",
    "text/markdown": "markdown",
    "text/csv": "csv",
    "text/tab-separated-values": "csv",
    "text/html": "html",
}
PARSER_VERSION = "parse.v1"

# Named HTML entities that are decoded; every other name stays as written.
NAMED_ENTITIES = {
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
}

# Key/value labels: two-letter words that may be part of a label.
SHORT_LABEL_WORDS = ("no", "id", "po")
MAX_LABEL_CHARS = 49

# Value typing.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
US_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}\z"
CURRENCY_CODE = r"^[A-Z]{3}\z"
INTEGER_15 = r"^-?\d{1,15}\z"
WHOLE_NUMBER = r"^-?\d+\z"
PLAIN_DECIMAL = r"^-?\d+(?:\.\d+)?\z"
MONEY_DECIMAL = r"^-?\$?€?£?" + WS + r"?\d{1,3}(?:,\d{3})*(?:\.\d+)?\z|^-?\d+(?:\.\d+)?\z"
MONEY_SYMBOL = r"[$€£]"
BOOLEAN_WORD = r"(?i)^(?:true|false|yes|no)\z"
TRUE_WORD = r"(?i)^(?:true|yes)\z"
FALSE_WORD = r"(?i)^(?:false|no)\z"
ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
LONG_TEXT_CHARS = 120
NUMERIC_TYPES = ("decimal", "integer")
DATE_TYPES = ("date", "datetime")
NESTED_TYPES = ("object", "array")

# Confidence bands and scores.
HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.6
USABLE_CONFIDENCE = 0.75

# Words that make a field important, and the types that make it material.
IMPORTANT_WORDS = (
    "name", "title", "owner", "customer", "client", "company", "project", "ticket", "status",
    "priority", "date", "budget", "currency", "total", "amount", "hours",
)
MATERIAL_TYPES = ("decimal", "integer", "currency", "date")

# Date-order rule: what counts as a start and as an end date.  The boundaries are ASCII ones.
B_LEFT = r"(?<![A-Za-z0-9_])"
B_RIGHT = r"(?![A-Za-z0-9_])"
START_DATE = (
    B_LEFT + r"(?:start|begin|effective|from).*date" + B_RIGHT
    + "|" + B_LEFT + r"start(?:date)?" + B_RIGHT
)
END_DATE = (
    B_LEFT + r"(?:end|target|due|renewal|expiry|expiration|to).*date" + B_RIGHT
    + "|" + B_LEFT + r"(?:due|target|end)(?:date)?" + B_RIGHT
)

# Issue priority weights.
VALIDATION_WEIGHT = {"invalid": 100, "warning": 20}
CONFIDENCE_WEIGHT = {"conflicting": 60, "missing": 50, "low": 25, "inferred": 12, "medium": 10}
REQUIRED_WEIGHT = 20
MATERIAL_WEIGHT = 15

# Least text a costlier pass can work on.
MIN_INPUT_CHARS = 8

# Failure codes after which a retry is pointless.
NON_RETRYABLE = ("UNSUPPORTED_FIXTURE", "UNSUPPORTED_FILE", "OCR_REQUIRED", "EMPTY_DOCUMENT")

# Contact details.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = (
    r"(?:\+\d{1,3}[" + WS_CHARS + r".-]?)?(?:\(?\d{2,4}\)?[" + WS_CHARS + r".-]?)?"
    r"\d{3,5}[" + WS_CHARS + r".-]?\d{3,5}"
)
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[^" + WS_CHARS + r"|,;]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[^" + WS_CHARS + r"|,;]+"

# Periods such as "Jan 2020 - Present".
MONTH = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?" + WS + r"+)?"
YEAR = r"(?:19|20)\d{2}"
DATE_RANGE = (
    r"(?i)" + B_LEFT + MONTH + YEAR + B_RIGHT + WS + r"*(?:[-–—]|to)" + WS
    + r"*(?:Present|Current|" + MONTH + YEAR + r")"
)

# Request tagging.
AMOUNT = r"\$?€?([0-9][0-9,]*(?:\.[0-9]+)?)"
STOPWORDS = (
    "show", "me", "all", "everything", "find", "list", "documents", "document", "docs", "doc",
    "invoices", "invoice", "with", "the", "and", "from", "vendor", "amount", "amounts", "total",
    "than", "in", "of", "a", "an", "that", "are", "is", "above", "over", "below", "under",
    "greater", "less", "more", "between", "at", "least", "most", "approved", "pending", "needs",
    "review", "unapproved", "draft", "after", "before", "no", "mention", "mentions", "mentioning",
    "containing", "contains", "about",
)
CURRENCY_WORDS = (
    "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "pound", "pounds",
)
