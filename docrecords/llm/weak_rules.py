"""Operator 10, quality rules: weak supervision in place of a filter that every rule must pass.

Each rule votes for or against a document or abstains.  Expectation-maximisation over the table of
vote patterns (at most 3 ** rules rows, whatever the number of documents) estimates how often each
rule votes for, against or not at all on good and on bad documents; the posterior probability that a
document is good follows from its votes.  A rule's vote may never count against its own meaning: a
vote for is kept at odds of one or more, a vote against at one or less.

Everything on rows is built from column functions; only the pattern counts come to the driver.

Results for odd inputs: null and empty texts have no words and fail the base test; very long texts
are linear in memory and sorted by window hash, n log n in time; repeated rows get equal results; an
empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_stage, without

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_WORDS = 50
PRIOR_GOOD = 0.8
ROUNDS = 50
KEEP_AT = 0.5
ANCHOR = 1.0

# Where the estimate starts: for each vote, its probability on good and on bad documents.  A bad
# document shows some of the faults, a good one hardly any.
BOTH_WAYS = {1: (0.75, 0.45), 0: (0.002, 0.15), None: (0.248, 0.40)}
FAULT = {1: (1e-6, 1e-6), 0: (0.002, 0.15), None: (0.998, 0.85)}
VOTES_FOR = ("length", "word_length")

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _votes(good: Column | None, bad: Column) -> Column:
    """0 against, 1 for, null where the rule abstains or its ratio is undefined."""
    vote = F.when(bad, 0)
    return (vote if good is None else vote.when(good, 1)).cast("int")


# Each rule: its name and its vote from the measured columns.  Ordinary length speaks for a document.
# The other rules each look for one fault; its absence says little about the rest, so they abstain.
RULES = {
    "length": lambda c: _votes(c["n_words"] >= 100, c["n_words"] < MIN_WORDS),
    "word_length": lambda c: _votes(
        (m := _share(c["word_chars"], c["n_words"])).between(3, 10), (m < 2) | (m > 15)
    ),
    "symbols": lambda c: _votes(None, _share(c["n_symbols"], c["n_words"]) > 0.1),
    "marks": lambda c: _votes(None, _share(c["n_marks"], c["word_chars"]) > 0.12),
    "dup_lines": lambda c: _votes(None, _share(c["n_dup_lines"], c["n_lines"]) > 0.4),
    "repeats": lambda c: _votes(None, _share(c["n_repeat_words"], c["n_words"]) > 0.4),
    "capitals": lambda c: _votes(None, _share(c["n_capitals"], c["word_chars"]) > 0.4),
    "shouts": lambda c: _votes(None, _share(c["n_shouts"], c["n_words"]) > 0.2),
    "digits": lambda c: _votes(None, _share(c["n_digits"], c["word_chars"]) > 0.3),
}


def _without_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts the rules look at, under the names of `BASE` and `_measures`."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    inner = F.trim(body, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    names = [*BASE, "_body", "_words", "_lines", "_sorted", "_repeat", *_MEASURES]
    df = without(docs, names) if text not in names else docs
    df = df.withColumn("_body", body)
    df = df.withColumns(
        {
            "_words": F.when(inner == "", none).otherwise(F.split(inner, BLANK_RUN)),
            "_lines": F.filter(
                F.split("_body", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != ""
            ),
        }
    )
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    df = df.withColumn("_sorted", F.sort_array(windows))
    again = F.filter(
        "_sorted",
        lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"])
        | (x["h"] == F.get("_sorted", k + 1)["h"]),
    )
    df = df.withColumn("_repeat", F.transform(again, lambda x: x["i"]))
    covered = F.array_distinct(
        F.flatten(F.transform("_repeat", lambda i: F.array(i, i + 1, i + 2)))
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length("_body") - _without_chars(F.col("_body"), BLANKS),
        "n_symbols": _without_chars(F.col("_body"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.size(covered),
        "n_lines": F.size("_lines"),
        "n_capitals": _without_chars(F.col("_body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shouts": _without_chars(F.col("_body"), "!?"),
        "n_marks": _without_chars(F.col("_body"), MARKS),
        "n_digits": _without_chars(F.col("_body"), "0123456789"),
    }
    df = df.withColumns({k: v.cast("long") for k, v in counts.items()})
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ).drop("_body", "_words", "_lines", "_sorted", "_repeat")


_MEASURES = ["n_lines", "n_capitals", "n_shouts", "n_marks", "n_digits"]


def fit(patterns: dict[tuple, int], start: list[dict], rounds: int = ROUNDS) -> tuple[float, list]:
    """Log prior odds of good, and for each rule {vote: log odds} from counts of vote patterns.

    Starts from the votes' meaning, which also stays in the estimate with `ANCHOR` times the weight of
    the documents, whatever their number, so that the two classes cannot change places.  Without
    documents the start itself is returned.
    """
    prior, tables = PRIOR_GOOD, start
    anchor = ANCHOR * sum(patterns.values())
    for _ in range(rounds if anchor else 0):
        good_all, bad_all = anchor * PRIOR_GOOD, anchor * (1 - PRIOR_GOOD)
        sums = [
            {v: [good_all * p[0], bad_all * p[1]] for v, p in table.items()} for table in start
        ]
        odds = _log_odds(prior, tables)
        for votes, n in patterns.items():
            q = _posterior(odds, votes)
            good_all += n * q
            bad_all += n * (1 - q)
            for table, vote in zip(sums, votes, strict=True):
                table[vote][0] += n * q
                table[vote][1] += n * (1 - q)
        prior = good_all / (good_all + bad_all)
        tables = []
        for table in sums:
            good = sum(p[0] for p in table.values())
            bad = sum(p[1] for p in table.values())
            tables.append({v: (p[0] / good, p[1] / bad) for v, p in table.items()})
    return _log_odds(prior, tables)


def _log_odds(prior: float, tables: list) -> tuple[float, list]:
    odds = []
    for table in tables:
        row = {v: math.log(g / b) for v, (g, b) in table.items()}
        odds.append({1: max(row[1], 0.0), 0: min(row[0], 0.0), None: row[None]})
    return math.log(prior / (1 - prior)), odds


def _posterior(odds: tuple[float, list], votes: tuple) -> float:
    total = odds[0] + sum(row[v] for row, v in zip(odds[1], votes, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def quality_votes(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with the measured counts, the votes, the posterior and the verdict `kept`.

    The votes are read twice, to learn and to judge, so they are written as a table once; without
    `keep_text` the texts are not among its columns.
    """
    votes = [f"vote_{name}" for name in RULES]
    counted = measured(docs, text)
    counted = without(counted, [*votes, "quality_posterior", "kept"])
    voted = counted.withColumns({f"vote_{k}": rule(counted) for k, rule in RULES.items()})
    voted = shared_stage(voted if keep_text else voted.drop(text), "votes")
    rows = voted.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    patterns = {tuple(r[v] for v in votes): r["n"] for r in rows}
    prior, odds = fit(patterns, [BOTH_WAYS if name in VOTES_FOR else FAULT for name in RULES])
    total = F.lit(prior)
    for vote, row in zip(votes, odds, strict=True):
        total = total + F.when(F.col(vote) == 1, row[1]).when(F.col(vote) == 0, row[0]).otherwise(row[None])
    return voted.withColumn("quality_posterior", 1 / (1 + F.exp(-total))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_posterior") >= KEEP_AT)
    )
