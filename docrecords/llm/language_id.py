"""Operator 4, language identification: word first, then backoff over character n-grams.

Learning counts every word of every training text per language, in one pass that combines counts in
each task before they are shuffled.  A model has a bounded size, set by parameters, so that it can be
broadcast: for each language its most frequent words, with their counts in all languages, and its most
frequent character n-grams of each length, counted over all words.

A known word scores by its log frequency in each language.  For an unseen word every place of the
word, with marks at its ends, takes the longest n-gram of the model that begins there, from
`longest` characters down to one; the mean over the places is the word's score.  The language with the
largest sum is predicted.  The score is that language's share after a softmax over the mean per word,
times the number of words but ten at most.

Results for odd inputs: a null text, or one without a letter, is `und` with score 0, as is any text
when nothing could be learned; long texts count whole; ties go to the first language in sort order;
repeated rows get equal results; an empty table gives no rows.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, shared_stage

WORDS_TOTAL = 80_000
GRAMS_TOTAL = 60_000
LONGEST = 4
FLUSH_AT = 200_000
SMOOTH = 0.5
UNKNOWN = "und"
SURE_WORDS = 10

_SEPARATORS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A or b == 0x27 else 0x20 for b in range(256)
)


def letter_words(text: str) -> list[bytes]:
    """Lower-case words: runs without ASCII characters other than letters and apostrophes."""
    return text.lower().encode().translate(_SEPARATORS).split()


def _flush(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.binary()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        names=["lang", "gram", "n"],
    )


_COUNTS = "lang string, gram binary, n long"


def count_words(train: DataFrame) -> DataFrame:
    """(lang, word, n) over (lang, text) rows."""

    def run(batches):
        counts: dict[str, Counter] = {}
        held = 0

        def drain():
            flat = Counter({(lang, w): n for lang, c in counts.items() for w, n in c.items()})
            counts.clear()
            return _flush(flat)

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts.setdefault(lang, Counter())
                before = len(own)
                own.update(letter_words(text))
                held += len(own) - before
                if held > FLUSH_AT:
                    yield drain()
                    held = 0
        yield drain()

    return train.mapInArrow(run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def word_grams(word: str, longest: int):
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for n in range(1, longest + 1) for i in range(len(marked) - n + 1)]


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    """(lang, n-gram, n) over all words with their counts; the ends of words are marked."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram in word_grams(word.decode(errors="replace"), longest):
                    counts[lang, gram] += n
                if len(counts) > FLUSH_AT:
                    yield _flush(Counter({(a, g.encode()): n for (a, g), n in counts.items()}))
                    counts.clear()
        yield _flush(Counter({(a, g.encode()): n for (a, g), n in counts.items()}))

    return (
        words.mapInArrow(run, _COUNTS)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("length", F.char_length(F.col("gram").cast("string")))
    )


def _most_frequent(counts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The `limit` most frequent entries of each group, with their counts in all languages."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= limit).select("gram").distinct()
    return counts.join(top, "gram", "left_semi")


class LanguageModel:
    """Tables of log frequencies; a row for each known word or n-gram, a column for each language."""

    def __init__(self, languages: list[str], longest: int):
        self.languages, self.longest = languages, longest
        self.words: dict[bytes, int] = {}
        self.grams: dict[str, int] = {}

    @staticmethod
    def _table(rows, totals: np.ndarray, place: dict) -> tuple[dict, np.ndarray]:
        index: dict = {}
        entries = [(index.setdefault(g, len(index)), place[lang], n) for lang, g, n in rows]
        counts = np.full((len(index), len(place)), SMOOTH)
        for at, lang, n in entries:
            counts[at, lang] += n
        return index, np.log(counts / (totals + SMOOTH * (len(index) + 1)))

    def set_words(self, rows, totals) -> None:
        place = {lang: k for k, lang in enumerate(self.languages)}
        self.words, self.word_scores = self._table(rows, totals, place)

    def set_grams(self, rows, totals) -> None:
        place = {lang: k for k, lang in enumerate(self.languages)}
        self.grams, self.gram_scores = self._table(rows, totals, place)
        self.floor = np.log(SMOOTH / (totals + SMOOTH * (len(self.grams) + 1)))

    def unseen(self, word: bytes) -> np.ndarray:
        marked = f"\x02{word.decode(errors='replace')}\x03"
        total = np.zeros(len(self.languages))
        for i in range(len(marked)):
            for n in range(min(self.longest, len(marked) - i), 0, -1):
                at = self.grams.get(marked[i : i + n])
                if at is not None:
                    total += self.gram_scores[at]
                    break
            else:
                total += self.floor
        return total / len(marked)


def fit(
    train: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    words_total: int = WORDS_TOTAL,
    grams_total: int = GRAMS_TOTAL,
    longest: int = LONGEST,
) -> LanguageModel:
    """Learn from all rows whose text and language are not null.

    The model has at most `words_total` words and `grams_total` n-grams over all languages.
    """
    known = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    slim = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = shared_stage(count_words(slim), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    model = LanguageModel(languages, longest)
    if not languages:
        return model
    total = np.array([totals[x] for x in languages], float)
    words = _most_frequent(counts, ["lang"], max(1, words_total // len(languages)))
    model.set_words(((r["lang"], bytes(r["gram"]), r["n"]) for r in words.collect()), total)
    grams = shared_stage(count_grams(counts, longest), "grams")
    top = _most_frequent(
        grams, ["lang", "length"], max(1, grams_total // len(languages) // longest)
    )
    sums = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_totals = np.array([sums[x] for x in languages], float) / longest
    model.set_grams(
        ((r["lang"], bytes(r["gram"]).decode(), r["n"]) for r in top.collect()), gram_totals
    )
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        own: LanguageModel = shared.value
        memory: dict[bytes, np.ndarray] = {}

        def unseen(word):
            row = memory.get(word)
            if row is None:
                row = own.unseen(word)
                if len(memory) < FLUSH_AT:
                    memory[word] = row
            return row

        def of(batch):
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [_score(own, unseen, value) for value in values]
            return [[f[0] for f in found], [f[1] for f in found]]

        return of

    return add_columns(docs, "lang_pred string, score double", scorer)


def _score(model: LanguageModel, unseen, text: str | None) -> tuple[str, float]:
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    counts = Counter(letter_words(text))
    if not counts:
        return UNKNOWN, 0.0
    rows = [model.words.get(w, -1) for w in counts]
    at = np.array(rows)
    n = np.fromiter(counts.values(), float, len(rows))
    known = at >= 0
    total = n[known] @ model.word_scores[at[known]]
    for word, (k, row) in zip(counts, enumerate(rows), strict=True):
        if row < 0:
            total = total + n[k] * unseen(word)
    words = n.sum()
    best = int(total.argmax())
    share = np.exp((total - total[best]) / words * min(words, SURE_WORDS))
    score = float(1 / share.sum())
    return model.languages[best], score if math.isfinite(score) else 0.0


def accepted(min_score: float = 0.5) -> Column:
    """Documents whose language is known with some certainty."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
