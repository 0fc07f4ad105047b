"""Operator 9, benchmark decontamination: prefix-filtered set join of item windows with documents.

A benchmark item is cut into windows of `window` consecutive words (a shorter item is one window).
The words of a window are ordered by rarity, which is the number of documents that hold the word.
A document that contains the window holds all of its words, so a prefix of one word, the rarest, is
necessary; documents are joined with the windows on that word only.  A match of the rare word at a
place fixes where the window would start: the length and positional bounds drop starts outside the
document, and the words there are compared exactly.  Nothing else is ever compared.

Windows are dealt into blocks of at most `block_windows` by a hash, so what is broadcast has a fixed
bound however large the benchmark is; each block is one pass over the documents in their places.
Documents are never shuffled.

Results for odd inputs: null or empty texts have no words and no hits; an item without words has no
windows; an item without an id counts for hits but cannot be listed; repeated rows get the same
result each; an empty benchmark leaves every document clean.
"""

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, alnum_words, text_bytes, without

WINDOW = 10
BLOCK_WINDOWS = 200_000

_ADDED = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:long,end:long>>"


def item_windows(items: DataFrame, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """Distinct (item, window words joined by one blank)."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "text"), strict=True):
                words = alnum_words(text)
                for at in range(max(len(words) - window + 1, min(len(words), 1))):
                    ids.append(name)
                    keys.append(b" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(keys, pa.binary())], names=["item", "key"]
            )

    slim = items.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")
    )
    return slim.mapInArrow(run, "item string, key binary").distinct()


def document_counts(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (bounded) vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        found = Counter()
        for batch in batches:
            for value in text_bytes(batch, "text"):
                found.update(shared.value.intersection(alnum_words(value)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
            names=["word", "n"],
        )

    slim = docs.select(F.col(text).cast("string").alias("text"))
    counts = slim.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


class BlockIndex:
    """Windows of one block, found by their rarest word."""

    def __init__(self, rows, counts: dict[bytes, int]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for item, key in rows:
            self.items[key].append(item)
        self.postings: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for key in self.items:
            words = key.split(b" ")
            rare = min(words, key=lambda w: (counts.get(w, 0), w))
            self.postings[rare].add((words.index(rare), len(words)))
        self.rare = frozenset(self.postings)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places of all window occurrences as (start, end), and the items they belong to."""
        spans, items = [], set()
        if self.rare.isdisjoint(words):
            return spans, items
        for at, word in enumerate(words):
            for offset, length in self.postings.get(word, ()):
                start = at - offset
                if start >= 0 and start + length <= len(words):
                    found = self.items.get(b" ".join(words[start : start + length]))
                    if found is not None:
                        spans.append((start, start + length))
                        items.update(found)
        return spans, items


def merge_spans(spans) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """`docs` with n_words, n_hit, the items found and the word spans they cover, merged."""
    names = ["n_words", "n_hit", "item_ids", "hit_spans"]
    context = docs.sparkSession.sparkContext
    windows = item_windows(items, item_id, item_text, window)
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("item", "key"), F.lit(blocks))
    out = without(docs, names)
    text_of = f"`{text}`"
    for number in range(blocks):
        rows = [(r["item"], bytes(r["key"])) for r in windows.filter(block == number).collect()]
        vocabulary = frozenset(w for _, key in rows for w in key.split(b" "))
        counts = document_counts(docs, text_of, vocabulary) if rows else {}
        index = context.broadcast(BlockIndex(rows, counts))
        first = number == 0

        def convert(index=index, first=first):
            def of(batch):
                before = (
                    None
                    if first
                    else [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
                )
                result = ([], [], [], [])
                for k, value in enumerate(text_bytes(batch, text)):
                    words = alnum_words(value)
                    spans, found = index.value.match(words)
                    if before:
                        spans += [(s["start"], s["end"]) for s in before[3][k]]
                        found.update(before[2][k])
                    found.discard(None)
                    spans = merge_spans(spans)
                    result[0].append(len(words))
                    result[1].append(sum(b - a for a, b in spans))
                    result[2].append(sorted(found))
                    result[3].append([{"start": a, "end": b} for a, b in spans])
                return result

            return of

        if not first:  # the columns of the last block go in and are replaced
            out = _replace_columns(out, names, convert)
        else:
            out = add_columns(out, _ADDED, convert)
    return out


def _replace_columns(df: DataFrame, names: list[str], convert) -> DataFrame:
    fields = df.schema

    def run(batches):
        of = convert()
        for batch in batches:
            values = dict(zip(names, of(batch), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values[f.name], type=f.type) if f.name in values else batch.column(i)
                    for i, f in enumerate(batch.schema)
                ],
                names=batch.schema.names,
            )

    return df.mapInArrow(run, fields)
