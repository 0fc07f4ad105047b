"""Operator 6, language-model scoring: likelihood of a subword lattice.

The pieces and scores of an existing vocabulary weight all segmentations of a token into pieces.
A text is its tokens and one end; a piece never crosses a token's blank, so the probability of a text is
the product over its tokens of the sum over the token's segmentations, which a forward recursion in log
space gives.  Pieces are byte strings (byte pieces included), so every text has a segmentation.

A merge-based vocabulary scores pieces by rank; a piece of rank r then starts with weight 1 / (r +
RANK_SHIFT).  From there one step of expectation-maximisation over the training words (forward and
backward, all segmentations) gives the probabilities; it moves as many numbers as there are pieces.

Words are counted in one pass that combines within tasks.  The counts, one row for each distinct word,
grow with the corpus and stay a table.  The most frequent words, at most `head_words`, are broadcast
with their counts and probabilities; the other tokens of a document meet the table in a join, where no
word is frequent.

Results for odd inputs: null and empty texts have the end alone; a very long word takes a recursion of
its own, linear in its length; a null id is held out; repeated rows are scored each on their own; with
nothing to learn from, counts are 0 and the start weights are used; an empty table gives no rows.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, shared_stage, text_bytes

RANK_SHIFT = 10
HEAD_WORDS = 100_000
FLUSH_AT = 200_000
LONG_WORD = 48
SMOOTH = 1e-3
ADD = 0.1
LN10 = math.log(10)
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf


def vocabulary(path: str) -> dict[bytes, float]:
    """Start weights of the pieces, as byte strings with a blank for the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k)
        key = bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        pieces[key] = pieces.get(key, 0.0) + 1 / (RANK_SHIFT - min(model.get_score(k), 0.0))
    for b in range(256):
        pieces.setdefault(bytes([b]), 1 / (RANK_SHIFT + len(pieces)))
    return pieces


class Lattice:
    """Log probabilities of pieces, looked up by hash for each length; `ids` number the pieces."""

    def __init__(self, weights: dict[bytes, float], end: float):
        """`end` is the probability of the end; the pieces share the rest by their weights."""
        total = sum(weights.values())
        self.pieces = sorted(weights)
        self.log_end = math.log(end)
        scale = math.log1p(-end) - math.log(total)
        self.tables = {}
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(self.pieces):
            by_length.setdefault(len(piece), []).append(k)
        for length, ids in sorted(by_length.items()):
            rows = np.frombuffer(b"".join(self.pieces[k] for k in ids), np.uint8).reshape(-1, length)
            keys = _hashes(rows, length)[:, 0]
            order = keys.argsort()
            logs = np.array([math.log(weights[self.pieces[k]]) + scale for k in ids])
            self.tables[length] = (keys[order], np.array(ids)[order], logs[order])

    def _arcs(self, rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length, the id and log probability of the piece at every start, -inf for none."""
        arcs = {}
        hashed = None
        for length in range(1, min(rows.shape[1], max(self.tables)) + 1):
            hashed = _extend(hashed, rows, length)
            if length not in self.tables:
                continue
            keys, ids, logs = self.tables[length]
            at = np.minimum(keys.searchsorted(hashed), len(keys) - 1)
            hit = keys[at] == hashed
            if hit.any():
                arcs[length] = (ids[at], np.where(hit, logs[at], _NONE))
        return arcs

    def forward(self, rows: np.ndarray, arcs) -> np.ndarray:
        n = rows.shape[1]
        alpha = np.full((len(rows), n + 1), _NONE)
        alpha[:, 0] = 0
        for end in range(1, n + 1):
            for length, (_, logs) in arcs.items():
                if length <= end:
                    start = end - length
                    alpha[:, end] = np.logaddexp(alpha[:, end], alpha[:, start] + logs[:, start])
        return alpha

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word, a blank before it, over all segmentations."""
        out = np.empty(len(words))
        for at, rows in _by_length(words):
            if rows.shape[1] > LONG_WORD:
                out[at] = [self._long_word(row) for row in rows]
            else:
                out[at] = self.forward(rows, self._arcs(rows))[:, -1]
        return out

    def _long_word(self, row: np.ndarray) -> float:
        arcs = self._arcs(row[None, :])
        table = np.full((len(row), max(arcs)), _NONE)
        for length, (_, logs) in arcs.items():
            table[: len(row) - length + 1, length - 1] = logs[0]
        width = table.shape[1]
        alpha = np.full(len(row) + width + 1, _NONE)
        alpha[0] = 0
        for start in range(len(row)):
            reached = alpha[start + 1 : start + 1 + width]
            np.logaddexp(reached, alpha[start] + table[start], out=reached)
        return float(alpha[len(row)])

    def expected(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations of the counted words."""
        total = np.zeros(len(self.pieces))
        counted = np.array(counts, float)
        for at, rows in _by_length(words):
            for k in range(0, len(rows), 2048 if rows.shape[1] <= LONG_WORD else 1):
                step = slice(k, k + (2048 if rows.shape[1] <= LONG_WORD else 1))
                self._add_expected(rows[step], counted[at][step], total)
        return total

    def _add_expected(self, rows, counted, total) -> None:
        arcs = self._arcs(rows)
        alpha = self.forward(rows, arcs)
        n = rows.shape[1]
        beta = np.full((len(rows), n + 1), _NONE)
        beta[:, n] = 0
        for start in range(n - 1, -1, -1):
            for length, (_, logs) in arcs.items():
                if start + length <= n:
                    beta[:, start] = np.logaddexp(beta[:, start], logs[:, start] + beta[:, start + length])
        log_all = alpha[:, n : n + 1]
        for length, (ids, logs) in arcs.items():
            share = np.exp(alpha[:, : n - length + 1] + logs + beta[:, length:] - log_all)
            share *= counted[:, None]
            hit = logs > _NONE
            total += np.bincount(ids[hit], share[hit], minlength=len(total))


def _extend(hashed, rows: np.ndarray, length: int) -> np.ndarray:
    tail = rows[:, length - 1 :].astype(np.uint64) + np.uint64(1)
    return tail if hashed is None else hashed[:, : tail.shape[1]] * _P + tail


def _hashes(rows: np.ndarray, length: int) -> np.ndarray:
    hashed = None
    for n in range(1, length + 1):
        hashed = _extend(hashed, rows, n)
    return hashed


def _by_length(words: list[bytes]):
    """(places, byte rows) for each length; a blank stands before every word."""
    places: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(len(word), []).append(k)
    for length, at in places.items():
        joined = b"".join(b" " + words[k] for k in at)
        yield at, np.frombuffer(joined, np.uint8).reshape(-1, length + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, n): tokens of each word in training texts and in all texts.  Input: train, text."""

    def run(batches):
        counts = (Counter(), Counter())

        def drain():
            words = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array([counts[1][w] for w in words], pa.int64()),
                    pa.array([counts[0][w] + counts[1][w] for w in words], pa.int64()),
                ],
                names=["word", "c", "n"],
            )
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "text"), strict=True):
                counts[train].update(blank_words(text))
                if len(counts[0]) + len(counts[1]) > FLUSH_AT:
                    yield drain()
        yield drain()

    rows = docs.select("train", "text").mapInArrow(run, "word binary, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def estimate(words: DataFrame, start: Lattice, n_ends: int) -> Lattice:
    """Piece probabilities after one step of expectation-maximisation over the training words."""
    shared = words.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        lattice: Lattice = shared.value
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    sums = (
        words.filter(F.col("c") > 0)
        .select("word", "c")
        .mapInArrow(run, "piece long, uses double")
        .groupBy("piece")
        .agg(F.sum("uses").alias("uses"))
        .collect()  # at most a row for each piece of the vocabulary
    )
    uses = {start.pieces[r["piece"]]: r["uses"] for r in sums}
    if not uses:
        return start
    least = SMOOTH
    all_uses = sum(uses.values()) + least * len(start.pieces)
    return Lattice({p: uses.get(p, 0.0) + least for p in start.pieces}, n_ends / (all_uses + n_ends))


def _head_from(words: DataFrame, limit: int) -> int:
    """The least count from which on there are at most `limit` words."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(
        F.floor(F.log2(F.col("n").cast("double")) * 64).cast("long") + 4096
    )
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    held, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["step"]):
        held += row["k"]
        if held > limit:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def lattice_scores(
    docs: DataFrame,
    train: Column,
    vocabulary_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """For each document: tokens, known tokens, training tokens, unigram base score and lattice score."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    words = shared_stage(count_words(slim), "words")
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")
    ).first()
    n_ends = slim.filter("train").count()
    tokens, distinct = sums["c"] + n_ends, sums["v"] + (n_ends > 0)
    below = tokens + ADD * (distinct + 1)
    start = Lattice(vocabulary(vocabulary_path), 0.01)
    shared = context.broadcast(estimate(words, start, n_ends))

    def score_words(batches):
        for batch in batches:
            logs = shared.value.word_logs(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logs / LN10)], names=["word", "c", "n", "log_p"]
            )

    scored = shared_stage(
        words.mapInArrow(score_words, "word binary, c long, n long, log_p double"), "scores"
    )
    head_rows = scored.filter(F.col("n") >= _head_from(words, head_words)).collect()
    head = context.broadcast(
        {bytes(r["word"]): (int(r["c"] > 0), math.log10((r["c"] + ADD) / below), r["log_p"]) for r in head_rows}
    )
    end = (int(n_ends > 0), math.log10((n_ends + ADD) / below), shared.value.log_end / LN10)

    def head_part(batches):
        known_words = head.value
        for batch in batches:
            columns = [[] for _ in range(6)]
            for value in text_bytes(batch, "text"):
                counts = Counter(blank_words(value))
                n, known, base, log_p = 1, *end
                rest, times = [], []
                for word, k in counts.items():
                    n += k
                    row = known_words.get(word)
                    if row is None:
                        rest.append(word)
                        times.append(k)
                    else:
                        known += k * row[0]
                        base += k * row[1]
                        log_p += k * row[2]
                for column, x in zip(columns, (n, known, base, log_p, rest, times), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            kinds += [pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "train", *_PARTS],
            )

    kind = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema.simpleString()[7:-1]
    schema = (
        f"{kind}, train boolean, n_tokens long, n_known long, base_score double, score double, "
        "rest array<binary>, times array<long>"
    )
    parts = shared_stage(
        slim.mapInArrow(head_part, schema).withColumn("row", F.monotonically_increasing_id()), "parts"
    )
    rare = parts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select(
        "row", F.col("t.rest").alias("word"), F.col("t.times").alias("k")
    )
    joined = rare.join(scored.select("word", "c", "log_p"), "word").select(
        "row",
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"),
        (F.col("k") * F.log10((F.col("c") + ADD) / below)).alias("base_score"),
        (F.col("k") * F.col("log_p")).alias("score"),
    )
    sums_of_rest = joined.groupBy("row").agg(
        *[F.sum(c).alias(f"{c}_rest") for c in ("n_known", "base_score", "score")]
    )
    whole = parts.drop("rest", "times").join(sums_of_rest, "row", "left")

    def added(name):
        return (F.col(name) + F.coalesce(F.col(f"{name}_rest"), F.lit(0))).alias(name)

    return whole.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        added("n_known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        added("base_score"),
        added("score"),
    )


_PARTS = ["n_tokens", "n_known", "base_score", "score", "rest", "times"]
