"""Operator 1, quality classifier: voting of nearest neighbours among latent-semantic vectors.

A document's terms are its words (hashed), the trigrams of its form (letters become their kind, other
characters stay) and steps of a few ratios such as repeated words.  Weighted by tf-idf they are
projected on the main directions of a labelled sample (a truncated singular value decomposition), which
gives short vectors of length one.  The labelled vectors are broadcast; their number is at most
`sample`, a documented bound.  Every document is compared exactly with all of them, in blocks, by
products of matrices; the `neighbours` most similar vote for their label, weighted by a power of
their similarity.

Nothing is shuffled but the labelled rows.

Results for odd inputs: null and empty texts have the terms of an empty document and are scored like
any other; very long texts count whole; among equally similar neighbours any may vote; repeated rows
get equal results; without labelled rows every score is 0.5; an empty table gives no rows.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, blank_words, text_bytes

SAMPLE = 4000
NEIGHBOURS = 25
RANK = 48
SHARPNESS = 16
BLOCK = 256

WORD_TERMS = 2048
FORM_TERMS = 4096
STEPS = 24
RATIOS = 6
TERMS = WORD_TERMS + FORM_TERMS + STEPS * RATIOS
SEED = 7

_KINDS = np.arange(256, dtype=np.int64)
_KINDS[ord("a") : ord("z") + 1] = ord("a")
_KINDS[ord("A") : ord("Z") + 1] = ord("A")
_KINDS[ord("0") : ord("9") + 1] = ord("0")
_KINDS[128:] = 128


def term_counts(text: bytes | None) -> np.ndarray:
    """Damped counts of the terms of one text; each kind of terms has the same weight in all texts."""
    text = text or b""
    out = np.zeros(TERMS, np.float32)
    words = blank_words(text)
    hashed = np.array([zlib.crc32(w) for w in words], np.int64) % WORD_TERMS
    out[:WORD_TERMS] = np.bincount(hashed, minlength=WORD_TERMS)
    kinds = _KINDS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 2:
        forms = (kinds[:-2] * 16_411 + kinds[1:-1] * 257 + kinds[2:] * 4_099) % FORM_TERMS
        out[WORD_TERMS:-STEPS * RATIOS] = np.bincount(forms, minlength=FORM_TERMS)
    out = np.log1p(out)
    for part in (slice(0, WORD_TERMS), slice(WORD_TERMS, TERMS - STEPS * RATIOS)):
        norm = np.linalg.norm(out[part])
        if norm:
            out[part] /= norm
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = int(np.count_nonzero(kinds == ord("A")))
    letters = int(np.count_nonzero((kinds == ord("A")) | (kinds == ord("a")) | (kinds >= 128)))
    ratios = (
        np.log2(n + 1) / 16,
        len(set(words)) / n if n else 0.0,
        len(set(lines)) / len(lines) if lines else 0.0,
        (len(text) - n) / n / 16 if n else 0.0,
        upper / letters if letters else 0.0,
        letters / len(text) if text else 0.0,
    )
    for k, ratio in enumerate(ratios):
        step = int(min(max(ratio, 0.0), 1.0) * (STEPS - 1))
        out[TERMS - STEPS * (RATIOS - k) + step] = 0.5
    return out


def packed(counts: np.ndarray) -> bytes:
    """The places of the counts that are not zero, then their values: at most 6 bytes a term."""
    at = np.flatnonzero(counts).astype(np.uint16)
    return at.tobytes() + counts[at].tobytes()


def unpack(terms: bytes, out: np.ndarray) -> None:
    """Set a row of zeros to packed counts."""
    n = len(terms) // 6
    out[np.frombuffer(terms, np.uint16, n)] = np.frombuffer(terms, np.float32, n, offset=2 * n)


class LatentVectors:
    """Term weights, directions, and the labelled vectors with their labels."""

    def __init__(self, terms: list[bytes], labels: list[int], rank: int = RANK):
        self.labels = np.array(labels, np.float32)
        if not terms:
            return
        counts = np.zeros((len(terms), TERMS), np.float32)
        for k, own in enumerate(terms):
            unpack(own, counts[k])
        held = np.count_nonzero(counts, axis=0)
        self.weights = np.log((len(terms) + 1) / (held + 1)).astype(np.float32) + 0.1
        counts *= self.weights
        self.directions = _directions(counts, min(rank, len(terms)))
        self.vectors = unit_rows(counts @ self.directions)

    def project(self, texts: list[bytes | None]) -> np.ndarray:
        counts = np.stack([term_counts(t) for t in texts])
        return unit_rows((counts * self.weights) @ self.directions)

    def votes(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        """The share of similarity that the neighbours with label 1 hold."""
        cosines = vectors @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _directions(rows: np.ndarray, rank: int) -> np.ndarray:
    """Main directions of the rows, by subspace iteration from a fixed start."""
    start = np.random.default_rng(SEED).standard_normal((rows.shape[1], rank + 8)).astype(np.float32)
    basis = start
    for _ in range(3):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    sample: int = SAMPLE,
) -> LatentVectors:
    """Learn from at most `sample` of the labels (key, label), those whose key hashes lowest.

    They are chosen by key alone; their number is bounded, so they are broadcast to the documents.  Tasks
    count the terms, so that rows of a bounded size come to the driver, in a fixed order.  Where documents
    share a key, the one whose packed terms are least is learned.
    """
    own = labels.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("_label"))
    chosen = (
        own.distinct().join(docs.select(key).distinct(), key).orderBy(F.xxhash64(key), key, "_label").limit(sample)
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = (
        docs.select(key, F.col(text).cast("binary").alias("_text"))
        .join(F.broadcast(chosen), key)
        .select(key, "_label", "_text")
    )

    def counter():
        return lambda batch: [[packed(term_counts(t)) for t in text_bytes(batch, "_text")]]

    rows = (
        add_columns(texts, "_terms binary", counter)
        .groupBy(key, "_label")
        .agg(F.min("_terms").alias("_terms"))
        .orderBy(F.xxhash64(key), key, "_label")
        .select("_terms", "_label")
        .collect()
    )
    return LatentVectors([r["_terms"] for r in rows], [r["_label"] for r in rows])


def score(
    docs: DataFrame, model: LatentVectors, *, text: str = "text", neighbours: int = NEIGHBOURS
) -> DataFrame:
    """`docs` with the share of the vote for label 1, `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        def of(batch):
            texts = text_bytes(batch, text)
            own = shared.value
            if not len(own.labels):
                return [[0.5] * len(texts)]
            out: list[float] = []
            for at in range(0, len(texts), BLOCK):
                votes = own.votes(own.project(texts[at : at + BLOCK]), neighbours)
                out += np.clip(votes.astype(float), 0, 1).tolist()
            return [out]

        return of

    return add_columns(docs, "score double", scorer)
