"""Operator 12, SimHash near duplicates with pivot distance tables.

A fingerprint's bit is 1 where it is set in over half of the XXH64 values of the text's three-word shingles.
Fingerprints of `most` or fewer differing bits link; a document's component is named by its least id.

Where pairs can meet.  Distances of unrelated fingerprints to any reference lie within 32 +- 4, so a grid over
such distances keeps about half of all pairs for each coordinate and cannot deal out the work alone.  The
64 bits are therefore cut into `blocks` blocks.  At most `most` of them differ between linked fingerprints, so
these agree on some choice of `blocks` - `most` blocks, and a bucket for each choice and value holds every
link.  The number of blocks follows from the number of fingerprints, so that buckets of unrelated ones stay
small; any number gives the same result.

Pivot tables.  A bucket's members get the table of their Hamming distances to the 64 rows of a Hadamard
matrix.  By the triangle inequality linked members differ by at most `most` in every coordinate.  Pairs are
formed only between members whose first coordinates allow it, and the others discard them one after the
other.  The rows being orthogonal, the squared differences of two tables sum to 64 times the distance, so no
pair of a distance of 10 or more survives 3 in all coordinates.  Survivors are verified by their bits.

Skew.  Equal fingerprints are one node before anything is joined.  A bucket is dealt into parts of about
`PART` members, and two parts meet in one unit of work.  A unit joins what it finds as it goes, forms no
pairs of members already joined, and returns at most one link for each member.

Results for odd inputs: null texts and texts without words have fingerprint zero and link like any other;
fewer words than three are one shingle; repeated rows are in one component; a null id never names a
component, which has none (null) if no member has an id; an empty table gives no rows; other columns are not
read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, blank_words, shared_stage, text_bytes
from .components import components

WORDS = 3
SEED = 42
MOST = 3
PART = 4096
PAIRS_AT_ONCE = 400_000
# Unrelated members a bucket may have on average before more blocks are taken.
BUCKET_MEMBERS = 64


def hadamard() -> np.ndarray:
    """64 reference fingerprints, any two of which differ in 32 bits."""
    rows = np.arange(64, dtype=np.uint64)
    bits = np.bitwise_count(rows[:, None] & rows[None, :]).astype(np.uint64) & np.uint64(1)
    return (bits << rows[None, :]).sum(axis=1, dtype=np.uint64)


REFERENCES = hadamard()


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number; 0 without words."""
    said = blank_words(text)
    if not said:
        return 0
    line = b" ".join(said)
    ends = np.cumsum([len(w) + 1 for w in said]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(words, len(said)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)]
    ones = np.zeros(64, np.int64)
    step = 65536  # bits of a very long text are counted a stretch at a time
    for k in range(0, len(hashes), step):
        part = np.array(hashes[k : k + step], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, text: str = "text", name: str = "node", words: int = WORDS) -> DataFrame:
    """`docs` with the fingerprint of each text as a signed long in place of the text."""

    def rows():
        def convert(batch):
            values = [fingerprint(t, words) for t in text_bytes(batch, text)]
            return [np.array(values, np.uint64).view(np.int64)]

        return convert

    return add_columns(docs, f"{name} long", rows).drop(text)


def bit_blocks(n: int, most: int) -> list[int]:
    """Masks of the blocks for n fingerprints: the fewest blocks that keep unrelated buckets small."""
    for blocks in range(most + 1, 65):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        widths = sorted(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
        if n <= BUCKET_MEMBERS << sum(widths[: blocks - most]) or blocks == 2 * most + 2:
            return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    raise ValueError("more differing bits than blocks")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Join the labels of the pairs (x, y) and return the pairs that joined two labels, one for each joining."""
    used = []
    while True:
        differ = label[x] != label[y]
        x, y = x[differ], y[differ]
        if not len(x):
            return used
        # Each label above another one takes the least of its partners; one pair for each such label.
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]
        used += zip(x[first].tolist(), y[first].tolist(), strict=True)
        parent = np.arange(len(label))
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


def linked(nodes: np.ndarray, unit: np.ndarray, part: np.ndarray, apart: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links (places of two members) that join all members of a unit that links join: fewer than members.

    `unit` numbers the units; where `apart` is set only links between parts count, as those within a part
    are found in a unit of their own.
    """
    table = np.bitwise_count(nodes[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    key = unit.astype(np.int64) * (64 + most + 1) + table[:, 1]
    order = np.argsort(key, kind="stable")
    key, nodes, part, apart = key[order], nodes[order], part[order], apart[order]
    table = np.ascontiguousarray(table[order].T)
    # Behind a member come those of its unit whose first coordinate is at most `most` larger.
    width = np.searchsorted(key, key + most, "right") - np.arange(len(key)) - 1
    ahead = np.concatenate([[0], np.cumsum(width)])
    label = np.arange(len(key))
    found = []
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + PAIRS_AT_ONCE, "right")) - 1)
        x = np.repeat(np.arange(i, j), width[i:j])
        y = x + 1 + np.arange(len(x)) - np.repeat(ahead[i:j] - ahead[i], width[i:j])
        keep = (label[x] != label[y]) & (~apart[x] | (part[x] != part[y]))
        x, y = x[keep], y[keep]
        for k, coordinate in enumerate(table):
            if k != 1 and len(x):
                keep = np.abs(coordinate[x] - coordinate[y]) <= most
                x, y = x[keep], y[keep]
        near = np.bitwise_count(nodes[x] ^ nodes[y]) <= most
        found += _joined(label, x[near], y[near])
        i = j
    return [(int(order[a]), int(order[b])) for a, b in found]


def links(nodes: DataFrame, *, most: int = MOST) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints `nodes.node` that links join."""
    masks = bit_blocks(nodes.count(), most)
    choices = [_signed(sum(c)) for c in combinations(masks, len(masks) - most)]
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(m).alias("mask")) for k, m in enumerate(choices)]))
    rows = nodes.select("node", choice.alias("c")).select(
        "node", F.col("c.choice").alias("choice"), F.col("node").bitwiseAND(F.col("c.mask")).alias("bits")
    )
    sizes = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # A row for each part that the member's own part meets; nearly all buckets are one part.
    meets = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    units = (
        rows.join(sizes.select("choice", "bits", parts.alias("parts")), ["choice", "bits"])
        .withColumn("part", part)
        .select("choice", "bits", "node", "part", meets)
        .select("choice", "bits", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "part")
    )

    def pairs(held: np.ndarray) -> pa.RecordBatch:
        low, high, node, own = held[2:]
        new = np.ones(held.shape[1], bool)
        new[1:] = (held[:4, 1:] != held[:4, :-1]).any(axis=0)
        found = linked(node.view(np.uint64), np.cumsum(new), own, low != high, most)
        a, b = (node[np.array([p[k] for p in found], np.int64)] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = np.empty((6, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(6)])], axis=1)
            if not held.shape[1]:
                continue
            # The last unit may go on in the next batch.
            ended = np.flatnonzero((held[:4] != held[:4, -1:]).any(axis=0))
            if len(ended):
                yield pairs(np.ascontiguousarray(held[:, : ended[-1] + 1]))
                held = held[:, ended[-1] + 1 :]
        if held.shape[1]:
            yield pairs(np.ascontiguousarray(held))

    key = ["choice", "bits", "low", "high"]
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the least id that links reach, for every document."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = shared_stage(fingerprints(slim, words=words), "fingerprints")
    nodes = shared_stage(marked.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = components(shared_stage(links(nodes, most=most), "links"))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = labelled.join(least, "label").select("node", "component_id")
    return marked.join(by_node, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )
