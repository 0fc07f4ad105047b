"""Operator 5, n-gram Jaccard join with PartEnum signatures.

A document's set holds 64-bit hashes of its distinct shingles of `shingle` words.  Two sets link when
their Jaccard similarity is at least `percent` / 100; all comparisons are exact, in whole numbers.

Signatures.  Sizes are cut into bands.  Instance j of the scheme takes the sets of band j and those of
band j-1 large enough to be similar to one of band j, so a similar pair meets in the instance of its
larger set.  There the sets of a pair differ in at most k elements.  The domain is dealt by a hash into
n1 = k // 2 + 1 + SPARE partitions of `parts` parts each.  At most k // 2 partitions hold two
differences or more; any other has at most one, so leaving out one of its parts in turn gives a subset
of parts on which both sets agree.  A signature is the hash of the elements in such a subset.  Subsets
without elements would tie everything together: a set emits them only if more than SPARE of its
partitions have one, as otherwise a partition with a subset that is not empty is left.

Equal sets become one node before anything is joined; a task emits the signatures of a node once.  The
nodes of a signature form a bucket, found by sorting.  A bucket's least node is compared with each
other node (a star, not all pairs); components follow from the links found.  Near copies share many
signatures, so buckets with the same least node are then taken as one: a node is in it once, and two nodes
meet there once.  Where such a bucket still holds
nodes of different components, each node outside its most frequent component is compared with the one
of another component whose sketch is nearest.  What is then still in different components is compared
with each other across the components, which completes the links.  So copies and near copies cost a comparison each, and no link that joins two
components is lost.  Such a bucket is dealt into blocks of about `BLOCK` nodes, and two blocks meet in
one unit of work, so that a unit's memory and time are bounded however large the bucket is.

Comparisons.  Pairs are dropped exactly by their sizes first.  A sketch counts a set's elements in cells of
the leading bits of their hashes: `SKETCH` cells, and for larger sets so many that a cell has `CELL_ITEMS`
elements or fewer on average; the longer of two sketches is folded to the length of the shorter one.  The
differences of two sketches are never more than those of the sets, so pairs whose sketches differ too much
are dropped exactly as well; only for the others are the whole sets made again from the texts and moved.
With every membership of a bucket travels the whole sketch, packed to four bits a cell.  Inside a bucket these are
compared folded `COARSE` times first, and pairs that pass at their full length: only pairs that the whole
sketch allows become rows.
Tables that no later step reads are removed on the way.

Results for odd inputs: null texts and texts without words have no shingles and stay alone; fewer words
than a shingle make one shingle; rows that repeat a document are in its component; a null id counts as
larger than any other; an empty table gives no rows.  Sets are told apart by a 64-bit hash.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, blank_words, forget, shared_stage, text_bytes
from .components import components

SHINGLE = 4
PERCENT = 85
PARTS = 2
SPARE = 2
BAND_RATIO = 1.5
CACHED_WORDS = 200_000
SKETCH = 256
CELL_ITEMS = 4
COARSE = 4
PACKED = 15
BLOCK = 4096
LEADERS = 64
# Numbers of 32 bits whose sum is a whole number as a double; documents worked on and handed on at once.
SUMMED = 2_000_000
AT_ONCE = 500

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizing hash of 64-bit numbers."""
    x = x ^ (x >> _SHIFT)
    x *= _M1
    x ^= x >> _SHIFT
    x *= _M2
    x ^= x >> _SHIFT
    return x


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def shingle_set(text: bytes | None, hashes: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - shingle + 1, 1)
    out = np.full(n, len(h) if len(h) < shingle else shingle, np.uint64)
    for k in range(min(shingle, len(h))):
        out = mixed(out + h[k : k + n] + np.uint64(k))
    return np.unique(out)


def set_key(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).astype(np.int64))


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    """Band j holds the sizes below band_top(j) from the top of the band before."""
    j = 0
    while band_top(j) <= size:
        j += 1
    return j


@lru_cache(maxsize=None)
def band_top(j: int) -> int:
    top = 2
    for _ in range(j):
        top = max(top + 1, int(top * BAND_RATIO))
    return top


@lru_cache(maxsize=100_000)
def instances(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(instance, most differences k) a set of this size takes part in; k = 0 needs none."""
    j = band_of(size)
    found = []
    # Up to the band of the largest set that one of this size can be similar to.
    for instance in range(j, band_of(100 * size // percent) + 1):
        least = 2 if instance == 0 else band_top(instance - 1)
        if instance > j and 100 * size < percent * least:
            continue
        most = 2 * (band_top(instance) - 1)
        k = (100 - percent) * most // (100 + percent)
        if k:
            found.append((instance, k))
    return tuple(found)


def sums_by(part: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit numbers by part, modulo 2^64: the halves' sums are exact as doubles for two million numbers."""
    low = np.bincount(part, values & _LOW, n).astype(np.uint64)
    return low + (np.bincount(part, values >> _HALF, n).astype(np.uint64) << _HALF)


def signatures(shingles: np.ndarray, percent: int = PERCENT, parts: int = PARTS) -> np.ndarray:
    out = []
    for instance, k in instances(len(shingles), percent):
        n1 = k // 2 + 1 + SPARE
        x = mixed(shingles + np.uint64(1 + instance))
        part = (x % np.uint64(n1 * parts)).astype(np.int64)
        elements = mixed(x)
        own = np.zeros(n1 * parts, np.uint64)
        for at in range(0, len(x), SUMMED):
            own += sums_by(part[at : at + SUMMED], elements[at : at + SUMMED], n1 * parts)
        own = own.reshape(n1, parts)
        held = np.bincount(part, minlength=n1 * parts).reshape(n1, parts)
        others = own.sum(axis=1, keepdims=True) - own
        empty = held.sum(axis=1, keepdims=True) == held
        place = np.arange(n1 * parts, dtype=np.uint64).reshape(n1, parts)
        sig = mixed(mixed(others + np.uint64(instance)) + place)
        if empty.any(axis=1).sum() <= SPARE:
            sig = sig[~empty]
        out.append(sig.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(docs: DataFrame, convert, schema: str, shingle: int, *keys: str) -> DataFrame:
    """Rows made from the shingle set of each document: `convert(batch, sets)`.

    Batches are worked on in slices, as a document makes some hundred rows.
    """

    def run(batches):
        hashes = WordHashes()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                sets = [shingle_set(t, hashes, shingle) for t in text_bytes(part, "text")]
                yield convert(part, sets, seen)

    return docs.select(*keys, F.col("text")).mapInArrow(run, schema)


def with_node(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with the node of each row's `text`, null for a text without words."""

    def rows():
        hashes = WordHashes()

        def convert(batch):
            sets = (shingle_set(t, hashes, shingle) for t in text_bytes(batch, "text"))
            return [[set_key(s) if len(s) else None for s in sets]]

        return convert

    return add_columns(docs, f"{name} long", rows)


def sketch(shingles: np.ndarray) -> bytes:
    bits = max(SKETCH.bit_length() - 1, (len(shingles) // CELL_ITEMS).bit_length())
    cells = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(cells: np.ndarray, width: int, most: int = 255) -> np.ndarray:
    """Sketches in rows, with neighbouring cells added up until `width` are left.

    A cell counts to `most`, here as in the sketch, so the result is the sketch of that width.
    """
    if cells.shape[1] == width:
        return cells
    return np.minimum(cells.reshape(len(cells), width, -1).sum(axis=2, dtype=np.int32), most).astype(np.uint8)


def coarse(sketch: bytes) -> bytes:
    return folded(np.frombuffer(sketch, np.uint8).reshape(1, -1), len(sketch) // COARSE).tobytes()


def packed(sketch: bytes) -> bytes:
    """The sketch with two cells to a byte; a cell counts to `PACKED`."""
    cells = np.minimum(np.frombuffer(sketch, np.uint8), PACKED)
    return (cells[::2] << 4 | cells[1::2]).tobytes()


def unpacked(cells: bytes) -> bytes:
    pairs = np.frombuffer(cells, np.uint8)
    return np.stack([pairs >> 4, pairs & PACKED], axis=1).tobytes()


def cells_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed differences of sketches of one width, row by row."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)


def leveled(cells: np.ndarray) -> np.ndarray:
    """Sketches in rows as words of bits: which cells reach the usual count, and which the next one.

    Two counts differ by at least as many as there are levels that only one of them reaches, so differing bits
    never outnumber the differences of the sketches.
    """
    usual = max(1, int(np.median(cells)))
    bits = [np.packbits(cells >= level, axis=1) for level in (usual, usual + 1)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.uint64)


def sketch_distance(x: list[bytes], y: list[bytes], most: int = 255) -> np.ndarray:
    """For pairs of sketches, a number that the sets' differences are never below."""
    lengths = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for one, other in np.unique(lengths, axis=0).tolist():
        every = np.flatnonzero((lengths == (one, other)).all(axis=1))
        step = max(1, 8_000_000 // max(one, other))
        for k in range(0, len(every), step):
            at = every[k : k + step]
            a = np.frombuffer(b"".join([x[i] for i in at]), np.uint8).reshape(len(at), one)
            b = np.frombuffer(b"".join([y[i] for i in at]), np.uint8).reshape(len(at), other)
            width = min(one, other)
            out[at] = cells_apart(folded(a, width, most), folded(b, width, most))
    return out


def _node_rows(batch, sets, seen):
    nodes = [set_key(s) if len(s) else None for s in sets]
    sketches = list(map(sketch, sets))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(map(len, sets), pa.int64()),
            pa.array(nodes, pa.int64()),
            pa.array(sketches, pa.binary()),
            pa.array(map(packed, sketches), pa.binary()),
        ],
        names=["doc_id", "n_shingles", "node", "sketch", "coarse"],  # `coarse`: the packed sketch
    )


def _signature_rows(percent: int, parts: int):
    def convert(batch, sets, seen):
        sigs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for s in sets:
            node = set_key(s) if len(s) else None
            if node is None or node in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(node)
            own = signatures(s, percent, parts)
            sigs.append(own)
            nodes.append(np.full(len(own), node, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))],
            names=["sig", "node"],
        )

    return convert


def bucket_stars(signed: DataFrame) -> DataFrame:
    """(sig, leader, member) for signatures that two nodes or more share; the leader is the least.

    Rows come sorted by (sig, node), so a task keeps one row between batches.
    """

    def run(batches):
        last_sig, leader, last_node = None, None, None
        for batch in batches:
            sig = batch.column(0).to_numpy()
            node = batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.empty(len(sig), bool)
            new[0] = sig[0] != last_sig
            new[1:] = sig[1:] != sig[:-1]
            again = np.zeros(len(sig), bool)
            again[0] = not new[0] and node[0] == last_node
            again[1:] = ~new[1:] & (node[1:] == node[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            lead = np.where(start >= 0, node[np.maximum(start, 0)], leader if leader is not None else 0)
            keep = ~new & ~again
            last_sig, leader, last_node = sig[-1], lead[-1], node[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[keep]), pa.array(lead[keep]), pa.array(node[keep])],
                names=["sig", "leader", "member"],
            )

    sorted_rows = signed.repartition("sig").sortWithinPartitions("sig", "node")
    return sorted_rows.mapInArrow(run, "sig long, leader long, member long")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow a link: sketches move for similar sizes only."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column(2).to_numpy()
            apart = sketch_distance(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            keep = (100 + percent) * apart <= (100 - percent) * total
            yield batch.select([0, 1]).filter(pa.array(keep))

    size = nodes.select("node", "n_shingles").distinct()
    na, nb = F.col("na"), F.col("nb")
    sized = (
        pairs.join(size.toDF("b", "nb"), "b")
        .join(size.toDF("a", "na"), "a")
        .filter(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        .select("a", "b", (na + nb).alias("total"))
    )
    known = nodes.select("node", "sketch").dropDuplicates(["node"])
    both = sized.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    return both.select("a", "b", "total", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.minimum(x.searchsorted(y), len(x) - 1)
                    both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    b_side = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = b_side.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fetch_sets(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The sets of the wanted nodes, each from the text of the node's first document."""
    ids = wanted.join(firsts, "node").select("first_id", "node")

    def convert(batch, sets, seen):
        keep = [len(s) > 0 and set_key(s) == n for s, n in zip(sets, batch.column(0).to_pylist(), strict=True)]
        kept = [s.tobytes() for s, k in zip(sets, keep, strict=True) if k]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(keep, pa.bool_())), pa.array(kept, pa.binary())],
            names=["node", "set"],
        )

    texts = docs.join(ids, docs["doc_id"] == ids["first_id"]).select("node", "text")
    # A null id is larger than any other: such a node has rows without an id only, found by their node.
    nameless = ids.filter(F.col("first_id").isNull()).select("node")
    unnamed = with_node(docs.filter(F.col("doc_id").isNull()), "node", shingle)
    texts = texts.union(unnamed.join(nameless, "node", "left_semi").select("node", "text"))
    return _sets(texts, convert, "node long, set binary", shingle, "node").dropDuplicates(["node"])


def jaccard_links(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, parts: int = PARTS
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the documents (doc_id, n_shingles, node), and links (a, b) that join all similar nodes.

    The links are those that were needed: every pair of similar nodes is joined by a path of them.
    """
    key = docs.select("doc_id").schema.simpleString()[7:-1]
    nodes = shared_stage(
        _sets(docs, _node_rows, f"{key}, n_shingles long, node long, sketch binary, coarse binary", shingle, "doc_id"), "nodes"
    )
    known = nodes.filter(F.col("node").isNotNull())
    firsts = known.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    signed = _sets(docs, _signature_rows(percent, parts), "sig long, node long", shingle)
    stars = shared_stage(bucket_stars(signed).select("leader", "member").distinct(), "stars")

    def linked(possible: DataFrame, name: str) -> DataFrame:
        possible = shared_stage(possible, f"{name}_pairs")
        wanted = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = shared_stage(_fetch_sets(docs, firsts, wanted, shingle), f"{name}_sets")
        found = shared_stage(_verified(possible, sets, percent), f"{name}_links")
        forget(possible, sets)
        return found

    tested = stars.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    links = linked(_possible(tested, known, percent), "star")
    for step in ("nearest", "across"):
        pairs = shared_stage(_across(stars, components(links), known, percent, nearest=step == "nearest"), step)
        links = links.union(linked(_possible(pairs, known, percent), step))
        forget(pairs)
    forget(stars)
    return nodes, links


def _across(
    stars: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, nearest: bool = False
) -> DataFrame:
    """Pairs of a leader's members in different components, that may link.

    Nodes that share a signature share its leader, so all of these meet here; the leader itself was compared.
    With `nearest` only one pair for each member outside the most frequent component.
    """
    label_of = labels.select(F.col("node").alias("member"), F.col("label").alias("own"))
    labelled = stars.join(label_of, "member", "left").select(
        "leader", "member", F.coalesce("own", "member").alias("own")
    )
    mixed_up = labelled.groupBy("leader").agg(
        F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high")
    ).filter((F.col("n") > 1) & (F.col("low") != F.col("high")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    rows = labelled.join(mixed_up.select("leader", blocks.alias("blocks")), "leader").select(
        "leader", "member", "own", "blocks", block.alias("block")
    )
    known = nodes.select(F.col("node").alias("member"), "n_shingles", "coarse").dropDuplicates(["member"])
    # Two members with several leaders in common leave the task of the least one.  A member of very many leaders
    # would carry a long list to each: its pairs may leave more than once.
    if nearest:
        known = known.withColumn("leaders", F.lit(None).cast("array<bigint>"))
    else:
        led = rows.groupBy("member").agg(F.collect_set("leader").alias("leaders"))
        few = F.when(F.size("leaders") <= LEADERS, F.sort_array("leaders")).alias("leaders")
        known = known.join(led.select("member", few), "member")
    # One row for each block that the member's own block meets; nearly all buckets are one block.
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sketched = (
        rows.join(known, "member")
        .select("leader", "member", "own", "n_shingles", "coarse", "block", "leaders", meets)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other")
    )

    def run(batches):
        unit, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 7, 8)])
            if not keys.shape[1]:
                continue
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cuts = [0, *changes.tolist(), keys.shape[1]]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(keys[:, start].tolist())
                if held and here != unit:
                    yield from _unit_pairs(held, unit[1] != unit[2], percent, nearest)
                    held = []
                unit = here
                held.append(batch.slice(start, end - start))
        if held:
            yield from _unit_pairs(held, unit[1] != unit[2], percent, nearest)

    keys = ("leader", "low", "high")
    ordered = sketched.repartition(*keys).sortWithinPartitions(*keys, "member")
    return ordered.mapInArrow(run, "a long, b long").distinct()


PAIRS_AT_ONCE = 200_000
ROWS_AT_ONCE = 64


def _unit_pairs(held: list[pa.RecordBatch], two_blocks: bool, percent: int, nearest: bool):
    """Pairs of a unit's members across components whose sizes and sketches allow a link.

    A unit is one block of a bucket, or two of which only pairs between them are wanted.  Pairs are
    formed and tested in parts; only those that pass leave the task, or the nearest of each member.
    """
    rows = pa.Table.from_batches(held)
    member, own, n = (rows.column(k).to_numpy() for k in (1, 2, 3))
    block = rows.column(5).to_numpy()
    sketches = [unpacked(s) for s in rows.column(4).to_pylist()]
    # All sketches at the least length: pairs that these leave are compared at the longer one.
    width = min(map(len, sketches))
    long = np.array([len(s) > width for s in sketches])
    level = [
        folded(np.frombuffer(s, np.uint8).reshape(1, -1), width, PACKED).tobytes() if far else s
        for s, far in zip(sketches, long, strict=True)
    ]
    cells = np.frombuffer(b"".join(level), np.uint8).reshape(len(level), width)
    few = np.frombuffer(coarse(cells.tobytes()), np.uint8).reshape(len(level), -1)
    words = leveled(cells).T.copy()
    # Sizes as far as they matter for so many bits.
    allowed = np.minimum((100 - percent) * n, 1 << 29).astype(np.int32)
    step = min(ROWS_AT_ONCE, max(1, PAIRS_AT_ONCE // len(member)))
    least = np.full(len(member), np.iinfo(np.int64).max)
    partner = np.full(len(member), -1)
    for start in range(0, len(member), step):
        # Rows meet those from their own block on; most pairs end here, after a few operations on whole words.
        here, rest = slice(start, start + step), slice(start, None)
        differing = np.zeros((len(member[here]), len(member[rest])), np.int32)
        for word in words:
            differing += np.bitwise_count(word[here, None] ^ word[rest])
        differing *= 100 + percent
        differing -= allowed[here, None]
        near = (differing <= allowed[rest]) & (own[here, None] != own[rest])
        if two_blocks:
            near &= block[here, None] != block[rest]
        x, y = np.nonzero(near)
        x, y = x + start, y + start
        similar = (x < y) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[similar], y[similar]
        for level in (few, cells):
            apart = np.empty(len(x), np.int64)
            for at in range(0, len(x), PAIRS_AT_ONCE // COARSE):
                part = slice(at, at + PAIRS_AT_ONCE // COARSE)
                apart[part] = cells_apart(level[x[part]], level[y[part]])
            keep = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
            x, y, apart = x[keep], y[keep], apart[keep]
        finer = np.flatnonzero(long[x] & long[y])
        apart[finer] = sketch_distance([sketches[i] for i in x[finer]], [sketches[i] for i in y[finer]], PACKED)
        keep = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
        x, y, apart = x[keep], y[keep], apart[keep]
        if not nearest:
            first = _first_shared(rows, x, y)
            yield _pair_rows(member[x[first]], member[y[first]])
            continue
        for one, other in ((x, y), (y, x)):
            order = np.lexsort((apart, one))
            who, first = np.unique(one[order], return_index=True)
            best = order[first]
            better = apart[best] < least[who]
            least[who[better]] = apart[best[better]]
            partner[who[better]] = other[best[better]]
    if nearest:
        names, counts = np.unique(own, return_counts=True)
        x = np.flatnonzero((partner >= 0) & (own != names[counts.argmax()]))
        yield _pair_rows(member[x], member[partner[x]])


def _first_shared(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs have no lesser leader in common than that of `rows`, as far as leaders are listed."""
    if not len(x) or "leaders" not in rows.column_names:
        return np.ones(len(x), bool)
    at = np.unique(np.concatenate([x, y]))
    listed = dict(zip(at.tolist(), rows.column("leaders").take(pa.array(at)).to_pylist(), strict=True))
    here = rows.column(0)[0].as_py()
    # Lists are cut before this leader, so that a pair is kept if nothing is in common.
    lesser = {i: frozenset(v for v in found or () if v < here) for i, found in listed.items()}
    return np.array([lesser[i].isdisjoint(lesser[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
    )


def node_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    parts: int = PARTS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, label): as `similar_groups`, with the row's node and the
    component's least node, which tell rows and components apart where ids repeat.  Both are null for a
    text without words.
    """
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    nodes, links = jaccard_links(slim, shingle=shingle, percent=percent, parts=parts)
    labels = components(links)
    alone = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"))
    labelled = alone.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = labelled.join(least, "label").select("node", "label", "component_id")
    return nodes.join(by_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
        "label",
    )


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least id that links reach, for every document."""
    return node_groups(docs, **options).select("doc_id", "n_shingles", "component_id")
