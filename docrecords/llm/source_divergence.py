"""Operator 11, source divergence audit: term shares of sources compared within each language.

Terms are runs of ASCII letters (lower-cased) and non-ASCII characters.  A language keeps the terms that
`least_docs` of its documents hold or more.  A source's share of a kept term, in parts of 10^9, is smoothed
by 5 counts a term; sources are compared by the summed difference of their shares, and a source with its
language by the terms of which it has the larger share.  All arithmetic is in whole numbers.

Counting, by length-bucketed packing.  The texts of a slice lie in one byte array, ordered by group.  Terms
of up to 8 bytes become one uint64, those of up to 16 bytes two, left-aligned, so that their order is that
of the bytes.  They are radix-sorted by digits of 16 bits and counted as runs in numpy; as the sort is
stable, a run's documents stay in order and are counted in the same pass.  Longer terms are sorted as bytes
in a bucket for each length.  Slices of a task are merged the same way before rows leave it.

Comparison.  The counts of kept terms are dealt into buckets of terms; with more than `SOURCE_BLOCK` sources
a bucket is met by two blocks of sources at a time.  A unit holds the sparse counts of its terms and its
sources' totals, makes them dense a few terms at a time, and returns one sum for each pair of sources and
the best `top` terms of a source.  Units of a hot source or language are as small as others.

Results for odd inputs: null text, language and source are empty strings; a group without kept terms has
the plain share everywhere; a language without kept terms gives its pairs the value 0, one with a single
source no pairs; repeated rows count as documents of their own; ties rank by the item's bytes; an empty
table gives no rows; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_stage, text_bytes

LEAST_DOCS = 30
TOP = 50
SMOOTHING = 5
PARTS_OF = 1_000_000_000

SLICE_BYTES = 4_000_000
MERGE_ROWS = 500_000
ROWS_AT_ONCE = 65_536
SOURCE_BLOCK = 512
BUCKET_ROWS, BUCKET_MOST = 20_000, 2_000_000
DENSE_CELLS = 1_000_000

# Bytes of a term, lower-cased, and 0 for all others.
_TERM = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)
)
_COUNTS = "lang string, source string, term string, n long, docs long"


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order by unsigned words, the least significant one first: a pass for each 16 bits that differ."""
    order = np.arange(len(words[0]))
    for word in words:
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Marks the rows that differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _counted(new_run: np.ndarray, new_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs start, their lengths, and the documents in each."""
    start = np.flatnonzero(new_run)
    n = np.diff(start, append=len(new_run))
    docs = np.add.reduceat(new_doc.astype(np.int64), start) if len(start) else n
    return start, n, docs


class PackedCounts:
    """Counts of the terms of (language, source) groups, of one task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.held: dict[int, list[tuple]] = {1: [], 2: []}  # by number of words: hi, lo, group, n, docs
        self.rows = 0

    def add(self, texts: list[bytes], groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Count a slice of texts; yields the rows of long terms, and all rows when many are held."""
        number = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.uint32)
        by_group = np.argsort(number, kind="stable")
        number = number[by_group]
        cleaned = [texts[i].translate(_TERM) for i in by_group]
        starts_of_docs = np.cumsum([0, *(len(t) + 1 for t in cleaned[:-1])])
        joined = b"\0".join([*cleaned, bytes(17)])
        of_term = np.frombuffer(joined, np.uint8) != 0
        edges = np.flatnonzero(of_term[1:] != of_term[:-1]) + 1
        if of_term[0]:
            edges = np.concatenate([[0], edges])
        start, length = edges[::2], edges[1::2] - edges[::2]
        doc = np.searchsorted(starts_of_docs, start, "right") - 1
        # The eight bytes from each place on, as a number of the same order.
        eight = np.ndarray((len(joined) - 7,), ">u8", joined, strides=(1,))
        mask = np.array([0, *(2**64 - 2 ** (64 - 8 * k) for k in range(1, 9))], np.uint64)

        for words in (1, 2):
            mine = (length > 8 * (words - 1)) & (length <= 8 * words)
            at, doc_of = start[mine], doc[mine]
            rest = mask[length[mine] - 8 * (words - 1)]
            last = eight[at + 8 * (words - 1)].astype(np.uint64) & rest
            hi = last if words == 1 else eight[at].astype(np.uint64)
            lo = np.zeros(0, np.uint64) if words == 1 else last
            order = radix_order(hi) if words == 1 else radix_order(lo, hi)
            hi, doc_of = hi[order], doc_of[order]
            lo = lo[order] if words == 2 else lo
            group = number[doc_of]
            new_run = _runs(hi, group) if words == 1 else _runs(hi, lo, group)
            at_run, n, docs = _counted(new_run, _runs(doc_of) | new_run)
            self.held[words].append((hi[at_run], lo[at_run] if words == 2 else lo, group[at_run], n, docs))
            self.rows += len(at_run)
        for size in np.unique(length[length > 16]).tolist():
            mine = length == size
            at, doc_of = start[mine], doc[mine]
            flat = np.frombuffer(b"".join(joined[a : a + size] for a in at.tolist()), f"S{size}")
            order = np.argsort(flat, kind="stable")
            flat, doc_of = flat[order], doc_of[order]
            group = number[doc_of]
            new_run = _runs(flat, group)
            at_run, n, docs = _counted(new_run, _runs(doc_of) | new_run)
            yield from self._rows(flat[at_run], group[at_run], n, docs)
        if self.rows > 2 * MERGE_ROWS:
            self._merge()
            if self.rows > MERGE_ROWS:
                yield from self.all()

    def _merge(self) -> None:
        self.rows = 0
        for words, held in self.held.items():
            if not held:
                continue
            hi, lo, group, n, docs = (np.concatenate(c) for c in zip(*held, strict=True))
            order = radix_order(group, hi) if words == 1 else radix_order(group, lo, hi)
            hi, group = hi[order], group[order]
            lo = lo[order] if words == 2 else lo
            start = np.flatnonzero(_runs(hi, group) if words == 1 else _runs(hi, lo, group))
            if len(start):
                n, docs = np.add.reduceat(n[order], start), np.add.reduceat(docs[order], start)
            self.held[words] = [(hi[start], lo[start] if words == 2 else lo, group[start], n, docs)]
            self.rows += len(start)

    def all(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for words, held in self.held.items():
            for hi, lo, group, n, docs in held:
                packed = hi.astype(">u8") if words == 1 else np.stack([hi, lo], axis=1).astype(">u8").ravel()
                yield from self._rows(packed.view(f"S{8 * words}"), group, n, docs)
        self.held, self.rows = {1: [], 2: []}, 0

    def _rows(self, terms, group, n, docs) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        for k in range(0, len(terms), ROWS_AT_ONCE):
            part = slice(k, k + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(group[part])),
                    sources.take(pa.array(group[part])),
                    pa.array(terms[part].tolist(), pa.binary()).view(pa.string()),
                    pa.array(n[part], pa.int64()),
                    pa.array(docs[part], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task only."""

    def run(batches):
        counts = PackedCounts()
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch, "text")]
            groups = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            first, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= SLICE_BYTES or i == len(texts) - 1:
                    yield from counts.add(texts[first : i + 1], groups[first : i + 1])
                    first, held = i + 1, 0
        yield from counts.all()

    return docs.select("text", "lang", "source").mapInArrow(run, _COUNTS)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / totals) without overflow: long division by steps of 1000."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def _unit(top: int):
    """Of a unit's counts and sources: differences of pairs of sources, and each source's best terms."""

    def run(counts: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.combine_chunks().sort_by("source")
        low, high = (sources.column(k)[0].as_py() for k in ("lo", "hi"))
        names = sources.column("source").combine_chunks()
        block = sources.column("block").to_numpy()
        v = sources.column("v")[0].as_py()
        total = sources.column("n_source").to_numpy() + SMOOTHING * v
        whole = np.int64(sources.column("n_lang")[0].as_py() + SMOOTHING * v)

        coded = counts.column("term").combine_chunks().dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy()
        who = pc.index_in(counts.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
        n = counts.column("n").to_numpy()
        of_lang = np.zeros(len(terms), np.int64)
        of_lang[code] = counts.column("n_term").to_numpy()

        # Terms that none of the unit's sources has differ by the plain shares: counted once for all of the
        # language's terms, in the first bucket, and taken off where a term is met.
        plain = shares(np.full(len(names), SMOOTHING), np.maximum(total, 1))
        unmet = (v if sources.column("bucket")[0].as_py() == 0 else 0) - len(terms)
        apart = unmet * np.abs(plain[:, None] - plain[None, :])
        gain = np.zeros(len(n), np.int64)
        step = max(1, DENSE_CELLS // max(1, len(names)))
        order = np.argsort(code, kind="stable")
        for first in range(0, len(terms), step):
            width = min(step, len(terms) - first)
            a, b = np.searchsorted(code[order], [first, first + width])
            rows = order[a:b]
            dense = np.full((len(names), width), SMOOTHING, np.int64)
            dense[who[rows], code[rows] - first] += n[rows]
            p = shares(dense, total[:, None])
            q = shares(of_lang[first : first + width] + SMOOTHING, whole)
            gain[rows] = p[who[rows], code[rows] - first] - q[code[rows] - first]
            for i in range(len(names) - 1):
                apart[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)

        x, y = np.triu_indices(len(names), 1)
        meant = (np.minimum(block[x], block[y]) == low) & (np.maximum(block[x], block[y]) == high)
        x, y = x[meant], y[meant]
        out = [(names.take(pa.array(x)), ["pair"] * len(x), names.take(pa.array(y)), apart[x, y])]
        if low == high and len(n):
            in_order = np.empty(len(terms), np.int64)
            in_order[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
            more = np.flatnonzero(gain > 0)
            more = more[np.lexsort((in_order[code[more]], -gain[more], who[more]))]
            start = np.flatnonzero(_runs(who[more])) if len(more) else np.zeros(0, np.int64)
            place = np.arange(len(more)) - np.repeat(start, np.diff(start, append=len(more)))
            best = more[place < top]
            out.append((names.take(pa.array(who[best])), ["term"] * len(best), terms.take(pa.array(code[best])), gain[best]))
        lang = sources.column("lang")[0].as_py()
        tables = [
            pa.table(
                {
                    "lang": pa.array([lang] * len(value), pa.string()),
                    "source": source.cast(pa.string()),
                    "part": pa.array(part, pa.string()),
                    "item": item.cast(pa.string()),
                    "value": pa.array(value, pa.int64()),
                }
            )
            for source, part, item, value in out
        ]
        return pa.concat_tables(tables)

    return run


def source_divergence(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): differences from other sources, and terms above the language's share."""
    rows = docs.select(
        *[
            F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
            for c, name in ((text, "text"), (lang, "lang"), (source, "source"))
        ]
    )
    counts = count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term's rows in a language are as many as the sources that have it.
    of_term = Window.partitionBy("lang", "term")
    kept = shared_stage(
        counts.select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(of_term).alias("docs"),
            F.sum("n").over(of_term).alias("n_term"),
            (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("first"),
        )
        .filter(F.col("docs") >= least_docs)
        .drop("docs"),
        "kept",
    )
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.sum("first").alias("v"), F.count("*").alias("rows"))
    langs = by_source.groupBy("lang").agg(F.sum("n_source").alias("n_lang"), F.sum("v").alias("v"))
    groups = shared_stage(
        rows.select("lang", "source")
        .distinct()
        .join(by_source.select("lang", "source", "n_source", "rows"), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["n_source", "rows", "n_lang", "v"]),
        "groups",
    )
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"), F.sum("rows").alias("rows"))
    size = sizes.agg(F.max("s").alias("s"), F.sum("rows").alias("rows")).first()
    most, all_rows = size["s"] or 0, size["rows"] or 0
    blocks = max(1, -(-most // SOURCE_BLOCK))
    buckets = max(1, -(-all_rows // min(max(BUCKET_ROWS, most * most), BUCKET_MOST)))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")

    def in_units(df: DataFrame) -> DataFrame:
        met = df.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

    unit = ["lang", "bucket", "lo", "hi"]
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    left = in_units(kept.drop("first").withColumn("bucket", bucket)).drop("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    right = in_units(groups.drop("rows").withColumn("bucket", every))
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(
        _unit(top), "lang string, source string, part string, item string, value long"
    )
    summed = shared_stage(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "found")
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(best_first).alias("rank")
    both_ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = summed.filter("part = 'pair'").select("lang", both_ways.alias("x"), "part", "value")
    pairs = pairs.select("lang", "x.source", "part", "x.item", "value").select("*", ranked)
    terms = summed.filter("part = 'term'").select("lang", "source", "part", "item", "value", ranked).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
