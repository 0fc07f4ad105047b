"""Source divergence, SimHash groups and centroid clusters against plain versions in Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docrecords.llm import centroid_clusters, simhash_pivots, source_divergence
from docrecords.llm.common import table

# --- source divergence


def plain_divergence(rows, least_docs=30, top=50):
    rows = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted((t for t, n in df[lang].items() if n >= least_docs), key=str.encode)
        sources = sorted({r[2] for r in rows if r[1] == lang}, key=str.encode)

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (x, v) in enumerate(found[:most])]
    return sorted(out)


def divergence(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in source_divergence.source_divergence(docs, **options).collect())


def test_divergence_of_the_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    for least in (30, 3):
        assert divergence(spark, rows, least_docs=least) == plain_divergence(rows, least)


def test_divergence_of_odd_rows(spark, monkeypatch):
    long = "x" * 40 + " " + "日本語" * 9
    rows = [
        (None, None, None), ("", "en", "a"), ("Words, WORDS & wörds it's", "en", "a"), ("words", "en", "b"),
        (long + " eightlet eightlett sixteenlettersxx sixteenlettersxxx", "en", "b"), (long, "en", None),
        ("ÄÖ äö É", "de", "a"), ("ÄÖ", "de", "b"), ("a\x00b 1c2", "de", "b"), ("only", "fr", "a"), ("1 2 3", "", "z"),
    ] * 2
    rows += [(" ".join(f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}" for i in range(3000)), "en", "hot")] * 3
    for least in (1, 2, 3, 99):
        assert divergence(spark, rows, least_docs=least, top=3) == plain_divergence(rows, least, 3)
    monkeypatch.setattr(source_divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(source_divergence, "BUCKET_ROWS", 3)
    monkeypatch.setattr(source_divergence, "DENSE_CELLS", 7)
    assert divergence(spark, rows, least_docs=2, top=3) == plain_divergence(rows, 2, 3)
    assert divergence(spark, rows[:0]) == []


def test_divergence_ignores_other_columns(spark):
    docs = spark.createDataFrame([("a b", "en", "s", 1, 2), ("a", "en", "t", 3, 4)], "text string, lang string, source string, term int, rank int")
    assert source_divergence.source_divergence(docs, least_docs=1).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_packed_counts_merge_and_flush(monkeypatch):
    rng = random.Random(3)
    terms = ["".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 7, 8, 9, 15, 16, 17, 30)))) for _ in range(300)]
    texts = [" ".join(rng.choice(terms) for _ in range(50)) for _ in range(80)]
    groups = [("l", rng.choice("xyz")) for _ in texts]
    n, docs = Counter(), Counter()
    for text, group in zip(texts, groups, strict=True):
        n.update((group, t) for t in text.split())
        docs.update((group, t) for t in set(text.split()))
    for most in (1_000_000, 400):
        monkeypatch.setattr(source_divergence, "MERGE_ROWS", most)
        packed, got_n, got_docs = source_divergence.PackedCounts(), Counter(), Counter()
        batches = []
        for k in range(0, 80, 9):
            batches += packed.add([t.encode() for t in texts[k : k + 9]], groups[k : k + 9])
        for batch in [*batches, *packed.all()]:
            for lang, source, term, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got_n[(lang, source), term] += a
                got_docs[(lang, source), term] += b
        assert got_n == n and got_docs == docs


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 10**15, 123456789012345], np.int64)
    totals = np.array([1, 10**9 + 7, 3 * 10**15, 4 * 10**14 + 1], np.int64)
    expected = [1 + 10**9 * c // t for c, t in zip(counts.tolist(), totals.tolist(), strict=True)]
    assert source_divergence.shares(counts, totals).tolist() == expected


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for i, a in enumerate(prints):
            label[i] = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3)
        if label == before:
            break
    least = {}
    for (name, _), c in zip(rows, label, strict=True):
        if name is not None:
            least[c] = min(name, least.get(c, name))
    return sorted(((r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, label, strict=True)), key=str)


def simhash(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in simhash_pivots.simhash_groups(docs).collect()), key=str)


def test_simhash_of_the_whole_table_and_edits(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    base = rows[0][1].split()
    for k in range(20):  # a chain of copies
        base = [*base[: 3 * k], f"word{k}", *base[3 * k + 1 :]]
        rows.append((10_000 + k, " ".join(base)))
    got = simhash(spark, rows)
    assert got == plain_groups(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_simhash_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (None, "one two"),
            (None, None), (None, "alone here"), (7, "É x é"), (8, "w " * 70_000)]
    assert simhash(spark, rows) == plain_groups(rows)
    assert simhash(spark, []) == []


def test_simhash_reads_other_names_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, 9)], "id long, body string, node int, component_id int")
    got = simhash_pivots.simhash_groups(docs, doc_id="id", text="body")
    assert [tuple(r) for r in got.collect()] == [(1, f"{plain_fingerprint('a b c'):016x}", 1)]


def balls(rng, centres, members, flips):
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("part, members", [(4096, 64), (40, 64), (4096, 0)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, part, members):
    monkeypatch.setattr(simhash_pivots, "PART", part)
    monkeypatch.setattr(simhash_pivots, "BUCKET_MEMBERS", members)
    nodes = balls(random.Random(5), 30, 25, 6) + balls(random.Random(6), 400, 1, 0)
    x = np.array(sorted(set(nodes)), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = np.arange(len(x))
    while True:
        least = np.where(near, want[None, :], len(x)).min(axis=1)
        if (least == want).all():
            break
        want = least
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "node long")
    found = [tuple(r) for r in simhash_pivots.links(frame).collect()]
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    assert all(near[place[a], place[b]] for a, b in found)
    label = np.arange(len(x))
    simhash_pivots._joined(label, np.array([place[a] for a, _ in found]), np.array([place[b] for _, b in found]))
    assert (label == want).all()


def test_blocks_grow_with_the_number_of_fingerprints():
    for n, blocks in ((0, 4), (10**6, 4), (10**8, 5), (10**11, 6), (10**30, 8)):
        masks = simhash_pivots.bit_blocks(n, 3)
        assert len(masks) == blocks and sum(masks) == 2**64 - 1


def test_pivot_tables_discard_what_the_references_promise():
    rng = np.random.default_rng(1)
    apart = np.bitwise_count(simhash_pivots.REFERENCES[:, None] ^ simhash_pivots.REFERENCES[None, :])
    assert (apart[~np.eye(64, dtype=bool)] == 32).all()
    x, y = (rng.integers(0, 2**63, 2000).astype(np.uint64) for _ in range(2))
    y[:1000] = x[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    table = [np.bitwise_count(v[:, None] ^ simhash_pivots.REFERENCES).astype(int) for v in (x, y)]
    most = np.abs(table[0] - table[1]).max(axis=1)
    far = np.bitwise_count(x ^ y)
    assert (most <= far).all() and (most[far >= 10] > 3).all()


# --- clusters


def plain_clusters(rows, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**27), min(2**27, x)) for x in v]) for i, v in kept]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=name)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        for k, vectors in of.items():
            centres[k] = [sum(x) // len(vectors) for x in zip(*vectors, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, inertia[k], inertia.total(), digest[k]) for i, d, k in found), key=str)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice((-1.5, 0.25, 0.001, 3.0)) * rng.random() for _ in range(64)]) for i in range(70)]
    rows += [(70, None), (71, []), (72, [0.0] * 63), (73, [0.0] * 65), (74, [0.0] * 63 + [None]), (75, [math.nan] + [0.0] * 63),
             (76, [math.inf] * 64), (77, [3e38] * 64), (78, [-3e38] * 64), (None, [0.5] * 64), (5, [0.25] * 64), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    for clusters, rounds in ((40, 5), (3, 2), (500, 1), (4, 0)):
        got = centroid_clusters.centroid_clusters(frame, clusters=clusters, rounds=rounds).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_clusters(exact, clusters, rounds)
    none = centroid_clusters.centroid_clusters(frame.filter(F.col("vec_id") > 1000))
    assert none.collect() == [] and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_stored_products_follow_the_moves():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-500, 500, (50, 64)), rng.integers(-500, 500, (6, 64))
    moves = rng.integers(-2, 3, (6, 64)) * (rng.random((6, 64)) < 0.1)
    moves[2] = 0
    assert (centroid_clusters.changed_dots(x, x @ c.T, moves) == x @ (c + moves).T).all()
