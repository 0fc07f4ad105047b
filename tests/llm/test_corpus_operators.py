"""Operators over the whole corpus, against brute force, round trips and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_row_operators import ODD, documents, odd_documents

import corpus_pipeline  # noqa: E402
from docrecords.llm import (
    chat_views,
    language_id,
    lattice_score,
    neighbour_quality,
    partenum_join,
    queries,
    shard_schedule,
    window_packing,
)
from docrecords.llm.common import table


def brute_groups(rows, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = max(len(words) - 3, min(len(words), 1))
        sets.append(frozenset(tuple(words[i : i + 4]) for i in range(n)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    cells = bytes([1]) * (partenum_join.SKETCH // partenum_join.COARSE)
    stars = spark.createDataFrame([(7, 0, m) for m in range(1, 40)], "sig long, leader long, member long")
    labels = spark.createDataFrame([(m, m % 6) for m in range(40)], "node long, label long")
    nodes = spark.createDataFrame(
        [(m, 256 + m, cells) for m in range(40)], "node long, n_shingles long, coarse binary"
    )
    wanted = {(a, b) for a in range(1, 40) for b in range(a + 1, 40) if a % 6 != b % 6}
    for block in (3, 16, 4096):
        monkeypatch.setattr(partenum_join, "BLOCK", block)
        pairs = [tuple(r) for r in partenum_join._across(stars, labels, nodes, 85).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
        one_each = partenum_join._across(stars, labels, nodes, 85, nearest=True).collect()
        assert one_each and {tuple(r) for r in one_each} <= wanted


def test_groups_whole_table_and_edits(spark, sf):
    rows = [tuple(r) for r in documents(spark, sf).collect()]
    base = rows[0][1].split()[:120]
    for k in range(12):  # copies that differ in one to three words, in a chain
        base = [*base[: 9 * k], f"word{k}", *base[9 * k + 1 :]]
        rows.append((1000 + k, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in partenum_join.similar_groups(frame).collect()), key=str)
    assert got == brute_groups(rows)


def test_groups_odd_rows(spark):
    got = sorted((tuple(r) for r in partenum_join.similar_groups(odd_documents(spark)).collect()), key=str)
    assert got == brute_groups(ODD)
    assert partenum_join.similar_groups(odd_documents(spark).limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for size in (7, 13, 40, 99, 150, 400, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = int(len(a) * 15 / 100)
            b = a[drop:]
            if 100 * len(b) >= 85 * len(a) and len(b) < len(a):
                assert np.intersect1d(partenum_join.signatures(a), partenum_join.signatures(b)).size


def check_packing(rows, frame):
    encode = window_packing.text_encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in frame.collect():
        want[r.doc_id, encode(r.text) + bytes(4)] += 1
    windows = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        windows[r.sequence_id].append((r.offset, r.length))
    fills = []
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        fills.append(at)
    total = sum(len(ids) // 4 * n for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total
    return want, fills


def test_packing_round_trip(spark, sf):
    docs = documents(spark, sf)
    rows = window_packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), with_ids=True).collect()
    want, fills = check_packing(rows, docs)
    made = defaultdict(list)
    for r in rows:
        made[r.doc_id].append(r)
    for (name, ids), _ in want.items():
        pieces = sorted(made[name], key=lambda r: r.start)
        assert np.array([x for p in pieces for x in p.ids], "<u4").tobytes() == ids
        assert all(p.doc_tokens * 4 == len(ids) for p in pieces)
    assert sum(f < 1024 for f in fills) <= docs.rdd.getNumPartitions()


def test_packing_odd_rows(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    docs = odd_documents(spark).select("doc_id", "text")
    check_packing(window_packing.pack(odd_documents(spark), path, with_ids=True, max_open=2).collect(), docs)
    assert window_packing.pack(docs.limit(0), path).count() == 0


def test_shards(spark, sf):
    for frame in (documents(spark, sf), odd_documents(spark)):
        rows = shard_schedule.shard_documents(frame).collect()
        assert len(rows) == frame.count()
        shard_of, loads, slots = {}, Counter(), defaultdict(list)
        for r in rows:
            assert shard_of.setdefault(r.digest, r.shard) == r.shard and 0 <= r.shard < 40
            loads[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = Counter()
        for r in rows:
            sizes[r.digest] += r.size
        bound = max(max(sizes.values()), sum(loads.values()) / 40 * 4 / 3 + 1)
        assert max(loads.values()) <= bound + max(sizes.values()) / 3
    bundled = shard_schedule.shard_documents(documents(spark, sf), shards=3, per_shard=4).collect()
    assert len(bundled) == 200 and {r.shard for r in bundled} == {0, 1, 2}
    assert shard_schedule.shard_documents(odd_documents(spark).limit(0)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op4_language_id(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et la", "fr"), (None, "de")], "text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["en", "fr"]
    rows = language_id.predict(odd_documents(spark), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letter = re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    nothing = language_id.predict(odd_documents(spark), language_id.fit(train.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op1_neighbour_quality(spark, sf).collect() if r.held_out and r.doc_id in quality]
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if quality[a.doc_id] for b in rows if not quality[b.doc_id]]
    assert sum(pairs) / len(pairs) > 0.95


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (7, 1), (8, 0), (99, 1)], "doc_id long, label int")
    model = neighbour_quality.fit(odd_documents(spark), labels)
    rows = neighbour_quality.score(odd_documents(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = neighbour_quality.fit(odd_documents(spark), labels.limit(0))
    assert {r.score for r in neighbour_quality.score(odd_documents(spark), none).collect()} == {0.5}


def brute_log(pieces: dict[bytes, float], word: bytes) -> float:
    text = b" " + word
    sums = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            sums[end] += sums[start] * pieces.get(text[start:end], 0.0)
    return math.log(sums[-1])


def test_lattice_sums_all_segmentations():
    weights = {b" ": 1.0, b" a": 2.0, b"ab": 1.5, b"a": 1.0, b"b": 0.5, b" ab": 0.25, b"bb": 3.0}
    lattice = lattice_score.Lattice(weights, 0.1)
    share = {p: w / sum(weights.values()) * 0.9 for p, w in weights.items()}
    words = [b"a", b"ab", b"abb", b"bab", b"ab" * 30]
    assert np.allclose(lattice.word_logs(words), [brute_log(share, w) for w in words])
    uses = lattice.expected([b"ab"], [4])
    assert math.isclose(sum(len(p) * u for p, u in zip(lattice.pieces, uses, strict=True)), 12)


def test_lattice_base_score(spark, sf):
    rows = queries.op6_lattice_score(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in documents(spark, sf).collect()}
    held = {r.doc_id for r in rows if r.held_out}
    assert held == {d for d in docs if zlib.crc32(str(d).encode()) % 10 == 0}
    counts = Counter(w for d, words in docs.items() if d not in held for w in [*words, None])
    n = sum(counts.values())
    for r in rows:
        tokens = [*docs[r.doc_id], None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_lattice_odd_rows_and_join(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    train = F.col("doc_id") > 3
    whole = lattice_score.lattice_scores(odd_documents(spark), train, path).collect()
    joined = lattice_score.lattice_scores(odd_documents(spark), train, path, head_words=2).collect()
    assert len(whole) == len(joined) == len(ODD)
    for a, b in zip(sorted(whole, key=str), sorted(joined, key=str), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])
    assert lattice_score.lattice_scores(odd_documents(spark).limit(0), train, path).count() == 0


def test_chat_views_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, None, "bob", None), (1, 1, "ann", "hi <|im_end|>"), (2, 0, "system", "x"), (None, 0, None, "alone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit(1))
    got = chat_views.chat_views(frame).collect()
    views = defaultdict(list)
    for r in got:
        views[r.conv_id, r.speaker].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "")}
    for view in views.values():
        view.sort(key=lambda r: r.position)
        text = "".join(r.segment for r in view)
        for r in view:
            assert text[r.start : r.end] == r.segment
            assert (r.loss_start is not None) == (r.role == r.speaker)
    assert chat_views.chat_views(frame.limit(0)).count() == 0


def test_pipeline(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    leaks = {r.doc_id for r in queries.op9_decontaminate(spark, sf).collect() if r.contaminated}
    groups = [r for r in queries.op5_partenum_join(spark, sf).collect() if r.doc_id in kept]
    assert kept and not kept & leaks
    assert len({r.component_id for r in groups}) == len(groups)


def test_signs_that_are_no_letters_have_no_language(spark):
    train = spark.createDataFrame([("some english words", "en"), ("einige deutsche worte", "de")], "text string, lang string")
    model = language_id.fit(train)
    texts = [("½ ² ① Ⅷ",), ("12 !",), ("_",), ("ⅷ a",), ("日本",)]
    found = language_id.predict(spark.createDataFrame(texts, "text string"), model).collect()
    assert [r.lang_pred == "und" for r in found] == [True, True, True, False, False]


def test_a_bucket_gives_no_rows_for_pairs_that_whole_sketches_rule_out():
    """Unrelated sets of one size: coarse sketches alone leave more pairs the larger the bucket."""
    rng = np.random.default_rng(11)
    for size in (900, 3000):
        common = rng.integers(0, 2**64, size // 2, dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, size // 2, dtype=np.uint64)])) for _ in range(60)]
        sets.append(np.unique(np.concatenate([sets[0][size // 50 :], rng.integers(0, 2**64, 5, dtype=np.uint64)])))
        sets += [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1000, 1100, 1024, 2040, 4100)]
        batch = pa.table(
            {
                "sig": [1] * len(sets),
                "member": list(range(len(sets))),
                "own": list(range(len(sets))),
                "n": [len(s) for s in sets],
                "cells": pa.array([partenum_join.packed(partenum_join.sketch(s)) for s in sets], pa.binary()),
                "block": [0] * len(sets),
            }
        ).to_batches()
        made = [b.to_pylist() for b in partenum_join._unit_pairs(batch, False, 80, False)]
        assert [(r["a"], r["b"]) for rows in made for r in rows] == [(0, 60)]
        near = [b.to_pylist() for b in partenum_join._unit_pairs(batch, False, 80, True)]
        assert {(r["a"], r["b"]) for rows in near for r in rows} == {(0, 60)}


def test_packed_sketches_never_exceed_the_difference_of_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 30, 900, 1100, 5000, 40_000)]
    sets += [np.sort(rng.permutation(s)[: len(s) * 9 // 10]) for s in sets[3:]]
    sets += [np.arange(k, dtype=np.uint64) for k in (20, 1000, 1100, 5000)]  # all in one cell
    sketches = [partenum_join.unpacked(partenum_join.packed(partenum_join.sketch(s))) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    apart = partenum_join.sketch_distance(
        [sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs], partenum_join.PACKED
    )
    for (i, j), least in zip(pairs, apart.tolist(), strict=True):
        assert least <= len(np.setxor1d(sets[i], sets[j]))
