"""The near-duplicate stage: its own shingle length and threshold."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docrecords.llm import partenum_join


def words(seed, n=470):
    return [f"w{seed}x{i}" for i in range(n)]


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)


def test_one_changed_word_in_forty_seven_is_a_near_copy(spark):
    one = words(1)
    near = [f"new{i}" if i % 47 == 20 else w for i, w in enumerate(one)]
    # 5-word Jaccard 416 / 516 = 0.806, 4-word 427 / 507 = 0.842.
    far = [f"new{i}" if i % 40 == 20 else w for i, w in enumerate(words(2))]
    rows = [(1, one), (2, near), (3, words(2)), (4, far)]
    assert {i for i, _ in stage(spark, [(i, " ".join(w)) for i, w in rows])} == {1, 3, 4}


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    a, b, c = (" ".join(words(k, 60)) for k in (11, 12, 13))
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c.upper()), (8, c)]
    assert stage(spark, rows) == sorted([(5, a), (3, b), (7, c.upper())], key=str)


def test_near_copies_under_one_id_are_one(spark):
    one = words(21)
    near = " ".join(f"new{i}" if i % 47 == 20 else w for i, w in enumerate(one))
    assert len(stage(spark, [(1, " ".join(one)), (1, near), (1, "other words"), (2, near)])) == 2


def test_rows_without_an_id_stay_where_others_repeat(spark):
    a, b = (" ".join(words(k, 60)) for k in (31, 32))
    rows = [(None, a), (None, a), (None, None), (None, None), (None, ""), (4, b), (4, b), (6, ""), (6, ""), (6, None)]
    expected = [(None, a), (None, a), (None, None), (None, None), (None, ""), (4, b), (6, ""), (6, None)]
    assert stage(spark, rows) == sorted(expected, key=str)


def test_texts_without_an_id_are_fetched_once(spark, monkeypatch):
    rows = [(None, " ".join(words(k, 20))) for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = partenum_join.with_node(docs, "node").select("node").withColumn("first_id", F.col("node") * F.lit(None))
    read = []

    def texts(docs, *_):
        read.append(docs.count())
        return docs

    monkeypatch.setattr(partenum_join, "_sets", texts)
    partenum_join._fetch_sets(docs, nodes, nodes.select("node"), partenum_join.SHINGLE)
    assert read == [30]


def test_near_copies_without_an_id_are_linked(spark):
    one = words(51)
    near = " ".join(f"new{i}" if i == 20 else w for i, w in enumerate(one))
    docs = spark.createDataFrame([(None, " ".join(one)), (None, near), (None, "z")], "doc_id bigint, text string")
    assert len({r.label for r in partenum_join.node_groups(docs).collect()}) == 2


def brute_labels(rows, shingle, percent):
    """The least row of each component, by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        said = (text or "").encode().lower().split()
        n = max(len(said) - shingle + 1, min(len(said), 1))
        sets.append(frozenset(tuple(said[i : i + shingle]) for i in range(n)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for a, b in combinations(h, 2))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            label[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def test_whole_table_with_chains_at_the_stage_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    for start in (0, 7):
        base = rows[start][1].split()[: 150 + 400 * (start > 0)]
        for k in range(14):  # each differs a little from the one before
            at = 11 * k % len(base)
            base = [*base[:at], f"chain{k}", f"link{k}", *base[at + 2 :]]
            rows.append((10_000 + 100 * start + k, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in partenum_join.similar_groups(frame, shingle=5, percent=80).collect()}
    labels = brute_labels(rows, 5, 80)
    assert got == {r[0]: rows[label][0] for r, label in zip(rows, labels, strict=True)}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert kept == {r[0] for i, r in enumerate(rows) if labels[i] == i}


def test_similar_sets_share_a_signature_at_any_percent():
    rng = np.random.default_rng(3)
    for percent in (50, 60, 65, 70, 80, 90, 95):
        for size in (1, 2, 3, 10, 47, 150, 700):
            larger = np.unique(rng.integers(0, 2**63, size * 100 // percent).astype(np.uint64))
            mixed = [larger[: len(larger) * percent // 100 + 1], larger]
            fresh = rng.integers(0, 2**63, len(larger)).astype(np.uint64)
            swapped = len(larger) * (100 - percent) // (100 + percent)
            pairs = [mixed, [np.unique(np.concatenate([larger[swapped:], fresh[:swapped]])), larger]]
            for a, b in pairs:
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) and (a.tobytes() != b.tobytes()):
                    assert np.intersect1d(partenum_join.signatures(a, percent), partenum_join.signatures(b, percent)).size


def test_sketches_never_exceed_the_difference_of_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 30, 900, 1100, 5000, 5000, 40_000)]
    sets += [np.sort(rng.permutation(sets[k])[: len(sets[k]) * 9 // 10]) for k in (3, 5, 7)]
    sets.append(np.arange(1000, dtype=np.uint64))  # all in one cell
    sketches = [partenum_join.sketch(s) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    apart = partenum_join.sketch_distance([sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs])
    for (i, j), least in zip(pairs, apart.tolist(), strict=True):
        assert least <= len(np.setxor1d(sets[i], sets[j]))
    assert apart[pairs.index((5, 6))] > 0.2 / 1.8 * 10_000  # unrelated large sets are told apart
    less = partenum_join.sketch_distance(*([partenum_join.coarse(sketches[p[k]]) for p in pairs] for k in (0, 1)))
    assert (less <= apart).all() and less[pairs.index((5, 6))] > 0.2 / 1.8 * 10_000


def test_tables_that_nothing_reads_are_removed(spark):
    from docrecords.llm.common import forget, shared_stage

    table = shared_stage(spark.range(10), "numbers")
    forget(table)
    assert spark.read.schema("id long").parquet(table.stage_path).count() == 0


def test_stages_keep_the_callers_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = ["score", "lang_pred", "n_words", "item_ids", "n_hit", "node", "component_id", "a.b", "Text2"]
    wide = docs.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias(name) for name in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in extra), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()}


def test_stages_take_odd_rows(spark, sf):
    good = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "Some words here.", "en", "s", 5), (7, "Some words here.", "en", "s", 5), (7, "Some words here.", "en", "s", 5)],
        good.schema,
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, good.unionByName(odd), sf).count() > 100
        assert stage(spark, good.limit(0), sf).collect() == []
    pieces = corpus_pipeline.packing(spark, odd, sf).collect()
    assert sum(r.start == 0 for r in pieces) == 6


def test_a_pair_leaves_the_task_of_its_least_leader_only(spark):
    import pyarrow as pa

    cells = bytes([1]) * (partenum_join.SKETCH // partenum_join.COARSE)
    stars = spark.createDataFrame([(leader, m) for leader in (-2, 0) for m in range(1, 12)], "leader long, member long")
    labels = spark.createDataFrame([(m, m % 3) for m in range(1, 12)], "node long, label long")
    nodes = spark.createDataFrame([(m, 256 + m, cells) for m in range(12)], "node long, n_shingles long, coarse binary")
    pairs = {tuple(r) for r in partenum_join._across(stars, labels, nodes, 85).collect()}
    assert pairs == {(a, b) for a in range(1, 12) for b in range(a + 1, 12) if a % 3 != b % 3}

    def made(leader, lists):
        names = ["leader", "member", "own", "n_shingles", "coarse", "block", "leaders", "low", "high"]
        n = len(lists)
        columns = [[leader] * n, range(n), range(n), [256] * n, [cells] * n, [0] * n, pa.array(lists, pa.list_(pa.int64())), [0] * n, [0] * n]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        return [(r["a"], r["b"]) for b in partenum_join._unit_pairs([batch], False, 85, False) for r in b.to_pylist()]

    lists = [[-2, 5], [-2, 5], [1, 5], None]  # the last has too many leaders for a list
    assert made(5, lists) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert made(-2, lists[:2]) == [(0, 1)]


def test_signature_sums_are_exact_and_rows_leave_in_slices(spark):
    import pyarrow as pa


    rng = np.random.default_rng(5)
    values, part = rng.integers(0, 2**64, 50_000, np.uint64), rng.integers(0, 7, 50_000)
    want = [sum(values[part == k].tolist()) % 2**64 for k in range(7)]
    assert partenum_join.sums_by(part, values, 7).tolist() == want

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            texts = pa.RecordBatch.from_pydict({"text": [f"w{i} x y z {i}" for i in range(1200)]})
            return [b.num_rows for b in run([texts])]

    sizes = partenum_join._sets(Docs(), lambda batch, sets, seen: batch, "", 4)
    assert sum(sizes) == 1200 and max(sizes) <= partenum_join.AT_ONCE


def test_levels_never_outnumber_differences_and_drop_most_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**64, int(rng.integers(250, 350)), np.uint64)) for _ in range(120)]
    near = [np.sort(rng.choice(s, len(s) - 3, replace=False)) for s in sets[:40]]
    sketches = [partenum_join.sketch(s) for s in sets + near]
    width = min(map(len, sketches))
    cells = np.stack([partenum_join.folded(np.frombuffer(s, np.uint8).reshape(1, -1), width)[0] for s in sketches])
    words = partenum_join.leveled(cells)
    x, y = np.triu_indices(len(cells), 1)
    bits = np.bitwise_count(words[x] ^ words[y]).sum(axis=1)
    assert (bits <= partenum_join.cells_apart(cells[x], cells[y])).all()
    n = np.array([len(s) for s in sets + near])
    kept = 180 * bits <= 20 * (n[x] + n[y])
    assert kept[(x < 40) & (y == x + len(sets))].all() and kept.mean() < 0.02
