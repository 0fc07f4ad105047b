"""Unique keys and nested data: sizes, holes, depths, conflicts."""

import json
import random
import re
import time


from docrecords.operators import review, structure


def keys(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, order int, base string")
    return {(r.doc_id, r.order): r.key for r in structure.unique_keys(df).collect()}


def plain_keys(rows):
    out, used = {}, {}
    for doc, order, base in sorted(rows):
        taken = used.setdefault(doc, set())
        key, n = base, 2
        while key in taken:
            key, n = f"{base}{n}", n + 1
        taken.add(key)
        out[doc, order] = key
    return out


def test_unique_keys_are_those_of_a_loop(spark):
    rng = random.Random(1)
    bases = ["a", "a2", "a22", "a3", "a1", "b", "b10", "", "2", "22", "c"]
    rows = [(d, i, rng.choice(bases)) for d in range(6) for i in range(60)]
    assert keys(spark, rows) == plain_keys(rows)


def test_many_labels_in_one_document_take_seconds(spark):
    rows = [(1, i, ("total", "total2", "other")[i % 3]) for i in range(50_000)]
    start = time.time()
    got = keys(spark, rows)
    assert len(set(got.values())) == 50_000 and time.time() - start < 30


def data(spark, entries, **options):
    rows = [(1, "scalar", p, i, "confirmed", None, v) for i, (p, v) in enumerate(entries)]
    frame = spark.createDataFrame(
        rows, "extraction_id int, node_kind string, path string, sort_order int, review_state string, corrected_value string, extracted_value string"
    )
    return review.derive_data(frame, **options).first()["data"]


def plain_data(entries):
    root = {}
    for path, value in entries:
        at, tokens = root, []
        for part in path.split("."):
            name, *indexes = part.replace("]", "").split("[")
            tokens += [name, *map(int, indexes)]
        for token, following in zip(tokens, [*tokens[1:], None], strict=True):
            if isinstance(at, list):
                at.extend([None] * (token + 1 - len(at)))
                known = at[token] is not None
            else:
                known = token in at
            if following is None:
                at[token] = value
            elif not known:
                at[token] = [] if isinstance(following, int) else {}
            at = at[token]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def test_nested_data_is_that_of_a_walk(spark):
    rng = random.Random(2)
    # All paths have five tokens and a place's children are of one kind, so that paths do not conflict.
    for _ in range(6):
        kinds, paths = {}, set()
        while len(paths) < 40:
            path = rng.choice("ab")
            for _ in range(4):
                in_array = kinds.setdefault(path, rng.random() < 0.4)
                path += f"[{rng.randrange(4)}]" if in_array else f".{rng.choice('pqr')}"
            paths.add(path)
        entries = [(p, f"v{i}") for i, p in enumerate(rng.sample(sorted(paths), 40))]
        assert data(spark, entries) == plain_data(entries)


def test_holes_of_any_length(spark):
    assert data(spark, [("a[2]", "x"), ("a[0]", "y")]) == '{"a":["y",null,"x"]}'
    assert data(spark, [("a[2000000000].x", "1"), ("a[0].x", "2")]) == '{"a":[{"x":"2"},{"holes":1999999999},{"x":"1"}]}'
    assert data(spark, [("a[3]", "1")], longest_hole=2) == '{"a":[{"holes":3},"1"]}'


def test_deep_paths_do_not_change_the_plan(spark):
    deep = ".".join(f"k{i}" for i in range(500))
    got = data(spark, [("a", "1"), (deep, "2"), (f"{deep}x", "3")])
    assert got.startswith('{"a":"1","k0":{"k1":') and got.endswith('"k499":"2","k499x":"3"' + "}" * 500)

    def plan(path):
        frame = spark.createDataFrame([(1, "scalar", path, 1, "confirmed", None, "v")],
            "extraction_id int, node_kind string, path string, sort_order int, review_state string, corrected_value string, extracted_value string")
        text = review.derive_data(frame)._jdf.queryExecution().executedPlan().toString()
        return [re.findall(r"[A-Z]\w+", line)[:1] for line in text.splitlines()]

    assert plan("a") == plan(deep)
    assert plan("a").count(["Exchange"]) == 1


def test_conflicting_paths(spark):
    assert data(spark, [("a", "1"), ("a", "2")]) == '{"a":"2"}'
    assert data(spark, [("a.b", "1"), ("a", "2"), ("c", "3")]) == '{"a":"2","c":"3"}'
    assert data(spark, [("a[0]", "1"), ("a.b", "2")]) == '{"a":["1"]}'
    assert data(spark, [("a.b", "1"), ("a[0]", "2")]) == '{"a":{"b":"1","0":"2"}}'
    assert data(spark, [("[0].x", "1"), ("a[x]", "2")]) == '{"[0]":{"x":"1"},"a[x]":"2"}'
