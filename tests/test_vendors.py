"""Vendors found in texts, against trying every vendor with every text."""

import random

import pytest

from docrecords.operators import tagging


def tried(text, vendors):
    hits = []
    for vendor in vendors:
        words = [w for w in vendor.lower().split() if len(w) > 2]
        if words and all(w in text.lower() for w in words):
            hits.append((-len(vendor), vendor))
    return min(hits)[1] if hits else None


@pytest.mark.parametrize("cells", [tagging.FILTER_CELLS, 8])
def test_vendors_are_those_of_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(tagging, "FILTER_CELLS", cells)
    rng = random.Random(3)
    words = ["acme", "Globe", "co", "of", "Ärzte", "north", "ltd", "inc", "tea", "steamship"]
    vendors = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(60)} | {"", "a b"})
    texts = [(str(i), "".join(rng.choices([*words, "xx", "GLOBEtrotter", "teapot", " ", " ", ", "], k=12))) for i in range(150)]
    texts += [("e", ""), ("s", "te")]
    got = tagging.match_vendors(
        spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(v,) for v in vendors], "vendor_name string")
    )
    want = {i: tried(t, [v for v in vendors if v]) for i, t in texts}
    assert {r.id: r.vendor for r in got.collect()} == {i: v for i, v in want.items() if v}
    assert any(want.values())


def test_no_vendors(spark):
    texts = spark.createDataFrame([("1", "some text")], "id string, text string")
    assert tagging.match_vendors(texts, spark.createDataFrame([], "vendor_name string")).collect() == []
