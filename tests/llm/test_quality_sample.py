"""The labelled sample of the quality classifier: one row per key, in a fixed order."""

import numpy as np

from docrecords.llm import neighbour_quality


def test_packed_terms_round_trip():
    for text in (None, b"", b"some Words 12, again words\nnext line"):
        counts = neighbour_quality.term_counts(text)
        out = np.zeros_like(counts)
        neighbour_quality.unpack(neighbour_quality.packed(counts), out)
        assert (out == counts).all()


def test_repeated_ids_do_not_crowd_out_labels(spark):
    rows = [(1, f"text {i} of the first") for i in range(6)] + [(2, "a text of the second")]
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, label int")
    models = [
        neighbour_quality.fit(spark.createDataFrame(r, "doc_id long, text string"), labels, sample=2)
        for r in (rows, rows[::-1])
    ]
    assert all(sorted(m.labels) == [0, 1] for m in models)
    assert (models[0].vectors == models[1].vectors).all()
