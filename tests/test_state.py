"""Live state as a table of changed keys, and places in a whole order."""

import glob

import pytest
from pyspark.sql import functions as F

from docrecords.operators import records
from docrecords.streaming import events


def state(rows):
    out = {}
    for doc, event, kind in rows:
        n, last = out.get(doc, (0, (-1, "")))
        out[doc] = (n + 1, max(last, (event, kind)))
    return {d: (n, last[1]) for d, (n, last) in out.items()}


@pytest.mark.parametrize("compact_every", [100, 2])
def test_a_batch_writes_only_its_keys(spark, tmp_path, compact_every):
    schema = "doc_id long, event_id long, kind string, created_at long"
    parts = [[(d, 100 * n + d, f"k{(d + n) % 3}") for d in docs] for n, docs in enumerate([range(20), [3, 4, 4], [21], [3, 21, 5]])]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for rows in parts:
        spark.createDataFrame([(*r, r[1]) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = events.document_state(source, ("k0", "k1"))
        events.keep_state(states, f"{tmp_path}/out", f"{tmp_path}/check", compact_every=compact_every).awaitTermination()
    got = {r.doc_id: (r.n_events, r.last_kind) for r in events.current_state(spark, f"{tmp_path}/out").collect()}
    assert got == state([r for rows in parts for r in rows])
    written = [spark.read.parquet(p).count() for p in sorted(glob.glob(f"{tmp_path}/out/rows/version=*"))]
    assert written == ([20, 2, 1, 3] if compact_every == 100 else [20, 2, 21, 3])


def test_places_in_the_whole_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 10).alias("total"))
    key = lambda r: (r.total is None, -(r.total or 0), r.doc_id)
    want = [r.doc_id for r in sorted(rows.collect(), key=key)]
    order = records.sort_columns("total", "desc")
    found = records.ranked(rows.repartition(5), order)
    assert [r.doc_id for r in sorted(found.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in found.collect()) == list(range(1, 1001))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert records.ranked(rows.limit(0), order).collect() == []


def test_stage_tables_of_a_run_are_removed(spark):
    from docrecords.plans.stages import stage, temporary_stages

    kept = stage(spark.range(3), "kept")
    with pytest.raises(RuntimeError), temporary_stages():
        outer = stage(spark.range(4), "outer")
        with temporary_stages():
            inner = stage(spark.range(5), "inner")
        assert outer.count() == 4
        raise RuntimeError
    counts = [spark.read.schema("id long").parquet(t.stage_path).count() for t in (kept, outer, inner)]
    assert counts == [3, 0, 0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from docrecords.plans import stages

    monkeypatch.setattr(stages, "checkpoint_dir", lambda _: None)

    class Session:
        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        stages.stage_root(Session)
