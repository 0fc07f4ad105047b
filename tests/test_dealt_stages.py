"""Stage tables in buckets of the document: entries and table fields are made without a shuffle, and cells are read once."""

from pyspark.sql import functions as F

from docrecords.operators import canonical, structure
from docrecords.plans.stages import dealt_stage, temporary_stages

TEXT = "Total: {0}\n\nItem  Qty  Qty\nbolt  {0}  2\nnut  3\n\nNOTES AND TERMS\nplain words here.\n- one {0}\n- two"


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def _texts(spark, n=40):
    rows = [(None if i == 3 else i, TEXT.format(i)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_entries_and_table_fields_are_not_shuffled(spark):
    texts = _texts(spark)
    plain = canonical.structure_lines(texts)
    lines = dealt_stage(canonical.structure_lines(texts.repartition(8, "doc_id")), "lines", "doc_id", 8)
    assert _rows(lines) == _rows(plain)
    entries = structure.keyed_candidates(lines)
    assert _exchanges(entries) == []
    assert _rows(entries) == _rows(structure.keyed_candidates(plain))
    # As before, prose and lists of a document without an id are not gated in.
    assert {r.order.stage for r in entries.filter("doc_id is null").collect()} == {0, 1}
    keyed = dealt_stage(entries, "keyed", "doc_id", 8)
    fields = structure.fields_from_tables(canonical.table_cells(lines), keyed)
    assert _exchanges(fields) == []
    assert fields._jdf.queryExecution().executedPlan().toString().count("posexplode") == 1
    assert _rows(fields) == _rows(structure.fields_from_tables(canonical.table_cells(plain), structure.keyed_candidates(plain)))
    paths = {r.path for r in fields.filter("doc_id = 1").collect()}
    assert paths == {f"records[{i}].{k}" for i in (0, 1) for k in ("item", "qty", "qty2")}


def test_a_discarded_dealt_table_is_empty(spark):
    with temporary_stages():
        kept = dealt_stage(spark.range(50).select(F.col("id").alias("doc_id")), "ids", "doc_id", 8)
        assert kept.count() == 50 and kept.columns == ["doc_id"]
    assert spark.table(kept.bucket_table).count() == 0
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"
