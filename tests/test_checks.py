"""Every query of the record operators against its SQL at the smallest scale, and plan properties.

The training-data operators have tests of their own in `tests/llm`.
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import normal


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(cur.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_structure_does_not_shuffle(spark):
    from docrecords.operators import canonical

    texts = spark.createDataFrame([(1, "a: b")], "doc_id bigint, text string")
    for df in (canonical.structure_lines(texts), canonical.key_values(canonical.structure_lines(texts))):
        assert "Exchange" not in plan(df)


def test_rules_shuffle_once(spark, sf):
    from checks import views
    from docrecords.operators import rules

    fields = views.all_typed(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(rules.validate(fields)).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_search_reads_fields_once_and_pushes_paths_down(spark, sf):
    from checks import views
    from docrecords.operators import records

    fields = views.fields(spark, sf)
    rows = records.match_records(views.docs(spark, sf), fields, views.extractions(spark, sf), records.RecordFilter(currency="EUR"))
    text = plan(rows)
    assert text.count("/fields") == 1
    assert "PushedFilters: [In(path" in text
