"""Checks over whole tables leave no row of their tables out; their SQL is compared in test_checks."""

import pytest

import __spark_entry__ as entry
from checks import views


def ids(df, column="doc_id"):
    return {r[0] for r in df.select(column).distinct().collect()}


@pytest.mark.parametrize("name", ["m07_schema_match", "x12_extract_with_schema", "x14_fill_missing", "x15_overlay_candidates"])
def test_every_document_meets_a_schema(name, spark, sf):
    texts = ids(views.texts(spark, sf))
    assert any(i < 0 for i in texts)
    assert ids(entry.queries()[name](spark, sf)) == texts


def test_tables_of_real_documents_are_matched(spark, sf):
    from checks import q_structure

    # Version 1 knows every header; version 0, of even ids, only three.
    wanted = {i for i in ids(q_structure.cells(spark, sf)) if i < 0 and i % 2}
    for name in ("x13_match_table", "x13b_extract_arrays"):
        assert wanted and wanted <= ids(entry.queries()[name](spark, sf))


def test_best_match_covers_real_documents(spark, sf):
    assert any(i < 0 for i in ids(entry.queries()["m08_best_match"](spark, sf)))


@pytest.mark.parametrize("name", ["t01_amounts", "t02_mentions", "t04_left_over_terms"])
def test_turns_of_every_role_are_tagged(name, spark, sf):
    other = spark.read.parquet(f"{sf}/conversations.parquet").filter("role <> 'user' AND trim(text) <> ''")
    wanted = {f"c{r.conv_id}_{r.turn}" for r in other.collect()}
    assert wanted and wanted <= ids(entry.queries()[name](spark, sf), "id")


def test_resume_rows_keep_phones(spark, sf):
    assert "phone" in ids(entry.queries()["x23_resume_rows"](spark, sf), "column_key")


def test_every_kind_of_field_is_committed(spark, sf):
    from checks import q_structure

    rows = q_structure.every_field(spark, sf).select("stage", "minor", "doc_id", "path").collect()
    assert {(r.stage, r.stage == 2 and r.minor) for r in rows} == {(0, False), (1, False), (2, 0), (2, 1), (3, False)}
    got = entry.queries()["r11_commit_fields"](spark, sf).select("extraction_id", "path").collect()
    assert sorted((r.doc_id, r.path) for r in rows) == sorted((r.extraction_id, r.path) for r in got)
