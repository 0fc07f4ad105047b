import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docrecords.functions.arrays import replace_matches, scan
from docrecords.operators import canonical, resume, structure
from docrecords.plans.structuring import committed_fields, structure_texts


def lines_of(spark, text):
    return canonical.structure_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))


def test_scan_crosses_chunks(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("a"))
    out = df.select(scan(F.col("a"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int").alias("r")).first()["r"]
    assert out == [sum(range(1, i)) for i in range(1, 1001)]
    empty = spark.range(1).select(scan(F.array().cast("array<int>"), F.lit(0), lambda s, x: s, lambda s, x: s, "int"))
    assert empty.first()[0] == []


def test_replace_matches(spark):
    df = spark.createDataFrame([("a1b22c",)], "s string")
    assert df.select(replace_matches(F.col("s"), r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))).first()[0] == "a<1>b<22>c"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ab |:\t\n#-é😀", max_size=60))
def test_lines_cover_the_text(spark, text):
    rows = canonical.explode_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    rows = sorted(rows, key=lambda r: r["line_no"])
    assert "\n".join(r["text"] for r in rows) == text
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)


def pairs(spark, line):
    kv = canonical.key_values(lines_of(spark, line)).orderBy("pair_no").collect()
    assert all(line[r["start"] : r["end"]] == r["value"] for r in kv)
    return [(r["key"], r["value"]) for r in kv]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Invoice No: FLP/BLR/2425/544356 Invoice Date: 08-01-2025", [("Invoice No", "FLP/BLR/2425/544356"), ("Invoice Date", "08-01-2025")]),
        ("Key One: Key Two: value", [("Key Two", "value")]),
        ("Ref 12: none", []),
        ("see Total: 5", [("see Total", "5")]),
        ("1 Total: 5", []),
        ("Time 10:30", []),
        ("Name:", []),
        ("  Name: Ann ", [("Name", "Ann")]),
        ("Name： Ann", [("Name", "Ann")]),
        (" ".join(["word"] * 11) + ": v", []),
        ("id: 7", [("id", "7")]),
        ("ab: 7", []),
    ],
)
def test_key_values(spark, line, expected):
    assert pairs(spark, line) == expected


def test_table_cells_and_lone_rows(spark):
    text = "# Sales\nName  Role  Pay\nAnn  Dev  5\nBo    7\n\nsolo  row\nend."
    lines = lines_of(spark, text)
    kinds = {r["line_no"]: r["kind"] for r in lines.collect()}
    assert kinds == {0: "heading", 1: "table-row", 2: "table-row", 3: "table-row", 5: "line", 6: "paragraph"}
    cells = canonical.table_cells(lines).orderBy("row_no", "column_no").collect()
    # Empty cells vanish in space-separated rows, so values shift left and the row is filled up.
    assert [(r["header"], r["value"]) for r in cells] == [
        ("Name", "Ann"), ("Role", "Dev"), ("Pay", "5"), ("Name", "Bo"), ("Role", "7"), ("Pay", ""),
    ]
    assert all(r["value"] == "" or text[r["start"] : r["end"]] == r["value"] for r in cells)


def test_grounding(spark):
    parses = spark.createDataFrame([(1, "Total:    4200.00\n  and  More")], "doc_id bigint, text string")
    quotes = spark.createDataFrame(
        [(1, "Total: 4200.00"), (1, "AND MORE"), (1, "4200.00"), (1, "nope"), (1, " ")], "doc_id bigint, quote string"
    )
    rows = {r["quote"]: (r["grounding_status"], r["start"], r["end"]) for r in canonical.resolve_quotes(quotes, parses).collect()}
    assert rows["Total: 4200.00"] == ("grounded", 0, 17)
    assert rows["4200.00"] == ("grounded", 10, 17)
    # White space before a loose hit collapses to its first character.
    assert rows["AND MORE"] == ("grounded", 18, 29)
    assert rows["nope"][0] == "unresolved" and rows[" "][0] == "none"


def test_unique_keys_skip_taken_ones(spark):
    bases = ["total", "total2", "total", "total", "other", "total2", "other"]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bases)], "doc_id bigint, order int, base string")
    keys = [r["key"] for r in structure.unique_keys(df).orderBy("order").collect()]
    used, expected = set(), []
    for b in bases:
        k, n = b, 2
        while k in used:
            k, n = f"{b}{n}", n + 1
        used.add(k)
        expected.append(k)
    assert keys == expected


def test_structure_texts_end_to_end(spark):
    text = "# Order 7\nCustomer Name: Ann Lee\nTotal: $12.50\n\nItems\nItem  Qty\nring  2\nbox  3\n\nNotes\nplain words here.\n- first\n- second"
    done = structure_texts(spark.createDataFrame([(1, text), (2, "one. two.")], "doc_id bigint, text string"))
    fields = {r["path"]: (r["value"], r["type"]) for r in done.fields.filter("doc_id = 1").collect()}
    assert fields["customerName"] == ("Ann Lee", "string")
    assert fields["total"] == ("12.50", "currency")
    assert fields["items[1].qty"] == ("3", "integer")
    assert fields["notes"][0] == "plain words here."
    assert fields["notesEntries[1].text"][0] == "second"
    status = {r["doc_id"]: r["status"] for r in done.quality.collect()}
    assert status[1] == "succeeded"
    stored = committed_fields(done.fields.withColumns({"extraction_id": F.col("doc_id"), "field_id": F.hash("path"), "sort_order": F.col("major")}), "order")
    states = {r["path"]: r["review_state"] for r in stored.filter("doc_id = 1").collect()}
    assert states["customerName"] == "auto_accepted" and states["total"] == "needs_review"


def test_resume_experience_rules(spark):
    text = "\n".join([
        "Ann Lee", "ann@example.com", "Experience", "Globex Corp", "Software Engineer 2019 - 2021", "- built things", "Data Analyst 2017 - 2019",
        "- made reports.", "Initech, Ltd", "loose words at the end of it.", "Education", "State University 2010 - 2014", "BSc Physics", "Skills", "Tools: Spark",
    ])
    lines = lines_of(spark, text)
    texts = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = resume.resume_rows(texts, lines).collect()
    got = {(r["array_key"], r["row_index"], r["column_key"]): r["value"] for r in rows}
    assert got[(None, None, "candidateName")] == "Ann Lee"
    assert got[("experience", 0, "organization")] == "Globex Corp"
    assert got[("experience", 0, "role")] == "Software Engineer"
    assert got[("experience", 0, "period")] == "2019 - 2021"
    assert got[("experience", 1, "organization")] == "Globex Corp"
    # The roleless entry at the end extends the last description.
    assert got[("experience", 1, "description")] == "made reports.\nInitech, Ltd\nloose words at the end of it."
    assert got[("education", 0, "institution")] == "State University"
    assert got[("skills", 0, "category")] == "Tools"
    assert all(re.search(r"\S", v) for v in got.values())
