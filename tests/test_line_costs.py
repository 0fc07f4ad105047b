"""What the line steps must not do again: compute items per chunk, start a helper per group, repeat leaves per document."""

import contextlib
import io

from pyspark.sql import functions as F

from docrecords.functions import fixed as V
from docrecords.functions.arrays import scan
from docrecords.operators import canonical, structure


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_scan_names_its_items_once(spark):
    items = F.split("text", "\n", -1)
    out = scan(items, F.lit(0), lambda s, x: s + F.length(x), lambda s, x: s, "int")
    df = spark.createDataFrame([("a\nbc\nd",), ("",)], "text string").select(out.alias("o"))
    assert _plan(df).split("== Analyzed")[0].count("split") == 1
    assert [r.o for r in df.collect()] == [[0, 1, 3], [0]]


def test_white_space_class_is_the_literal(spark):
    points = [*range(1, 0xD800), *range(0xE000, 0x10000)]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    found = rows.filter(F.col("c").rlike(f"^{V.WS}\\z")).collect()
    assert {r.c for r in found} == set(V.WS_LITERAL)
    assert rows.filter(F.col("c").rlike(f"^{V.NOT_WS}\\z")).count() == len(points) - len(V.WS_LITERAL)


def test_gapped_cells_and_marks(spark):
    lines = ["a b  c", " a\tb ", "a \t  b c　d", "\t\t", "", "a  b", "x y\tz"]
    want = [["a b", "c"], ["a", "b"], ["a", "b c　d"], [], [], ["a", "b"], ["x y", "z"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", canonical.split_cells(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(lines))] == want
    marked = spark.createDataFrame([("Total: 1\u00012 Currency: USD",), ("Total: 12 Currency: USD",)], "t string")
    pairs = marked.select(canonical.line_pairs(F.col("t")).alias("p")).collect()
    assert [[(p.key, p.value) for p in r.p] for r in pairs] == [
        [("Total", "1\u00012"), ("Currency", "USD")], [("Total", "12"), ("Currency", "USD")]
    ]


def test_keys_are_numbered_without_a_helper_per_group(spark):
    rows = [(d, i, b, "v") for d in range(50) for i, b in enumerate(["a", "a2", "a", "b", "a", "b"])]
    out = structure.unique_keys(spark.createDataFrame(rows, "doc_id int, order int, base string, value string"))
    assert "FlatMapGroupsInArrow" not in _plan(out)
    for d in (0, 49):
        keys = [r.key for r in sorted(out.filter(F.col("doc_id") == d).collect(), key=lambda r: r.order)]
        assert keys == ["a", "a2", "a3", "b", "a4", "b2"]


def test_leaves_meet_cells_in_the_row(spark):
    text = "Item  Qty  Qty\nbolt  1  2\nnut  3\n"
    lines = canonical.structure_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assigned = spark.createDataFrame([(1, 0)], "doc_id long, schema_version_id int")
    names = "schema_version_id int, array_key string, leaf_key string, key string, label string, field_group string, type string, required boolean, material boolean"
    leaves = spark.createDataFrame(
        [(0, "g", f"g[].{k}", k, n, "g", "string", False, True) for k, n in (("item", "Item"), ("amount", "Qty"), ("gone", "Gone"))], names
    )
    out = structure.extract_arrays(lines, assigned, leaves)
    assert {(r.path, r.presence_state, r.value) for r in out.collect()} == {
        ("g[0].item", "present", "bolt"), ("g[0].amount", "present", "2"), ("g[0].gone", "not_found", None),
        ("g[1].item", "present", "nut"), ("g[1].amount", "not_found", None), ("g[1].gone", "not_found", None),
    }
    # The leaves are unfolded last: nothing is shuffled for each cell of each leaf.
    assert "leaf_key" not in " ".join(x for x in _plan(out).split("== Physical")[1].splitlines() if "Exchange hashpartitioning" in x and "row_no" in x)


def test_the_gate_counts_pairs_without_placing_them(spark):
    from docrecords.operators import canonical, structure

    rows = ["a: b", "Total: 5  Currency: USD", "Name:  Total: 7", " Owner: x", "Name: ", "plain", "Name: \u0001 Total: 1", ""]
    lines = spark.createDataFrame([(r,) for r in rows], "text string")
    text = lines["text"]
    for row in lines.select(canonical.pair_count(text).alias("n"), canonical.line_pairs(text).alias("pairs")).collect():
        assert row["n"] == len(row["pairs"])
    texts = spark.createDataFrame([(1, "Name: x")], "doc_id bigint, text string")
    plan = structure.narrative_gate(canonical.structure_lines(texts))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(ltrim" not in plan


def test_values_are_trimmed_and_labels_searched_once(spark):
    from docrecords.functions import text, typing

    df = spark.createDataFrame([("Invoice No.",)], "t string")
    one = F.col("t")

    def parsed(c):
        return _plan(df.select(c)).split("== Analyzed")[0]

    for made, name in (
        (text.slug_camel(one), "regexp_replace"), (typing.infer_type(one), "trim"), (canonical.line_pairs(one), "regexp_extract_all")
    ):
        assert parsed(made).lower().count(name) == 1, name
    # Once for the bounds of the label, then words, white space and case.
    assert parsed(text.humanize_label(one)).lower().count("regexp_replace") == 3


def test_label_look_ahead_takes_what_it_took(spark):
    short = V.MAX_LABEL_CHARS - 1
    rows = ["Total : 1", "Total\t : 1", "a" * (short + 1) + ": 1", "b" * (short + 2) + ": 1", "c" * short + "   : 1",
            "Due Date   :  : 2  Total:  3", "Name （x）： y", "x Total: 1", "No: 1 id： 2", "a b c", "Total:1", "Total (net) &c.: 5"]
    rows += ["d" * k + " " * n + ": 1" for k in range(short - 2, short + 3) for n in range(4)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    found = df.select(
        F.regexp_extract_all("t", F.lit(canonical.LABEL), F.lit(0)).alias("now"),
        F.regexp_extract_all("t", F.lit(canonical.LABEL), F.lit(1)).alias("keys"),
        F.regexp_extract_all("t", F.lit(canonical.LABEL.replace("}+" + V.WS + "*+", "}?" + V.WS + "*")), F.lit(0)).alias("before"),
        F.transform(canonical.line_pairs(F.col("t")), lambda p: p["key"]).alias("pairs"),
    ).collect()
    assert "}?" not in canonical.LABEL
    for r in found:
        assert r.now == r.before and r.pairs == r.keys
    assert sum(len(r.now) for r in found) > 20


def test_cells_of_a_very_long_line(spark):
    # Before, the pattern needed the stack for every word, and the executor ended with an overflow.
    df = spark.createDataFrame([("word " * 300_000 + " x\ty",)], "t string")
    cells = F.transform(canonical.split_cells(F.col("t")), F.length)
    assert df.select(cells.alias("c")).first().c == [5 * 300_000 - 1, 1, 1]
