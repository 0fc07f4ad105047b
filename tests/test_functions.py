from pyspark.sql import functions as F

from docrecords.functions import money, paths, text, typing


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_money(spark):
    values = ["1234.567", "10.005", "-0.004", "-10.005", " 5 ", "1.99999", "x", "1,2"]
    assert column(spark, values, money.normalize_decimal) == [
        "1234.57", "10.01", "0.00", "-10.01", "5.00", "2.00", None, None,
    ]
    equal = column(spark, ["10.002"], lambda v: money.equals_cents(money.to_money(v), money.to_money(F.lit("10.004"))))
    assert equal == [True]


def test_money_cuts_beyond_four_digits(spark):
    assert column(spark, ["1.00005"], lambda v: money.to_money(v).cast("string")) == ["1.0000"]
    product = lambda v: money.multiply_money(money.to_factor(v), money.to_factor(F.lit("0.3333"))).cast("string")
    assert column(spark, ["-0.3333"], product) == ["-0.1110"]


def test_slugs_and_labels(spark):
    assert column(spark, ["Invoice No.", "  ", "Über date", "a_b-c 2nd"], text.slug_camel) == [
        "invoiceNo", "field", "berDate", "aBC2nd",
    ]
    assert column(spark, ["Invoice No.", "--", " A  b "], text.slug_snake) == ["invoice_no", "schema", "a_b"]
    assert column(spark, ["invoice_number", "invoiceNumber", "--"], text.humanize_label) == [
        "Invoice number", "Invoice Number", "--",
    ]


def test_type_inference(spark):
    values = ["USD", "2024-01-02", "1/2/24", "Yes", "1,234", "$5", "$5.5x", "1,234.50", "x" * 121, "", "-12.5"]
    assert column(spark, values, typing.infer_type) == [
        "currency", "date", "date", "boolean", "integer", "currency", "string", "decimal", "text", "string", "decimal",
    ]


def test_normalize_keeps_unparsed_text(spark):
    assert column(spark, ["1,234", "abc"], lambda v: typing.normalize_value(F.lit("integer"), v)) == ["1234", "abc"]
    assert column(spark, ["$ 1,234.5", "EUR"], lambda v: typing.normalize_value(F.lit("currency"), v)) == ["1234.5", "EUR"]
    assert column(spark, ["YES", "no", "so"], lambda v: typing.normalize_value(F.lit("boolean"), v)) == ["true", "false", "so"]


def test_schema_hash(spark):
    def reference(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out or "0"

    values = ["vendor:string|total:decimal", "a:b" * 60, ""]
    assert column(spark, values, typing.schema_hash) == [reference(v) for v in values]


def test_paths(spark):
    rows = column(spark, ["lineItems[2].total", "total", "a.b[1].c"], paths.parse_path)
    assert [tuple(r) if r else None for r in rows] == [("lineItems", 2, "total"), None, None]


def test_html(spark):
    html = (
        "<head><title>x</title></head><h2>A <b>big</b>\n title</h2><!-- c --><p>one<br/>two&nbsp;&#233;&#x41;&unknown;&amp;lt;</p>"
        "<table>\n <tr><th>K</th><th>V</th></tr>\n <tr><td>a</td><td>1</td></tr></table><ul><li>x</li></ul><script>bad()</script>"
    )
    assert column(spark, [html], text.html_to_text) == [
        "## A big\ntitle\n\none\ntwo éA&unknown;&lt;\n\nK \tV\na \t1\n\n- x"
    ]


def test_escape_like(spark):
    assert column(spark, ["50%_\\"], text.escape_like) == ["50\\%\\_\\\\"]


def test_money_product_keeps_every_digit(spark):
    from decimal import ROUND_DOWN, Decimal, localcontext

    pairs = [
        ("12345678901234567890", "3.1234"), ("-7", "0.0001"), ("0.0003", "0.0009"), ("-2.5", "-4"),
        ("99999999999999999", "9999999999999999.9999"), ("-0.3333", "0.9999"), ("0", "-5"),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", money.multiply_money(money.to_factor(F.col("a")), money.to_factor(F.col("b"))).alias("p")
    )
    with localcontext() as context:
        context.prec = 80
        for r in rows.collect():
            assert r.p == (Decimal(r.a) * Decimal(r.b)).quantize(Decimal("0.0001"), ROUND_DOWN), r
    huge = spark.createDataFrame([("9" * 30, "9" * 30)], "a string, b string")
    product = money.multiply_money(money.to_factor(F.col("a")), money.to_factor(F.col("b")))
    assert huge.select(product.alias("p")).first().p is None


def test_long_values_and_deep_trees_are_whole(spark):
    from docrecords.functions.text import slug_camel, slug_snake
    from docrecords.functions.typing import typed_index
    from docrecords.operators import canonical, schemas

    long = spark.createDataFrame([("word " * 4000,)], "v string")
    row = long.select(
        typed_index(F.lit("text"), F.col("v"))["value_text"].alias("t"),
        slug_camel(F.col("v")).alias("c"),
        slug_snake(F.col("v")).alias("s"),
    ).first()
    assert len(row.t) == 20000 and len(row.c) == 16000 and len(row.s) == 19999
    node = '{"key": "k6", "label": "{", "nodeKind": "scalar", "type": "string"}'
    for level in range(5, 0, -1):
        node = f'{{"key": "k{level}", "label": "L", "nodeKind": "object", "children": [{node}]}}'
    versions = spark.createDataFrame([("v", f"[{node}]")], "schema_version_id string, definition string")
    assert [r.leaf_key for r in schemas.schema_leaves(versions).collect()] == ["k1.k2.k3.k4.k5.k6"]
    quotes = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, quote string")
    parses = spark.createDataFrame([(1, "x a")], "doc_id int, text string")
    found = {r.doc_id: r.grounding_status for r in canonical.resolve_quotes(quotes, parses).collect()}
    assert found == {1: "grounded", 2: "unresolved"}


def test_ingest_reads_delimited_files_and_a_second_stream_adds(spark, tmp_path):
    from docrecords.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('Name, Note\r\n"Doe, J","x ""y""\nz"\r\n,,\r\n1,,3\r\n5" pipe,2\r\n')
    (tmp_path / "in" / "b.html").write_text("<script>f()</script>")
    (tmp_path / "in" / "c.txt").write_text("same")
    for run in ("one", "two"):
        (tmp_path / "in" / f"{run}.txt").write_text(f"new {run}")
        ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/{run}").awaitTermination()
    rows = {r.original_filename: r for r in spark.read.parquet(f"{tmp_path}/store/documents").collect()}
    assert sorted(rows) == ["a.csv", "b.html", "c.txt", "one.txt", "two.txt"]
    assert rows["a.csv"].text.strip() == 'Name\tNote\nDoe, J\tx "y" z\n1\t\t3\n5 pipe,2'
    assert (rows["b.html"].reject_code, rows["b.html"].processing_status) == ("EMPTY_DOCUMENT", "failed")
