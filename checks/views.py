"""Inputs derived from the test tables: documents, field rows, line items, rendered texts.

The same definitions in SQL are in `checks.oracle`.  They belong to the checks, not to the library.
"""

from functools import cache, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docrecords.functions.typing import effective_value, typed_index
from docrecords.operators import canonical, rules
from docrecords.plans.stages import bucket_count, dealt_stage, stage
from docrecords.session import stored_bytes


def view(fn):
    """Keep the (lazy) plan of a view per session and folder, so that it is built once."""
    plans = {}

    @wraps(fn)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (id(spark), sf)
        if key not in plans:
            plans[key] = (spark, fn(spark, sf))
        return plans[key][1]

    return get


@cache
def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _read(spark, sf, name)


def money_text(col: Column) -> Column:
    cents = F.round(col * 100).cast("bigint")
    return cents_text(cents)


def cents_text(cents: Column) -> Column:
    whole = F.floor(cents / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


@view
def docs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    ext = F.element_at(
        F.array(*[F.lit(x) for x in ("pdf", "txt", "md", "csv", "html", "bin")]),
        (k % 6 + 1).cast("int"),
    )
    no = F.lpad(k.cast("string"), 8, "0")
    return table(spark, sf, "orders").select(
        k.alias("doc_id"),
        F.concat(F.lit("INV_"), no, F.lit("."), ext).alias("original_filename"),
        F.when(k % 12 == 5, "text/plain; charset=utf-8").otherwise("application/octet-stream").alias("mime_type"),
        F.when(k % 4 == 0, "document").otherwise("invoice").alias("document_type"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, "Purchase")).otherwise("Invoice").alias("schema_name"),
        (k % 20 == 3).alias("is_failed"),
        F.when(k % 20 == 1, "queued").when(k % 20 == 2, "processing").when(k % 20 == 3, "failed")
        .when(k % 20 == 4, "partial").otherwise("succeeded").alias("processing_status"),
        F.when(status == "F", "approved").when(status == "P", "reopened").otherwise("needs_review")
        .alias("review_status"),
        F.when(k % 40 == 3, "PARSE_FAILED").when(k % 40 == 23, "EMPTY_DOCUMENT").alias("failure_code"),
        F.when(k % 20 != 1, k * 2).alias("current_extraction_id"),
        F.when(status == "F", k * 2).when(status == "P", k * 2 + 1).alias("last_approved_extraction_id"),
        F.when(status == "F", F.date_format(F.date_add(F.to_date("o_orderdate"), 9), "yyyy-MM-dd"))
        .alias("approved_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 50).cast("int")), "yyyy-MM-dd")
        .alias("updated_at"),
    ).drop("is_failed")


@view
def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Current extraction per order, and an older approved one for reopened orders."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    snapshot = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return o.select("*", F.explode(snapshot).alias("snap")).select(
        (k * 2 + F.col("snap")).alias("extraction_id"),
        k.alias("doc_id"),
        F.when(k % 4 == 0, "purchase").otherwise("invoice").alias("schema_key"),
        F.concat(F.lit("sv"), (k % 7).cast("string")).alias("schema_version_id"),
        (F.lit(1) + (k % 3)).cast("int").alias("version"),
        "snap",
        "o_custkey",
        "o_totalprice",
        "o_orderdate",
        "o_orderstatus",
        "o_orderpriority",
    )


# path, label, group, type, required, material
FIELD_DEFS = (
    ("vendorName", "Vendor", "identity", "string", True, False),
    ("invoiceNumber", "Invoice number", "identity", "string", True, False),
    ("currency", "Currency", "identity", "currency", True, False),
    ("invoiceDate", "Invoice start date", "dates", "date", True, False),
    ("dueDate", "Due date", "dates", "date", False, False),
    ("subtotal", "Subtotal", "amounts", "decimal", False, True),
    ("tax", "Tax", "amounts", "decimal", False, True),
    ("total", "Total", "amounts", "decimal", True, True),
    ("paid", "Paid", "metadata", "boolean", False, False),
    ("priority", "Priority", "metadata", "string", False, False),
)


@view
def raw_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Ten scalar field rows per extraction; every sixteenth order has line items only."""
    e = extractions(spark, sf)
    c = table(spark, sf, "customer").join(
        F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select("c_custkey", "c_name", "r_name")
    x = F.col("extraction_id")
    k = F.col("doc_id")
    orders = e.join(c, F.col("o_custkey") == F.col("c_custkey")).filter(k % 16 != 0)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") - F.col("snap") * 10000
    orders = orders.withColumns({"cents": cents, "day": F.to_date("o_orderdate")})
    orders = orders.withColumn("tax", F.floor(F.col("cents") / 10).cast("bigint"))
    value = {
        "vendorName": F.col("c_name"),
        "invoiceNumber": F.concat(F.lit("AC-"), F.lpad(k.cast("string"), 7, "0")),
        "currency": F.when(F.col("r_name") == "AMERICA", "USD").when(F.col("r_name") == "EUROPE", "EUR")
        .when(F.col("r_name") == "AFRICA", "GBP").when(F.col("r_name") == "ASIA", "JPY"),
        "invoiceDate": F.when(x % 29 == 0, F.date_format("day", "MM/dd/yyyy")).otherwise(
            F.col("day").cast("string")
        ),
        "dueDate": F.date_add("day", F.when(k % 17 == 0, F.lit(-5)).otherwise(F.lit(30))).cast("string"),
        "subtotal": cents_text(F.col("cents") - F.col("tax")),
        "tax": cents_text(F.col("tax") + F.when(k % 11 == 0, 3).otherwise(0)),
        "total": F.when(x % 23 == 0, "n/a").otherwise(cents_text(F.col("cents"))),
        "paid": F.when(k % 3 == 0, "yes").when(k % 3 == 1, "No").otherwise("maybe"),
        "priority": F.col("o_orderpriority"),
    }
    samples = F.array(*[value[d[0]] for d in FIELD_DEFS])
    flat = orders.select(
        "extraction_id", "doc_id", "schema_key", F.posexplode(samples).alias("sort_order", "sample")
    )

    def meta(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(d[i]) for d in FIELD_DEFS]), F.col("sort_order") + 1)

    names = ("path", "label", "field_group", "type", "required", "material")
    flat = flat.withColumns({n: meta(i) for i, n in enumerate(names)})
    return _states(flat.withColumn("field_id", x * 16 + F.col("sort_order")))


def _states(flat: DataFrame) -> DataFrame:
    h = F.col("field_id")
    x = F.col("extraction_id")
    confidence = (
        F.when(h % 12 == 0, "low").when(h % 12 == 1, "medium").when(h % 12 == 2, "missing")
        .when(h % 12 == 3, "inferred").when(h % 12 == 4, "conflicting").otherwise("high")
    )
    flat = flat.withColumn("confidence_state", confidence).withColumn(
        "extracted_value", F.when(F.col("confidence_state") != "missing", F.col("sample"))
    )
    corrected = F.when(
        (x % 7 == 0) & (F.col("path") == "total"), "1234.50"
    ).when((x % 7 == 0) & (F.col("path") == "vendorName"), F.concat(F.col("sample"), F.lit(" Ltd")))
    review = (
        F.when(corrected.isNotNull(), "corrected").when(h % 9 == 0, "confirmed")
        .when((h % 31 == 0) & ~F.col("required"), "not_applicable")
        .when(F.col("confidence_state") == "high", "auto_accepted").otherwise("needs_review")
    )
    return flat.select(
        "field_id",
        "extraction_id",
        "doc_id",
        "schema_key",
        "path",
        F.col("path").alias("schema_field_key"),
        "label",
        "field_group",
        "type",
        F.lit("scalar").alias("node_kind"),
        "required",
        "material",
        F.when(F.col("extracted_value").isNull(), "not_found").otherwise("present").alias("presence_state"),
        "extracted_value",
        corrected.alias("corrected_value"),
        "confidence_state",
        F.when(F.col("confidence_state") == "high", 0.9).when(F.col("confidence_state") == "medium", 0.7)
        .otherwise(0.4).alias("confidence_score"),
        review.alias("review_state"),
        F.when(
            F.col("confidence_state") == "conflicting",
            F.array(
                F.struct(F.lit("a").alias("id"), F.lit("First").alias("label"), F.col("sample").alias("value")),
                F.struct(F.lit("b").alias("id"), F.lit("Second").alias("label"), F.lit("99.00").alias("value")),
            ),
        ).alias("conflict_candidates"),
        "sort_order",
    )


@view
def line_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Three repeated-record fields per line item of the current extraction."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(order) - 1)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    qty = F.col("l_quantity").cast("bigint")
    values = (
        ("quantity", "Quantity", F.concat(qty.cast("string"), F.lit(".00")), False),
        ("unitPrice", "Unit price", cents_text(F.floor(cents / qty).cast("bigint")), False),
        ("lineTotal", "Line total", F.when(F.col("l_linenumber") % 5 != 0, cents_text(cents)), True),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("c"), F.lit(n).alias("column_key"), F.lit(l).alias("label"),
                     v.alias("sample"), F.lit(m).alias("material"))
            for i, (n, l, v, m) in enumerate(values)
        ]
    )
    x = F.col("l_orderkey") * 2
    path = F.concat(F.lit("lineItems["), F.col("idx").cast("string"), F.lit("]."), F.col("f.column_key"))
    return (
        li.select("l_orderkey", "idx", F.explode(rows).alias("f"))
        .select(
            (F.lit(1000000000000) + (x * 1000 + F.col("idx")) * 4 + F.col("f.c")).alias("field_id"),
            x.alias("extraction_id"),
            F.col("l_orderkey").alias("doc_id"),
            F.when(F.col("l_orderkey") % 4 == 0, "purchase").otherwise("invoice").alias("schema_key"),
            path.alias("path"),
            F.concat(F.lit("lineItems[]."), F.col("f.column_key")).alias("schema_field_key"),
            F.col("f.label").alias("label"),
            F.lit("lineItems").alias("field_group"),
            F.lit("decimal").alias("type"),
            F.lit("scalar").alias("node_kind"),
            F.lit(False).alias("required"),
            F.col("f.material").alias("material"),
            F.when(F.col("f.sample").isNull(), "empty").otherwise("present").alias("presence_state"),
            F.col("f.sample").alias("extracted_value"),
            F.lit(None).cast("string").alias("corrected_value"),
            F.lit("high").alias("confidence_state"),
            F.lit(0.85).cast("double").alias("confidence_score"),
            F.lit("auto_accepted").alias("review_state"),
            F.lit(None).cast("array<struct<id:string,label:string,value:string>>").alias("conflict_candidates"),
            (F.lit(100) + F.col("idx") * 3 + F.col("f.c")).cast("int").alias("sort_order"),
        )
    )


@view
def all_fields(spark: SparkSession, sf: str) -> DataFrame:
    return raw_fields(spark, sf).unionByName(line_fields(spark, sf))


def with_typed(fields: DataFrame) -> DataFrame:
    value = effective_value(F.col("review_state"), F.col("corrected_value"), F.col("extracted_value"))
    valued = fields.withColumn("_value", value)
    return valued.withColumns(typed_index(F.col("type"), F.col("_value"))).drop("_value")


@view
def fields(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar field rows with typed index columns, stored as the library expects them."""
    return stage(with_typed(raw_fields(spark, sf)), "fields")


@view
def all_typed(spark: SparkSession, sf: str) -> DataFrame:
    """All field rows, repeated records included, with typed index columns, stored."""
    return stage(with_typed(all_fields(spark, sf)), "all-fields")


@view
def checked_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Field rows with single-field validation and the attention flag, stored."""
    return stage(rules.with_attention(rules.check_single(fields(spark, sf))), "checked")


@view
def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources for two fields in three."""
    f = raw_fields(spark, sf).filter((F.col("field_id") % 3 != 0)).select("field_id")
    ranks = F.explode(F.array(F.lit(0), F.lit(1))).alias("r")
    return f.select("field_id", ranks).select(
        F.concat(F.col("field_id").cast("string"), F.lit(":src"), F.col("r").cast("string")).alias("ref_id"),
        "field_id",
        ((F.col("field_id") + F.col("r")) % 9 + 1).cast("int").alias("page"),
        ((F.col("field_id") + F.col("r")) % 2 == 0).alias("has_box"),
        F.when(F.col("field_id") % 5 == 0, 1 - F.col("r")).alias("candidate_rank"),
    )


@view
def invoice_records(spark: SparkSession, sf: str) -> DataFrame:
    """Wide records of the current extractions (input of the library list and the queue)."""
    from docrecords.operators import records

    values = records.values_by_extraction(fields(spark, sf))
    return docs(spark, sf).select("doc_id", F.col("current_extraction_id").alias("extraction_id")).join(
        values, "extraction_id"
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@view
def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders rendered as text (ids from 0 up) and the documents as they are (negative ids), stored."""
    # Line analysis is heavy per byte: the texts are spread over all cores, the small test files as well.
    parts = bucket_count(spark, sum(stored_bytes(table(spark, sf, t)) for t in ("lineitem", "orders", "documents")))
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    line = F.concat(
        "p_name", F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit("  "), cents_text(cents),
        F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("  "), "l_returnflag")).otherwise(""),
    )
    # Rows are dealt by order once; what follows stays where it is, and texts do not move.
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line"))
    rows = li.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "line"))),
                lambda r: r["line"],
            ),
            "\n",
        ).alias("item_rows")
    )
    k = F.col("o_orderkey")
    key = k.cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    total = cents_text(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    pieces = [
        F.when(k % 11 != 0, F.concat(F.lit("# Invoice AC-"), key)),
        F.when(k % 11 != 0, F.concat(F.lit("Customer Name: Customer#"), F.col("o_custkey").cast("string"))),
        F.when(k % 11 != 0, F.concat(F.lit("Invoice No: FLP/BLR/"), key, F.lit(" Invoice Date: "), iso)),
        F.when(k % 11 != 0, F.concat(F.lit("Order Priority:  "), "o_orderpriority", F.lit(" "))),
        F.when(k % 11 != 0, F.concat(F.lit("Total: $"), total)),
        F.when(k % 5 == 0, F.concat(F.lit("  Total: "), total, F.lit(" Currency: USD"))),
        F.when(k % 5 == 1, F.lit("Reference 12: none")),
        F.lit(""),
        F.when(k % 2 == 0, F.lit("Line Items")),
        F.when(F.col("item_rows").isNotNull(), F.lit("Item  Qty  Amount  Amount")),
        F.col("item_rows"),
        F.lit(""),
        F.when(k % 3 == 0, F.lit("| Code | Name |  |\n|---|---|\n| A1 | über |  |\n|  | Beta | 3 |")),
        F.lit("single  row"),
        F.when(k % 11 != 0, F.lit("NOTES AND TERMS")),
        F.concat(F.lit("Deliver order "), key, F.lit(" before noon; contact billing"), key, F.lit("@example.com or +49 170 12"), F.lpad(key, 5, "0"), F.lit(", please.")),
        F.when(k % 7 == 0, F.lit("Second paragraph, see linkedin.com/in/ab-c for more details.")),
        F.when(k % 4 != 1, F.concat(F.lit("- first bullet "), key)),
        F.when(k % 4 == 2, F.lit("2) another   bullet")),
        F.when(k % 7 == 0, F.lit("## Notes\nplain words here.\n## Notes\nmore plain words.\n## Notes 2\nthe last words.")),
    ]
    orders = table(spark, sf, "orders").repartition(parts, "o_orderkey")
    rendered = orders.join(rows, k == F.col("l_orderkey"), "left").select(k.alias("doc_id"), F.concat_ws("\n", *pieces).alias("text"))
    plain = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text").repartition(parts, "doc_id")
    return dealt_stage(rendered.unionByName(plain), "texts", "doc_id", parts)


@view
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Structured lines of the texts, staged once: most text checks read them."""
    t = texts(spark, sf)
    return dealt_stage(canonical.structure_lines(t), "lines", "doc_id", t.buckets)
