import random

from pyspark.sql import functions as F

from docrecords.operators import review, rules

SCHEMA = (
    "field_id bigint, extraction_id bigint, schema_key string, path string, label string, type string, required boolean, "
    "material boolean, extracted_value string, corrected_value string, review_state string, confidence_state string, sort_order int"
)


def field(i, path, value, kind="decimal", schema="invoice", ext=1, label=None, required=False, material=False, review_state="needs_review"):
    return (i, ext, schema, path, label or path, kind, required, material, value, None, review_state, "high", i)


def states(df):
    rows = df.select("path", "validation_state", F.try_element_at("validation_issues", F.lit(1))["message"].alias("m")).collect()
    return {r["path"]: (r["validation_state"], r["m"]) for r in rows}


def test_invoice_rules(spark):
    rows = [
        field(0, "lineItems[0].quantity", "2.00"), field(1, "lineItems[0].unitPrice", "10.00"), field(2, "lineItems[0].lineTotal", "25.00"),
        field(3, "subtotal", "20.00"), field(4, "tax", "2.00"), field(5, "total", "30.00"),
    ]
    got = states(rules.validate(spark.createDataFrame(rows, SCHEMA)))
    assert got["lineItems[0].lineTotal"] == ("warning", "2.00 x 10.00 = 20.00, but 25.00 was recorded.")
    assert got["subtotal"][0] == "warning" and got["total"] == ("warning", "Subtotal + tax (22.00) does not equal the total (30.00).")
    assert got["tax"] == ("valid", None) and got["lineItems[0].quantity"] == ("valid", None)


def test_invoice_rules_only_for_invoices(spark):
    rows = [field(3, "subtotal", "20.00", schema="other"), field(4, "tax", "2.00", schema="other"), field(5, "total", "30.00", schema="other")]
    assert {s for s, _ in states(rules.validate(spark.createDataFrame(rows, SCHEMA))).values()} == {"valid"}


def test_invalid_is_not_overwritten(spark):
    rows = [field(3, "subtotal", "20.00"), field(4, "tax", "2.00"), field(5, "total", "30,0", required=True)]
    assert states(rules.validate(spark.createDataFrame(rows, SCHEMA)))["total"] == ("invalid", "Enter a valid number.")


def test_empty_cell_and_extra_rule(spark):
    rows = [field(0, "tasks[0].owner", None, "string", "plan", material=True), field(1, "name", "x", "string", "plan")]

    def shout(df):
        hit = (F.col("path") == "name") & (F.col("_value") == "x")
        return df.withColumn("validation_state", F.when(hit, "warning").otherwise(F.col("validation_state")))

    got = states(rules.validate(spark.createDataFrame(rows, SCHEMA), (shout,)))
    assert got["tasks[0].owner"][0] == "warning" and got["name"][0] == "warning"


def test_date_order_matches_all_pairs(spark):
    """The as-of lookup gives what comparing every start with every end gives."""
    rng = random.Random(7)
    rows = []
    for ext in range(40):
        for i in range(rng.randint(1, 12)):
            name = rng.choice(["start date", "due date", "end", "effective to date", "note"])
            value = rng.choice([None, "2024-01-0%d" % rng.randint(1, 6)])
            rows.append(field(ext * 100 + i, f"f{i}", value, "date", "plan", ext, label=f"{name} {i}".replace("date", "date ") if rng.random() < 0.2 else name))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["field_id"]: r["m"] for r in rules.validate(frame).select("field_id", F.try_element_at("validation_issues", F.lit(1))["message"].alias("m")).collect()}
    tagged = frame.select("*", F.lower("label").rlike(rules.V.START_DATE).alias("s"), F.lower("label").rlike(rules.V.END_DATE).alias("e")).collect()
    for end in tagged:
        want = None
        for start in tagged:
            if start["extraction_id"] == end["extraction_id"] and start["s"] and end["e"] and start["extracted_value"] and end["extracted_value"]:
                if end["extracted_value"] < start["extracted_value"]:
                    want = f"{end['label']} is before {start['label']}; verify the date order."
        assert got[end["field_id"]] == want, end


def test_attention_and_blockers(spark):
    rows = [
        field(0, "a", "1", required=True, review_state="confirmed"), field(1, "b", "x", required=True, review_state="confirmed"),
        field(2, "c", "1", review_state="corrected"), field(3, "d", None, required=True),
    ]
    checked = rules.with_attention(rules.validate(spark.createDataFrame(rows, SCHEMA)))
    assert {r["path"]: r["needs_attention"] for r in checked.collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert {r["path"]: r["message"] for r in rules.approval_blockers(checked).collect()} == {"b": "Enter a valid number.", "d": "d is required."}
    progress = rules.review_progress(checked).first()
    assert (progress["review_status"], progress["attention_fields"], progress["resolved_fields"]) == ("needs_review", 4, 2)


def test_derive_data_nests(spark):
    rows = [
        field(0, "title", 'say "hi"', "string"), field(1, "vendor.address.city", "Rome", "string"), field(2, "lines[0].qty", "1"),
        field(3, "lines[2].qty", "3"), field(4, "lines[2].tax", None), field(5, "vendor.name", "Ann", "string"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("node_kind", F.lit("scalar"))
    data = review.derive_data(frame).first()["data"]
    assert data == (
        '{"title":"say \\"hi\\"","vendor":{"address":{"city":"Rome"},"name":"Ann"},"lines":[{"qty":"1"},null,{"qty":"3","tax":null}]}'
    )


def test_fields_no_rule_compares_stay_where_they_lie(spark):
    rows = [
        field(0, "vendorName", "x", "string"), field(1, "total", "30.00"), field(2, "startDate", "2024-01-02", "date", "plan", 2),
        field(3, "other", "2024-01-02", "date", "plan", 2), field(4, "lineItems[0].quantity", "1"), field(5, "lineItems[0].quantity", "1", schema="plan", ext=3),
        field(6, "subtotal", None, schema=None, ext=4), field(7, "tax", "1", schema=None, ext=4), field(8, "startDate", None, "date", "plan", 2),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    valued = frame.withColumn("_value", rules.value_column())
    assert {r["field_id"] for r in valued.filter(rules.meets_others()).collect()} == {1, 2, 4, 6}
    assert rules.validate(frame).count() == len(rows)


def test_a_lone_subtotal_of_another_schema_is_warned(spark):
    """Lines of an invoice and the subtotal of another schema may share an extraction."""
    rows = [
        field(0, "lineItems[0].quantity", "2"), field(1, "lineItems[0].unitPrice", "3"), field(2, "lineItems[0].lineTotal", "7"),
        field(3, "subtotal", "7", schema="plan"),
    ]
    assert states(rules.validate(spark.createDataFrame(rows, SCHEMA)))["subtotal"][0] == "warning"
