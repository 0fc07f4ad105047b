"""Benchmark of the headline queries: prints one JSON line.

The derived input tables (documents' text, structured lines, field rows) are stored first, as they
are in use, and their cost is reported as `stage_*`.  Results are computed in full and thrown away.
"""

import json
import os
import time

from docrecords.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = (
    "q02_selected_values",
    "q10_field_predicates",
    "q14_currency_totals",
    "q17_summary_values",
    "q23_search_records",
    "u5_review_queue",
    "v07_validate",
    "v10_review_progress",
    "r07_invoice_records",
    "r09_derive_data",
    "s05_dedupe",
    "c02_html_to_text",
    "c08_blocks",
    "c10_key_values",
    "c14_resolve_quotes",
    "x03_column_types",
    "x09_field_quality",
    "x12_extract_with_schema",
    "t03_vendors",
)


def main() -> None:
    from checks import catalog, q_rules, q_structure, views

    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name, view in (
        ("stage_fields", views.fields),
        ("stage_all_fields", views.all_typed),
        ("stage_checked", views.checked_fields),
        ("stage_validated", q_rules.valid),
        ("stage_texts", views.texts),
        ("stage_lines", views.lines),
        ("stage_keyed", q_structure.keyed),
    ):
        timed(name, lambda view=view: view(spark, SF_DIR))
    for name in QUERIES:
        query = catalog.QUERIES[name]
        timed(name, lambda query=query: query(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
