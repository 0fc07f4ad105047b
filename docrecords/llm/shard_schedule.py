"""Operator 8, sharding: longest-processing-time scheduling.

Documents of equal text form a group and stay together (null counts as the empty text).  Groups
sorted by size, largest first, go to the least loaded shard, taken from a heap.

A heap is one sequence of steps, so what goes through it must be bounded.  With T = total bytes /
(shards * `per_shard`), a group of at least T bytes is a unit of its own; there are at most shards *
`per_shard` of them.  Smaller groups travel in bundles: all texts of one size class (16 classes to
each doubling) are split by their digest into as many cells as the class has T bytes.  There
are at most shards * `per_shard` + the number of classes bundles.  Where the data are small, T is
less than any group, and the schedule is the plain one.  The units, of a number that does not grow
with the data, are scheduled on the driver and sent back as a lookup; documents find their
unit from their own digest and size, so copies of a hot text never meet in one task.

Slots: a shard's documents are spread by a hash over `cells` cells; a document's slot is the start of
its cell plus its place in it.

Results for odd inputs: null text has size 16 and the empty text's digest; repeated rows get slots of
their own; an empty table gives no rows.
"""

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_stage

SHARDS = 40
PER_SHARD = 500
ROW_BYTES = 16
SLOT_CELLS = 256


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: largest first, each to the least loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    chosen = [0] * len(sizes)
    for unit in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        chosen[unit] = shard
        heapq.heapreplace(heap, (load + sizes[unit], shard))
    return chosen


def shard_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    per_shard: int = PER_SHARD,
    cells: int = SLOT_CELLS,
) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) for every document."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = shared_stage(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("digest"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit_bytes = max(1, -(-total // (shards * per_shard)))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    large = groups.filter(F.col("bytes") >= unit_bytes).select(
        F.concat(F.lit("g"), "digest").alias("unit"), "bytes", F.lit(True).alias("own")
    )
    # At most shards * per_shard rows, as together they have no more than all bytes.
    large_units = [(r["unit"], r["bytes"]) for r in large.collect()]
    own = F.broadcast(
        spark.createDataFrame([(u[1:], True) for u, _ in large_units], "digest string, own boolean")
    )
    # The class of a text is that of its own size, which all its copies share.
    size_class = F.floor(F.log2(F.col("size").cast("double")) * 16).cast("int")
    marked = rows.join(own, "digest", "left").withColumn("class", size_class)
    small = marked.filter(F.col("own").isNull())
    class_cells = {
        r["class"]: -(-r["bytes"] // unit_bytes)
        for r in small.groupBy("class").agg(F.sum("size").alias("bytes")).collect()
    }
    cell_count = F.broadcast(
        spark.createDataFrame(list(class_cells.items()), "class int, n_cells long")
    )
    with_unit = (
        marked.join(cell_count, "class", "left")
        .withColumn(
            "unit",
            F.when(F.col("own"), F.concat(F.lit("g"), "digest")).otherwise(
                F.concat_ws(
                    "-",
                    F.lit("c"),
                    F.col("class"),
                    F.pmod(F.xxhash64("digest"), F.col("n_cells")),
                )
            ),
        )
        .drop("own", "class", "n_cells")
    )
    bundles = (
        with_unit.filter(~F.col("unit").startswith("g"))
        .groupBy("unit")
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    units = sorted([*large_units, *((r["unit"], r["bytes"]) for r in bundles)])
    chosen = longest_first([b for _, b in units], shards)
    plan = F.broadcast(
        spark.createDataFrame(
            [(u, s) for (u, _), s in zip(units, chosen, strict=True)], "unit string, shard int"
        )
    )
    placed = with_unit.join(plan, "unit").drop("unit")
    return numbered(placed, "shard", "slot", ["doc_id", "digest"], cells)


def numbered(df: DataFrame, key: str, name: str, order: list[str], cells: int) -> DataFrame:
    """Number the rows of each key from 0, without a task that holds a whole key.

    Rows are spread over `cells` cells of their key by a hash of all columns `order` names; the
    starts of the cells are a table of keys * cells rows.
    """
    celled = df.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = celled.groupBy(key, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(key, "cell").orderBy(*order))
    return (
        celled.withColumn("place", place)
        .join(F.broadcast(starts), [key, "cell"])
        .withColumn(name, (F.col("first") + F.col("place") - 1).cast("long"))
        .drop("cell", "place", "first")
    )
