"""Live state per document from the event log."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import small_side

BUCKETS = 64

# Kinds of lineage events.
EVENT_KINDS = (
    "uploaded", "processed", "extraction_created", "extraction_promoted", "corrected",
    "schema_reassigned", "approved", "reopened", "reprocessed",
)


def document_state(events: DataFrame, kinds: tuple[str, ...] = EVENT_KINDS) -> DataFrame:
    """Last event kind, time, and counts by kind per document; works on streams and tables.

    The aggregate combines on the map side and its state is one row per document.
    """
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    return events.groupBy("doc_id").agg(
        F.max_by("kind", F.struct("created_at", "event_id")).alias("last_kind"),
        F.max("created_at").alias("last_at"),
        F.count(F.lit(1)).alias("n_events"),
        *counts,
    )


def upsert_batch(changed: DataFrame, target: str, number: int, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Write the rows of the keys that a batch changed, dealt into buckets of the key.

    Nothing that is there is read or written again: a batch costs what it changed.  A batch that is run again
    replaces its own rows.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = changed.withColumn("bucket", bucket).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/version={number}")


def current_state(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """The newest row of every key; versions below a bucket's compaction are not read."""
    rows = spark.read.parquet(f"{target}/rows")
    columns = [c for c in rows.columns if c not in (key, "bucket", "version")]
    compacted = rows.filter("_base").groupBy("bucket").agg(F.max("version").alias("_from"))
    # One row for each bucket.
    recent = rows.join(small_side(compacted), "bucket", "left").filter(F.col("version") >= F.coalesce("_from", "version"))
    newest = recent.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), "version").alias("_row"))
    return newest.select(key, "_row.*").drop("_base")


def keep_state(
    states: DataFrame, target: str, checkpoint: str, key: str = "doc_id", buckets: int = BUCKETS, compact_every: int = 100
) -> StreamingQuery:
    """Keep the state of a streaming aggregate as a table: every batch adds the keys it changed.

    Each `compact_every` batches the current rows are written once more as the new base, so that a reader
    never meets more versions than that.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            spark = batch.sparkSession
            changed = batch.select(key)
            rest = current_state(spark, target, key).join(changed, key, "left_anti")
            upsert_batch(rest.unionByName(batch).withColumn("_base", F.lit(True)), target, number, key, buckets)
        else:
            upsert_batch(batch.withColumn("_base", F.lit(number == 0)), target, number, key, buckets)

    return (
        states.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
