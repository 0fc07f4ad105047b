"""Session defaults and small planning helpers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be broadcast without asking the optimizer.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(app: str = "docrecords", cpus: str = "*") -> SparkSession:
    """Session for tests and benchmarks.  On a cluster the submitted configuration is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def small_side(df: DataFrame) -> DataFrame:
    """Mark a join side for broadcast only while the optimizer's size estimate allows it.

    Beyond the bound the hint is left out and the join shuffles, so the result is the same.
    """
    return F.broadcast(df) if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate allows a broadcast."""
    return stored_bytes(df) <= BROADCAST_BYTES


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; of a plain table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(rows: int | None, row_bytes: int = 100) -> bool:
    """Whether so many counted rows may be broadcast: files of short keys are far smaller than their rows in memory."""
    return (rows or 0) * row_bytes <= BROADCAST_BYTES


def attach(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, small: bool | None = None) -> DataFrame:
    """Rows with the one row that `table` has for their key; rows without one go.

    A small table is broadcast.  Of a larger one only the rows of hot keys are: a key is hot if more than
    1/`share` of the rows hold it, so there are fewer than `share`.  All others are met by a shuffle in
    which no key is hot.  The result is the same either way.
    """
    if is_small(table) if small is None else small:
        return rows.join(F.broadcast(table), key)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    # One row beside the counts.
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share > F.col("_total")).select(key)
    met = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    return met.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder the cluster names for cut lineage and stream state."""
    return spark.conf.get("spark.checkpoint.dir", None)
