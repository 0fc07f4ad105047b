"""Stage tables: results that several operators read are written once and read back.

A written table survives lost executors, cuts the lineage, and keeps column pruning and predicate
pushdown for its readers, which a checkpoint of rows does not.  A table that many steps group by the same
column is written in buckets of it (`dealt_stage`).
"""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    A session on one machine (tests, benchmarks) may leave it out and gets a temporary folder.  On a
    cluster there is no default: executors would each write to their own disk.
    """
    root = checkpoint_dir(spark)
    if root is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="docrecords-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    path = f"{stage_root(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*partition_by).option("compression", CODEC).parquet(path)
    return _kept(spark.read.schema(df.schema).parquet(path), path)


def bucket_count(spark: SparkSession, size: int = 0) -> int:
    """Buckets for a table made of `size` stored bytes: as many as a shuffle has partitions, more for large tables."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, usual, -(-size // BUCKET_BYTES))


def dealt_stage(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A stage table in buckets of `key`: what groups or joins its rows by that column needs no shuffle.

    Rows are written where they are.  Best they lie in as many hash partitions of `key` (`repartition`, or another
    such table worked on row by row or by that key): each task then writes one file.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path = f"{stage_root(spark)}/stage-{unique}/{name}"
    table = f"stage_{unique}"
    with _settings(spark, BUCKET_WRITES):
        _write_buckets(df, table, path, key, buckets)
    # Under a name of its own the key belongs to no table, so that a union of rows made from it is known to lie in
    # the same buckets.
    found = spark.table(table).select(*[F.col(_BUCKET).alias(key) if c == key else F.col(f"`{c}`") for c in df.columns])
    found.buckets, found.bucket_table, found.bucket_key = buckets, table, key
    return _kept(found, path)


_BUCKET = "_bucket_key"


def _write_buckets(df: DataFrame, table: str, path: str, key: str, buckets: int, mode: str = "error") -> None:
    writer = df.withColumnRenamed(key, _BUCKET).write.mode(mode).format("parquet").bucketBy(buckets, _BUCKET)
    writer.option("compression", CODEC).option("path", path).saveAsTable(table)


def _kept(found: DataFrame, path: str) -> DataFrame:
    found.stage_path = path
    scopes = getattr(_LOCAL, "scopes", None)
    if scopes:
        scopes[-1].append(found)
    return found


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Stage tables are read a few times: small files count more than the time to pack them.
CODEC = "zstd"
BUCKET_BYTES = 32 * 1024 * 1024
# While a bucketed table is written: its input is read by buckets as well, and a task that has one bucket does not
# sort its rows by bucket.
BUCKET_WRITES = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}
_LOCAL = threading.local()


@contextmanager
def temporary_stages() -> Iterator[None]:
    """Stage tables written inside are discarded at the end: for runs whose results are stored elsewhere."""
    scopes = _LOCAL.scopes = getattr(_LOCAL, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        discard(*scopes.pop())


def discard(*tables: DataFrame) -> None:
    """Empty stage tables that no later step reads: their files go, an empty table of the same columns stays."""
    for table in tables:
        empty = table.sparkSession.createDataFrame([], table.schema)
        if hasattr(table, "bucket_table"):
            _write_buckets(empty, table.bucket_table, table.stage_path, table.bucket_key, table.buckets, "overwrite")
        else:
            empty.write.mode("overwrite").parquet(table.stage_path)
