"""Parquet storage of the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TABLES

# Tables whose readers filter on one column are laid out by it.
CLUSTER_BY = {"fields": ("schema_field_key", "extraction_id"), "sources": ("field_id",)}


def save_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a table; large ones are sorted within files so that row groups can be skipped."""
    if name in CLUSTER_BY:
        df = df.sortWithinPartitions(*CLUSTER_BY[name])
    df.write.mode(mode).parquet(f"{root}/{name}")


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read if name not in TABLES else spark.read.schema(TABLES[name])
    return reader.parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast a DataFrame to the stored schema; columns it lacks become null."""
    columns = []
    for f in TABLES[name].fields:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        columns.append(source.cast(f.dataType).alias(f.name))
    return df.select(*columns)
