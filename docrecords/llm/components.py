"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Every step is an aggregate that combines before the shuffle and a join, written as a table in the
shared folder; the number of steps grows with the logarithm of the longest path.  Nothing but counts
comes to the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shared_stage

_EMPTY = "u long, v long"


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of these.  Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), "m")
    return tied.union(least).select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the label is the component's least node."""
    now = shared_stage(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        done, now = now, shared_stage(_small_star(_large_star(now)), "edges")
        forget(done)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
