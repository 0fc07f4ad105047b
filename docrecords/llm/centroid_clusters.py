"""Operator 13, centroid clustering with an incremental matrix of distances.

Vectors of exactly `DIMENSIONS` finite components become whole numbers, floor(256 * x).  The first centroids
are the `clusters` vectors of the smallest hashes of their ids.  Each round assigns every vector to its nearest centroid
and moves a centroid to the floored mean of its vectors; after the last round vectors are assigned once more.

The matrix.  A vector's exact dot products with all centroids are stored beside it.  The squared distance to a
centroid is |x|^2 - 2 x.c + |c|^2.  When centroids have moved, a stored product changes by the product of the
vector with the move, which is summed over the components that moved only; a centroid that stood still costs
nothing.  Then the nearest centroid is found anew.  A round is one pass that reads a table and writes the next
one; two places in the shared folder take turns, so that no more than two tables exist.  Sums of components and
counts by cluster are added up in tasks, so that clusters * components rows go to the driver, whatever the
data's size; the centroids, of the same number, go back with the tasks.

Results for odd inputs: vectors that are null, of another length, or with a null, NaN or infinite component are
left out; whole numbers beyond +-2^27 are taken as +-2^27, so that every distance fits a long; ids that repeat
are vectors of their own, the smaller components first where their hashes tie; a null id is hashed as the empty
text; fewer vectors than clusters are each a first centroid; equal distances go to the smaller number; an empty
table gives no rows; other columns are not read.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
UNITS = 256
LARGEST = 2**27

_STATE = "vec_id {key}, x array<int>, dots array<long>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): the vectors kept, in whole numbers."""
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).filter(F.size("x") == DIMENSIONS)
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    most, least = F.lit(float(LARGEST)), F.lit(float(-LARGEST))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * UNITS, most), least)).cast("int"))
    return rows.filter(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("x"))


def first_centroids(rows: DataFrame, clusters: int) -> list[list[int]]:
    named = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r["x"] for r in rows.orderBy(F.sha2(named, 256), "x").limit(clusters).select("x").collect()]


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(kind, copy=False)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def changed_dots(x: np.ndarray, dots: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Stored products after centroids moved: only components that moved are multiplied."""
    dots = dots.copy()
    for j in np.flatnonzero(moves.any(axis=1)):
        at = np.flatnonzero(moves[j])
        dots[:, j] += x[:, at] @ moves[j, at]
    return dots


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid, the smaller number among equals, and the squared distance."""
    apart = (centroids * centroids).sum(axis=1) - 2 * dots
    cluster = apart.argmin(axis=1)
    return cluster, apart[np.arange(len(x)), cluster] + (x * x).sum(axis=1)


def assigned(rows: DataFrame, centroids: np.ndarray, moves: np.ndarray) -> DataFrame:
    """The next table: products brought up to date by the moves, the nearest centroid and its distance.

    Rows without stored products start from none, with the centroids themselves as moves from zero.
    """
    stored = "dots" in rows.columns
    schema = _STATE.format(key=rows.schema["vec_id"].dataType.simpleString())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), centroids.shape[1], np.int64)
            start = np.zeros((len(x), len(centroids)), np.int64)
            dots = changed_dots(x, _matrix(batch.column(2), len(centroids), np.int64) if stored else start, moves)
            cluster, distance = nearest(x, dots, centroids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    _lists(dots, pa.int64()),
                    pa.array(cluster, pa.int32()),
                    pa.array(distance, pa.int64()),
                ],
                names=["vec_id", "x", "dots", "cluster", "distance"],
            )

    return rows.select(*(["vec_id", "x", "dots"] if stored else ["vec_id", "x"])).mapInArrow(run, schema)


def cluster_sums(state: DataFrame, clusters: int) -> dict[int, tuple[list[int], int]]:
    """Components' sums and the count of each cluster that has vectors."""

    def run(batches):
        sums, counts = np.zeros((clusters, DIMENSIONS), object), np.zeros(clusters, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster = _matrix(batch.column(0), DIMENSIONS, np.int64), batch.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            start = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums[cluster[order][start]] += np.add.reduceat(x[order], start, axis=0)
            counts += np.bincount(cluster, minlength=clusters)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(held, DIMENSIONS), pa.int32()),
                    pa.array(np.tile(np.arange(DIMENSIONS), len(held)), pa.int32()),
                    pa.array(sums[held].ravel().tolist(), pa.int64()),
                    pa.array(np.repeat(counts[held], DIMENSIONS), pa.int64()),
                ],
                names=["cluster", "at", "total", "n"],
            )

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, at int, total long, n long")
    totals = parts.groupBy("cluster", "at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    found: dict[int, tuple[list[int], int]] = {}
    for r in totals.collect():
        found.setdefault(r["cluster"], ([0] * DIMENSIONS, r["n"]))[0][r["at"]] = int(r["total"])
    return found


def centroid_clusters(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector kept."""
    from ..plans.stages import stage_root

    spark = vectors.sparkSession
    rows = whole_vectors(vectors, vec_id, embedding)
    start = first_centroids(rows, clusters)
    if not start:
        key = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame(
            [], f"vec_id {key}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    centroids = np.array(start, np.int64)
    root = f"{stage_root(spark)}/clusters-{uuid.uuid4().hex}"
    state, moves = rows, centroids
    for turn in range(rounds + 1):
        place = f"{root}/{turn % 2}"
        found = assigned(state, centroids, moves)
        found.write.mode("overwrite").parquet(place)
        state = spark.read.schema(found.schema).parquet(place)
        if turn == rounds:
            break
        moved = centroids.copy()
        for cluster, (totals, n) in cluster_sums(state, len(centroids)).items():
            moved[cluster] = [total // n for total in totals]
        moves, centroids = moved - centroids, moved
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    longest = 2**63 - 1
    named = [
        (c, min(d, longest), min(sum(inertia.values()), longest), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, d in inertia.items()
    ]
    # One row for each cluster.
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
