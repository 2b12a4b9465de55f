"""Centroid clustering of embeddings in whole numbers, as expressions that run in the JVM.

Components become integers, so distances and means are exact and no result depends on the order of
a sum. A round is one scan: zip_with and aggregate give a vector's distances to the centroids, which
are literals; array_min of (distance, number) structs chooses; column sums per cluster, combined
before the shuffle, give the next centroids. Only one row per cluster ever reaches the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import stage_table

CLUSTERS = 8
ROUNDS = 10
DIMENSION = 64
SCALE = 1024
SEED = 3
# Units beyond this saturate, which keeps a squared distance over 64 components below 2^61 and a sum of
# 2^36 components inside 64 bits. Components of ordinary embeddings stay far below.
MOST_UNITS = 1 << 26
LARGEST = (1 << 63) - 1


def whole_units(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of every component."""
    bounded = lambda x: F.greatest(F.lit(-float(MOST_UNITS)), F.least(F.lit(float(MOST_UNITS)), x * scale))
    return F.transform(vector, lambda x: F.floor(bounded(x)))


def kept(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with that many components, all present and finite."""
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_x"))
    finite = F.forall("_x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return base.where((F.size("_x") == dimension) & finite).select("vec_id", whole_units(F.col("_x"), scale).alias("v"))


def nearest(centroids: list[list[int]]) -> Column:
    """The struct (distance, cluster) of the nearest centroid; of equal distances the smaller number."""
    chosen = []
    for number, centroid in enumerate(centroids):
        literal = ", ".join(f"{c}L" for c in centroid)
        distance = f"aggregate(zip_with(v, array({literal}), (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
        chosen.append(f"struct({distance} AS distance, {number} AS cluster)")
    return F.expr(f"array_min(array({', '.join(chosen)}))")


def seeds(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The first vectors by sha256 of seed and id; rows without an id come last, ties go by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = points.orderBy(mark.asc_nulls_last(), "v").limit(clusters).collect()
    return [r["v"] for r in first]


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; a cluster without vectors keeps its centroid."""
    near = points.select(nearest(centroids)["cluster"].alias("cluster"), "v")
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for row in sums.collect():  # a row per cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centroids[0]))]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED):
    """Returns (assigned, centroids): vec_id, cluster and distance of every kept vector, and the last centroids.

    Vectors of another length, null ones and those with a null or non-finite component are left out;
    rows with a null vec_id are assigned but seed a centroid only when too few others are left;
    repeated rows count each for itself; with fewer vectors than clusters every vector seeds one;
    other columns are ignored; an empty table gives no rows and no centroids.
    """
    points = stage_table(kept(vectors, dimension, scale))
    centroids = seeds(points, clusters, seed)
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(points, centroids)
    assigned = points.select("vec_id", nearest(centroids).alias("_near")).select("vec_id", "_near.cluster", "_near.distance")
    return stage_table(assigned), centroids


def summed_up(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assigned vectors with their cluster's inertia, the inertia of all, and the digest of their centroid.

    Inertias beyond 64 bits stop at the largest long.
    """
    totals = {r["cluster"]: int(r["t"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("t")).collect()}
    inertia = min(sum(totals.values()), LARGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(number, min(total, LARGEST), inertia, digest[number]) for number, total in totals.items()]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster, whatever the table's size.
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
