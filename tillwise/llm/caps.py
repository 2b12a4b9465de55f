"""Near-duplicate embeddings through spherical-cap filters.

Filter directions form random product codes: after a random rotation a vector is cut
into two blocks, each with its own set of random unit vectors, and a direction
is one vector of either set. A vector is list-decoded to all directions whose cap holds
it, or to the nearest one if none does; vectors that share a direction of any code are
compared exactly. Directions of more and shorter blocks would lie unevenly, so that many vectors
were in no cap. The codes grow with the table so that a direction holds about as many vectors at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import components, stage_table

COSINE = 0.95
LIST = 40  # directions of a code that a vector is decoded to, on average
BLOCKS = 2
CODES = 3  # independently rotated codes; a pair that one misses meets in another
LEAST_DIMENSION = 16
SEED = 7


def code_size(rows: int, wanted: int = LIST) -> int:
    """Vectors per block so that there are as many directions as list entries."""
    return max(16, int(np.ceil((wanted * max(rows, 1)) ** (1 / BLOCKS))))


def cap_height(dimension: int, share: float) -> float:
    """The inner product that a share of random unit vectors reaches with a fixed direction."""
    t = np.linspace(-1, 1, 200_001)
    density = (1 - t * t).clip(0) ** ((dimension - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above / above[0], -share)])


class ProductCode:
    def __init__(self, dimension: int, size: int, wanted: int = LIST, seed: int = SEED, turn: int = 0):
        self.dimension = max(dimension, LEAST_DIMENSION)
        rng = np.random.default_rng((seed, dimension, size, turn))
        self.rotation = np.linalg.qr(rng.standard_normal((self.dimension, self.dimension)))[0]
        self.cuts = [self.dimension * i // BLOCKS for i in range(BLOCKS + 1)]
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            words = rng.standard_normal((size, b - a))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(BLOCKS))
        self.size = size
        self.height = cap_height(self.dimension, min(0.5, wanted / size**BLOCKS))

    def decode(self, vectors: np.ndarray):
        """For each unit vector, the numbers of all directions whose cap holds it."""
        wide = np.zeros((len(vectors), self.dimension))
        wide[:, : vectors.shape[1]] = vectors
        turned = wide @ self.rotation
        first, second = (turned[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words))
        best_first, best_second = first.max(axis=1), second.max(axis=1)
        for i in range(len(wide)):
            height = min(self.height, best_first[i] + best_second[i] - 1e-9)  # at least the nearest direction
            # Halves that no other half can lift over the cap's height are cut off before sorting.
            a = np.flatnonzero(first[i] >= height - best_second[i])
            b = np.flatnonzero(second[i] >= height - best_first[i])
            b = b[np.argsort(second[i][b])]
            at = np.searchsorted(second[i][b], height - first[i][a])
            counts = len(b) - at
            yield np.repeat(a, counts) * self.size + np.concatenate([b[x:] for x in at])


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no square leaves the range of doubles
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def filters(classes: DataFrame, size: int, wanted: int = LIST, seed: int = SEED) -> DataFrame:
    """(dimension, filter, cid) for every direction of every code whose cap holds a class's vector."""

    def run(batches):
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            widths = np.asarray(batch.column(1).value_lengths())
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                if width not in codes:
                    codes[width] = [ProductCode(width, size, wanted, seed, turn) for turn in range(CODES)]
                for at in range(0, len(rows), 500):
                    part = batch.take(pa.array(rows[at : at + 500]))
                    unit = _unit(_matrix(part.column(1)))
                    found = [code.decode(unit) for code in codes[width]]
                    lists = [np.concatenate([x + turn * size**BLOCKS for turn, x in enumerate(row)]) for row in zip(*found)]
                    cid = np.repeat(np.asarray(part.column(0)), [len(x) for x in lists])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cid), width), pa.int32()), pa.array(np.concatenate(lists), pa.int64()), pa.array(cid, pa.int64())],
                        names=["dimension", "filter", "cid"],
                    )

    return classes.select("cid", "vector").mapInArrow(run, "dimension int, filter long, cid long")


def pairs(classes: DataFrame, cosine: float = COSINE, wanted: int = LIST, seed: int = SEED) -> DataFrame:
    """(a, b), a < b: classes that share a direction and reach the cosine."""
    keyed = stage_table(filters(classes, code_size(classes.count(), wanted), wanted, seed))
    other = keyed.select("dimension", "filter", F.col("cid").alias("b"))
    met = keyed.withColumnRenamed("cid", "a").join(other, ["dimension", "filter"]).where(F.col("a") < F.col("b"))
    met = met.select("a", "b").distinct()
    left = classes.select(F.col("cid").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("cid").alias("b"), F.col("vector").alias("y"))

    def verify(batches):
        for batch in batches:
            if batch.num_rows:
                dots = np.einsum("ij,ij->i", _unit(_matrix(batch.column(2))), _unit(_matrix(batch.column(3))))
                yield batch.filter(pa.array(dots >= cosine)).select(["a", "b"])

    # The lengths are equal within a pair but may differ between pairs: keep each to its own batch.
    both = met.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_by_width(verify), "a long, b long")


def _by_width(verify):
    def run(batches):
        for batch in batches:
            widths = np.asarray(batch.column(2).value_lengths()) if batch.num_rows else np.zeros(0, int)
            for width in np.unique(widths).tolist():
                yield from verify([batch.take(pa.array(np.flatnonzero(widths == width)))])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, wanted: int = LIST, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable. Equal vectors are one class and are never paired with each other.
    Vectors that are null, zero or hold null or non-finite components link with nothing, and
    none links with a vector of another length; repeated rows link with each other; rows
    with a null vec_id link and count but name no component; other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = base.where(usable(F.col("vector")))
    bad = base.where(~usable(F.col("vector"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    grouped = good.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stage_table(grouped.withColumn("cid", F.monotonically_increasing_id()))
    found = stage_table(pairs(classes, cosine, wanted, seed))
    either = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = either.join(classes.select(F.col("cid").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
    joined = components(found).withColumnRenamed("node", "cid")
    named = classes.join(counted.withColumnRenamed("a", "cid"), "cid", "left").join(joined, "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    links = (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = named.join(least, "component").select("vector", links, "component_id")
    out = good.join(named, "vector").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(bad)
