"""Gram matrices per key: counts, sums and cross products as sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_cells(rows: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """(*keys, i, j, product), i <= j: sums over the rows of element i times element j, from 0.

    A row gives its products one by one to a partial sum per cell, so a key's rows never meet in one
    task or buffer. With a first element of 1 the cells (0, j) hold the row count and the sums.
    Rows with a null element are left out, as they are in a regression.
    """
    whole = rows.select(*keys, vector.alias("_v")).where(F.forall("_v", lambda x: x.isNotNull()))
    left = whole.select(*keys, "_v", F.posexplode("_v").alias("i", "_a"))
    both = left.select(*keys, "i", "_a", F.posexplode("_v").alias("j", "_b")).where("i <= j")
    return both.groupBy(*keys, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("product"))


def gram(rows: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """(*keys, cells): the upper triangle row by row as one array, whose length depends on the vector alone."""
    packed = F.sort_array(F.collect_list(F.struct("i", "j", "product")))
    cells = gram_cells(rows, keys, vector).groupBy(*keys).agg(packed.alias("_c"))
    return cells.select(*keys, F.transform("_c", lambda c: c["product"]).alias("cells"))
