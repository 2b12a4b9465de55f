"""Window functions over one series.

Every function takes the window built by :func:`ordered`, so all of them in one
``select`` share a single exchange and sort. A result is null until the frame
holds the full number of non-null values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tillwise.functions.scalars import _col

KEYS = ("series_id",)


def ordered(keys=KEYS, order: str = "day") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _full(c: Column, frame: WindowSpec, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(frame) == n, value)


def rolling_mean(c, n: int, w: WindowSpec) -> Column:
    c, frame = _col(c), w.rowsBetween(-(n - 1), 0)
    return _full(c, frame, n, F.avg(c).over(frame))


def rolling_std(c, n: int, w: WindowSpec) -> Column:
    """Sample deviation (ddof 1)."""
    c, frame = _col(c), w.rowsBetween(-(n - 1), 0)
    return _full(c, frame, n, F.stddev_samp(c).over(frame))


def centered_mean(c, n: int, w: WindowSpec) -> Column:
    """Odd n is symmetric; even n reaches one row further back than ahead."""
    c, frame = _col(c), w.rowsBetween(-(n // 2), n - n // 2 - 1)
    return _full(c, frame, n, F.avg(c).over(frame))


def row_lag(c, k: int, w: WindowSpec) -> Column:
    return F.lag(_col(c), k).over(w)


def row_diff(c, w: WindowSpec) -> Column:
    return _col(c) - F.lag(_col(c), 1).over(w)


def forward_fill(c, w: WindowSpec) -> Column:
    return F.last(_col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(c, keys=KEYS, order: str = "day") -> Column:
    """Next non-null value.

    Runs as a forward fill over the reversed order: a frame that only grows
    costs O(n) per series, one that only shrinks is recomputed per row.
    """
    reverse = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return F.last(_col(c), ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))


def edge_fill(c, w: WindowSpec) -> Column:
    """Backward then forward fill for columns whose nulls lie only at the ends.

    That is what rolling, centred and lag columns over null-free input look
    like; it avoids the reverse sort of :func:`backward_fill`.
    """
    c = _col(c)
    earliest = F.first(c, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return F.coalesce(c, forward_fill(c, w), earliest)


def with_ewm(df: DataFrame, c: str, spans: dict[str, int], keys=KEYS, order: str = "day") -> DataFrame:
    """Adjusted exponentially weighted means, one output column per span.

    With a = 2/(span+1) and q = 1-a the value at row t is
    sum(q^i x[t-i]) / sum(q^i). Rows are cut into blocks; within a block the
    numerator is q^pos times a running sum of x*q^-pos, and the previous
    block's end enters with weight q^(pos+block). Blocks are as long as q^-pos
    stays well inside double range, so anything older than one block is lost
    in double rounding. O(n) per series, no collected frames. Input must be
    null-free.
    """
    rate = {name: 1.0 - 2.0 / (span + 1) for name, span in spans.items()}
    block = min(int(345 / -math.log(q)) for q in rate.values())
    if max(rate.values()) ** block > 1e-17:  # decay rates too far apart for one block length
        out = df
        for name, span in spans.items():
            out = with_ewm(out, c, {name: span}, keys, order)
        return out
    row, pos = F.col("_row"), F.col("_row") % block
    by_block = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    previous = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    grown = {name: F.col(c) * F.pow(F.lit(1 / q), pos) for name, q in rate.items()}
    out = df.withColumn("_row", F.row_number().over(ordered(keys, order)) - 1).withColumn(
        "_block", F.floor(row / block).cast("long")
    )
    out = out.select("*", *[F.sum(g).over(by_block).alias(f"_in_{n}") for n, g in grown.items()])
    out = out.select("*", *[F.sum(g).over(previous).alias(f"_pre_{n}") for n, g in grown.items()])
    results = []
    for name, q in rate.items():
        inside = F.col(f"_in_{name}") * F.pow(F.lit(q), pos)
        before = F.coalesce(F.col(f"_pre_{name}"), F.lit(0.0)) * F.pow(F.lit(q), F.lit(block) + pos)
        results.append(((inside + before) / ((1 - F.pow(F.lit(q), row + 1)) / (1 - q))).alias(name))
    return out.select(*df.columns, *results)
