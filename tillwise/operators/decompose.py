"""Additive seasonal decomposition and autocorrelation of daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS, ordered

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def seasonal_decompose(
    df: DataFrame, period: int = 30, column: str = "amount", keys=KEYS, order: str = "day"
) -> DataFrame:
    """Trend, seasonal and residual for an even period.

    Trend is the centred mean of period + 1 rows with half weights at both
    ends; seasonal is the mean detrended value per phase, shifted to mean 0.
    Series shorter than two periods give no rows.
    """
    w = ordered(keys, order)
    half = period // 2
    x = F.col(column)
    frame = w.rowsBetween(-half, half)
    middle = F.sum(x).over(w.rowsBetween(-half + 1, half - 1))
    ends = F.lag(x, half).over(w) + F.lead(x, half).over(w)
    base = df.select(
        *keys,
        order,
        x.alias("observed"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        F.pmod(F.row_number().over(w) - 1, F.lit(period)).alias("phase"),
        F.when(F.count(x).over(frame) == period + 1, (middle + ends / 2) / period).alias("trend"),
    ).where(F.col("_n") >= 2 * period)
    by_phase = Window.partitionBy(*keys, "phase")
    detrended = F.col("observed") - F.col("trend")
    phased = base.withColumns(
        {
            "_mean": F.avg(detrended).over(by_phase),
            "_rows": F.count(F.lit(1)).over(by_phase),
        }
    )
    # Each phase counts once in the centre, however many rows it has.
    centre = F.sum(F.col("_mean") / F.col("_rows")).over(Window.partitionBy(*keys)) / period
    out = phased.withColumn("seasonal", F.col("_mean") - centre)
    return out.select(
        *keys,
        order,
        "observed",
        "trend",
        "seasonal",
        (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )


def autocorrelation(df: DataFrame, lags: int = 30, column: str = "amount", keys=KEYS, order: str = "day") -> DataFrame:
    """Autocorrelation for lags 0..lags with its 95 % Bartlett half-width."""
    clean = df.where(F.col(column).isNotNull())
    centred = clean.select(
        *keys, order, (F.col(column) - F.avg(column).over(Window.partitionBy(*keys))).alias("_x")
    )
    w = ordered(keys, order)
    x = F.col("_x")
    products = centred.select(*keys, *[(x * F.lag(x, k).over(w)).alias(f"_p{k}") for k in range(lags + 1)])
    sums = products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"_p{k}") for k in range(lags + 1)]).alias("_s")
    )
    long = sums.select(*keys, "n", F.posexplode("_s").alias("lag", "_c"), F.col("_s")[0].alias("_c0")).where(
        F.col("lag") < F.col("n")
    )
    r = F.try_divide(F.col("_c"), F.col("_c0"))
    long = long.select(*keys, "n", "lag", r.alias("acf"))
    # Var of lag k uses the squares of lags 1..k-1; lag 0 has no band.
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    variance = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((1 + 2 * squares) / F.col("n"))
    return long.withColumn("half_width", F.lit(Z95) * F.sqrt(variance))
