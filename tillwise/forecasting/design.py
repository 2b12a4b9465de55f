"""Regression designs: differencing, lags and residual lags, all as window columns.

Input of every function here is the *series table*
``(series_id, day, y DOUBLE, x ARRAY<DOUBLE>, in_fit BOOLEAN, ahead BOOLEAN)``:
``in_fit`` rows (the first ones) estimate, ``ahead`` rows (the last ones) are the
future, and what lies between is the test span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.forecasting.specs import Spec
from tillwise.functions.rolling import ordered

LONG_AR = 14  # order of the first-stage autoregression behind moving-average terms


@dataclass(frozen=True)
class Shape:
    """Sizes shared by all candidates, so that they are compared on one sample."""

    blocks: list[tuple[int, int, int]]
    ar: int  # longest AR lag
    ma: int  # longest MA lag
    history: int  # lags kept per row
    differencing: int  # rows lost to differencing
    n_exog: int

    @property
    def first_stage_after(self) -> int:
        return self.differencing + self.history

    @property
    def sample_after(self) -> int:
        """Rows up to this position are dropped for every candidate alike."""
        return self.first_stage_after + self.ma

    @property
    def level_lags(self) -> int:
        return self.ar + self.differencing


def shape_of(specs: list[Spec], n_exog: int, long_ar: int = LONG_AR) -> Shape:
    ar = max((lag for s in specs for lag in s.ar_lags()), default=0)
    ma = max((lag for s in specs for lag in s.ma_lags()), default=0)
    blocks = sorted({s.block for s in specs})
    return Shape(
        blocks=blocks,
        ar=ar,
        ma=ma,
        history=max(ar, ma, long_ar) if ma else ar,
        differencing=max(d + D * s for d, D, s in blocks),
        n_exog=n_exog,
    )


def differenced(series: DataFrame, blocks: list[tuple[int, int, int]], n_exog: int) -> DataFrame:
    """Long table: one row per row and block with the differenced target and regressors.

    Target and regressors travel as one vector, so both get the same regular
    (d) and seasonal (D, s) differences from one lag window each. Elements are
    subtracted one by one, which stays in generated code.
    """
    w = ordered()

    def step(name: str, k: int) -> Column:
        now, before = F.col(name), F.lag(name, k).over(w)
        return F.when(before.isNotNull(), F.array(*[F.get(now, F.lit(i)) - F.get(before, F.lit(i)) for i in range(n_exog + 1)]))

    out = series.withColumn("_z_0_0_0", F.concat(F.array("y"), F.col("x")))
    for _, D, s in blocks:
        name = f"_z_0_{D}_{s}"
        if D and name not in out.columns:
            out = out.withColumn(name, step("_z_0_0_0", s))
    for level in range(1, max(d for d, _, _ in blocks) + 1):
        for d, D, s in blocks:
            name, before = f"_z_{level}_{D}_{s}", f"_z_{level - 1}_{D}_{s}"
            if d >= level and name not in out.columns:
                out = out.withColumn(name, step(before, 1))
    cells = F.array(
        *[F.struct(F.lit(i).alias("block"), F.col(f"_z_{d}_{D}_{s}").alias("z")) for i, (d, D, s) in enumerate(blocks)]
    )
    out = out.select(*series.columns, F.inline(cells))
    return out.select(
        *series.columns,
        "block",
        F.col("z")[0].alias("dy"),
        F.when(F.col("z").isNotNull(), F.slice("z", 2, n_exog)).alias("dx"),
    )


def _past(c: str, n: int) -> Column:
    """The n values before the row, newest first; null until all n exist."""
    w = Window.partitionBy("series_id", "block").orderBy("day")
    if n == 0:
        return F.array().cast("array<double>")
    values = F.collect_list(c).over(w.rowsBetween(-n, -1))
    return F.when(F.size(values) == n, F.reverse(values))


def lagged(series: DataFrame, shape: Shape) -> DataFrame:
    """Differenced rows with their position in the series and their target lags."""
    w = ordered()
    placed = series.withColumns(
        {
            "position": F.row_number().over(w),
            "to_fit_end": F.count_if("in_fit").over(Window.partitionBy("series_id")) - F.row_number().over(w),
            "to_end": F.count_if(~F.col("ahead")).over(Window.partitionBy("series_id")) - F.row_number().over(w),
        }
    )
    return differenced(placed, shape.blocks, shape.n_exog).withColumn("lags", _past("dy", shape.history))


def dot(weights: Column, values: Column) -> Column:
    """Product sum of two arrays of any length (a fold); a zero weight needs no value."""
    product = F.zip_with(weights, values, lambda u, v: F.when(u == 0, F.lit(0.0)).otherwise(u * v))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def dot_n(a: Column, b: Column, n: int, skip: int = 0) -> Column:
    """Product sum of a[skip:] and the n-element b, spelled out for generated code."""
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.get(a, F.lit(i + skip)) * F.get(b, F.lit(i))
    return total


def with_residuals(rows: DataFrame, first_stage: DataFrame, shape: Shape) -> DataFrame:
    """Residuals of the first-stage autoregression and their lags."""
    joined = rows.join(first_stage, ["series_id", "block"], "left")
    coef = F.col("first_coef")
    fitted = (
        coef[0]
        + dot_n(coef, F.col("lags"), shape.history, 1)
        + dot_n(coef, F.col("dx"), shape.n_exog, 1 + shape.history)
    )
    residual = F.when(F.col("position") > shape.first_stage_after, F.col("dy") - fitted)
    return joined.withColumn("residual", residual).drop("first_coef").withColumn(
        "residual_lags", _past("residual", shape.ma)
    )


def without_residuals(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"residual": F.lit(None).cast("double"), "residual_lags": F.array().cast("array<double>")}
    )
