"""Multi-step forecasts as folds over arrays, one row per series, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.forecasting.design import Shape, dot, dot_n
from tillwise.operators.decompose import Z95


def roll_forward(drivers: Column, weights: Column, past: Column) -> Column:
    """Values y_1..y_h with y_t = driver_t + weights . (newest values first), oldest first."""
    grown = F.aggregate(
        drivers,
        past,
        lambda seen, d: F.concat(F.array(d + dot(weights, F.slice(seen, 1, F.size(weights)))), seen),
    )
    return F.reverse(F.slice(grown, 1, F.size(drivers)))


def _shock_effect(theta: Column, shocks: Column, step: Column) -> Column:
    """Contribution of shocks before the origin (newest first) to the given step."""
    left = F.size(theta) - step + 1
    return F.when(left > 0, dot(F.slice(theta, step, F.greatest(left, F.lit(0))), F.slice(shocks, 1, F.greatest(left, F.lit(0))))).otherwise(
        F.lit(0.0)
    )


def psi_weights(theta: Column, weights: Column, steps: Column) -> Column:
    """Effect of a unit shock after 0..steps-1 steps."""
    drivers = F.transform(
        F.filter(F.sequence(F.lit(1), steps), lambda j: j < steps),
        lambda j: F.coalesce(F.get(theta, j - 1), F.lit(0.0)),
    )
    start = F.concat(F.array(F.lit(1.0)), F.transform(weights, lambda _: F.lit(0.0)))
    return F.concat(F.array(F.lit(1.0)), roll_forward(drivers, weights, start))


def running_squares(values: Column) -> Column:
    """Cumulative sums of squares, oldest first."""
    empty = F.array().cast("array<double>")
    summed = F.aggregate(
        values, empty, lambda s, v: F.concat(F.array(F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)) + v * v), s)
    )
    return F.reverse(summed)


def forecast(rows: DataFrame, models: DataFrame, shape: Shape, horizon: str = "test") -> DataFrame:
    """Forecast the test span or the future rows: (series_id, day, step, predicted, lower, upper).

    ``rows`` is the design table, ``models`` one fitted model per series. The
    test span is forecast from the last row of the fit, the future from the
    last observed row. Only the rows of the chosen block near that origin and
    beyond it are kept, so the arrays are as long as the lags and the horizon.
    """
    keep = max(shape.level_lags, shape.ma, 1)
    to_origin = F.col("to_fit_end") if horizon == "test" else F.col("to_end")
    wanted = ~F.col("ahead") if horizon == "test" else F.lit(True)
    chosen = rows.where(wanted & (to_origin < keep)).select(
        "series_id",
        "block",
        "day",
        "y",
        "dx",
        (to_origin < 0).alias("ahead"),
        to_origin.alias("to_origin"),
        "residual",
    )
    columns = ["series_id", "block", "const", "beta", "theta", "level_ar", "sse", "n"]
    joined = chosen.join(models.select(*columns), ["series_id", "block"])
    driver = F.col("const") + dot_n(F.col("beta"), F.col("dx"), shape.n_exog)
    past_row = F.when(~F.col("ahead"), F.struct("to_origin", "y", F.coalesce("residual", F.lit(0.0)).alias("e")))
    ahead_row = F.when(F.col("ahead"), F.struct("day", driver.alias("driver")))
    gathered = joined.groupBy("series_id").agg(
        F.sort_array(F.collect_list(past_row)).alias("past"),
        F.sort_array(F.collect_list(ahead_row)).alias("next"),
        *[F.first(c).alias(c) for c in ("theta", "level_ar", "sse", "n")],
    )
    shocks = F.transform("past", lambda r: r["e"])
    drivers = F.transform(
        "next", lambda r, i: r["driver"] + _shock_effect(F.col("theta"), F.col("_shocks"), i + 1)
    )
    out = gathered.where(F.size("next") > 0).withColumn("_shocks", shocks).withColumn("_drivers", drivers)
    out = out.withColumns(
        {
            "_y": roll_forward(F.col("_drivers"), F.col("level_ar"), F.transform("past", lambda r: r["y"])),
            "_spread": running_squares(psi_weights(F.col("theta"), F.col("level_ar"), F.size("next"))),
            "_days": F.transform("next", lambda r: r["day"]),
        }
    )
    zipped = F.posexplode(F.arrays_zip("_days", "_y", "_spread"))
    out = out.select("series_id", (F.col("sse") / F.col("n")).alias("_var"), zipped.alias("_i", "_r"))
    half = F.lit(Z95) * F.sqrt(F.col("_var") * F.col("_r._spread"))
    return out.select(
        "series_id",
        F.col("_r._days").alias("day"),
        (F.col("_i") + 1).alias("step"),
        F.col("_r._y").alias("predicted"),
        (F.col("_r._y") - half).alias("lower"),
        (F.col("_r._y") + half).alias("upper"),
    ).where(F.col("predicted").isNotNull())
