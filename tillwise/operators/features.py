"""Daily feature tables and training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import (
    KEYS,
    centered_mean,
    edge_fill,
    ordered,
    rolling_mean,
    rolling_std,
    row_lag,
    with_ewm,
)
from tillwise.functions.scalars import CALENDAR, calendar_columns

# Feature lists of the two daily pipelines, in model order.
DENSE_FEATURES = ["items", "rating", "day_of_week", "month", "quarter", "is_weekend", "ma7", "ma30"]
SPARSE_FEATURES = [
    "items", "rating", "credit_card_ratio",
    "day_of_week", "day_of_month", "week_of_year",
    "month", "quarter", "is_weekend", "is_month_end",
    "ma3", "ma7", "ma14", "volatility",
    "lag1", "lag7", "lag30", "ewm7", "ewm30",
]
SPARSE_CALENDAR = SPARSE_FEATURES[3:10]
SMALL_EXOG = ["rating", "credit_card_ratio", "month", "day_of_month", "day_of_week"]
STEPS = 14


def smoothed(daily: DataFrame, keys=KEYS, column: str = "amount", n: int = 7) -> DataFrame:
    """Centred mean in place of the column, ends filled from the nearest value."""
    w = ordered(keys)
    return daily.withColumn(column, centered_mean(column, n, w)).withColumn(column, edge_fill(column, w))


def dense_features(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Smoothed amount and its eight features on a gap-free daily table."""
    w = ordered(keys)
    smooth = smoothed(daily, keys)
    out = smooth.select(
        "*",
        *calendar_columns("day", ["day_of_week", "month", "quarter", "is_weekend"]),
        rolling_mean("amount", 7, w).alias("ma7"),
        rolling_mean("amount", 30, w).alias("ma30"),
    )
    return out.withColumns({c: edge_fill(c, w) for c in ("ma7", "ma30")})


def sparse_features(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Nineteen features on the table of present days; lags count rows, not days."""
    w = ordered(keys)
    out = daily.select(
        "*",
        *calendar_columns("day", SPARSE_CALENDAR),
        rolling_mean("amount", 3, w).alias("ma3"),
        rolling_mean("amount", 7, w).alias("ma7"),
        rolling_mean("amount", 14, w).alias("ma14"),
        rolling_std("amount", 7, w).alias("volatility"),
        row_lag("amount", 1, w).alias("lag1"),
        row_lag("amount", 7, w).alias("lag7"),
        row_lag("amount", 30, w).alias("lag30"),
    )
    ends = ("ma3", "ma7", "ma14", "volatility", "lag1", "lag7", "lag30")
    out = out.withColumns({c: edge_fill(c, w) for c in ends})
    return with_ewm(out, "amount", {"ewm7": 7, "ewm30": 30}, keys)


def small_exog(daily: DataFrame) -> DataFrame:
    """The short regressor set for the daily mean model; nulls become 0."""
    out = daily.select("*", *calendar_columns("day", SMALL_EXOG[2:]))
    return out.na.fill(0, subset=SMALL_EXOG)


def sequences(
    df: DataFrame, target: str, features: list[str], steps: int = STEPS, keys=KEYS, order: str = "day"
) -> DataFrame:
    """Per target row: the previous ``steps`` rows of (target, features), oldest first."""
    w = ordered(keys, order)
    row = F.array(*[F.col(c).cast("double") for c in (target, *features)])
    past = F.collect_list(row).over(w.rowsBetween(-steps, -1))
    return (
        df.select(*keys, order, F.col(target).alias("y"), past.alias("x"))
        .where(F.size("x") == steps)
    )


def last_sequence(
    df: DataFrame, target: str, features: list[str], steps: int = STEPS, keys=KEYS, order: str = "day"
) -> DataFrame:
    """The final ``steps`` rows of every series: the seed of a recursive forecast."""
    backwards = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    row = F.array(*[F.col(c).cast("double") for c in (target, *features)])
    tail = df.select(*keys, order, row.alias("_x"), F.row_number().over(backwards).alias("_r"))
    tail = tail.where(F.col("_r") <= steps)
    seed = F.transform(F.sort_array(F.collect_list(F.struct(order, "_x"))), lambda s: s["_x"])
    out = tail.groupBy(*keys).agg(F.max(order).alias(order), seed.alias("x"))
    return out.where(F.size("x") == steps)


def with_future_rows(df: DataFrame, horizon: int = 7, keys=KEYS) -> DataFrame:
    """Append the next days to every series, with ``step`` 0 on observed rows and 1.. on new ones.

    Regressors of the new days: calendar recomputed, all else carried from the
    last row, unscaled (so scaling is applied to them once). Columns outside
    the feature list are null there. The last row emits them itself, so there
    is no second branch and no join.
    """
    is_last = F.lead("day").over(ordered(keys)).isNull()
    steps = F.sequence(F.lit(0), F.when(is_last, F.lit(horizon)).otherwise(F.lit(0)))
    spread = df.withColumn("_steps", steps).select(*df.columns, F.explode("_steps").alias("step"))
    new, day = F.col("step") > 0, F.date_add("day", F.col("step"))
    out = []
    for c in df.columns:
        if c == "day":
            out.append(day.alias("day"))
        elif c in SPARSE_CALENDAR:
            out.append(CALENDAR[c](day).alias(c))
        elif c in SPARSE_FEATURES or c in keys:
            out.append(F.col(c))
        else:
            out.append(F.when(~new, F.col(c)).alias(c))
    return spread.select(*out, "step")


def future_rows(df: DataFrame, horizon: int = 7, keys=KEYS) -> DataFrame:
    """Only the next days of every series, with their regressors."""
    out = with_future_rows(df, horizon, keys).where(F.col("step") > 0)
    return out.select(*keys, "day", *SPARSE_FEATURES)
