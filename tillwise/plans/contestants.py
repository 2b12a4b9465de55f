"""Reference-free contestants: predictions that need no fit, for scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS, ordered
from tillwise.operators.split import time_split

BASELINES = ["naive", "seasonal_naive", "train_mean"]


def baseline_predictions(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Previous row, row seven back, and train mean, as long predictions."""
    w = ordered(keys)
    split = time_split(daily.select(*keys, "day", "amount"), keys=keys)
    train_mean = F.avg(F.when(F.col("split") == "train", F.col("amount"))).over(Window.partitionBy(*keys))
    wide = split.select(
        *keys,
        "split",
        "day",
        F.col("amount").alias("actual"),
        F.lag("amount", 1).over(w).alias("naive"),
        F.lag("amount", 7).over(w).alias("seasonal_naive"),
        train_mean.alias("train_mean"),
    )
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in BASELINES])
    return wide.select(*keys, "split", "day", "actual", F.inline(cells)).where(F.col("predicted").isNotNull())


def repeat_last_week(daily: DataFrame, horizon: int = 7, keys=KEYS) -> DataFrame:
    """Forecast step k = value of the k-th of the last seven rows."""
    back = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    tail = daily.select(
        *keys, "amount", F.row_number().over(back).alias("_r"), F.max("day").over(Window.partitionBy(*keys)).alias("_end")
    ).where(F.col("_r") <= horizon)
    step = (F.lit(horizon + 1) - F.col("_r")).cast("int")
    return tail.select(
        *keys, step.alias("step"), F.date_add("_end", step).alias("day"), F.col("amount").alias("predicted")
    )


def recent_mean(daily: DataFrame, rows: int = 30, horizon: int = 7, keys=KEYS) -> DataFrame:
    """Flat forecast: mean of the last rows."""
    back = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    tail = daily.select(*keys, "day", "amount", F.row_number().over(back).alias("_r")).where(F.col("_r") <= rows)
    level = tail.groupBy(*keys).agg(F.max("day").alias("_end"), F.avg("amount").alias("predicted"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return level.select(*keys, "_end", "predicted", steps.alias("step")).select(
        *keys, "step", F.date_add("_end", F.col("step")).alias("day"), "predicted"
    )
