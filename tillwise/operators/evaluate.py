"""Scores, rankings, comparisons of models. Predictions are one long table
``(series_id, model, split, day, actual, predicted)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS

# Metric order and the float64 epsilon that guards MAPE.
METRICS = ["RMSE", "MAE", "MAPE", "R2"]
HIGHER_IS_BETTER = ["R2"]
EPSILON = 2.220446049250313e-16


def score(predictions: DataFrame, by=("series_id", "model"), extra: list[Column] = ()) -> DataFrame:
    """RMSE, MAE, MAPE (percent), R2 and any extra aggregates per group, in one pass."""
    a, p = F.col("actual"), F.col("predicted")
    error = a - p
    sse = F.sum(error * error)
    sst = F.var_pop(a) * F.count(F.lit(1))
    return (
        predictions.where(a.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(error * error)).alias("RMSE"),
            F.avg(F.abs(error)).alias("MAE"),
            (100.0 * F.avg(F.abs(error) / F.greatest(F.abs(a), F.lit(EPSILON)))).alias("MAPE"),
            F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - F.try_divide(sse, sst))
            .alias("R2"),
            *extra,
        )
    )


def metrics_long(scores: DataFrame, keys=("series_id", "model")) -> DataFrame:
    return scores.unpivot(list(keys), METRICS, "metric", "value")


def metrics_table(long: DataFrame, models: list[str], keys=KEYS) -> DataFrame:
    """Metric rows by model columns."""
    return long.groupBy(*keys, "metric").pivot("model", models).agg(F.first("value"))


def _model_order(models: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))


def rank_models(long: DataFrame, models: list[str], keys=KEYS) -> DataFrame:
    """Rank 1..m per metric, best first, ties by model order."""
    signed = F.when(F.col("metric").isin(HIGHER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy(*keys, "metric").orderBy(signed, _model_order(models))
    return long.withColumn("rank", F.row_number().over(w))


def average_rank(ranks: DataFrame, models: list[str], keys=KEYS) -> DataFrame:
    """Mean rank per model and its place; place 1 is the best overall."""
    mean = ranks.groupBy(*keys, "model").agg(F.avg("rank").alias("avg_rank"))
    w = Window.partitionBy(*keys).orderBy("avg_rank", _model_order(models))
    return mean.withColumn("place", F.row_number().over(w))


def best_per_metric(long: DataFrame, models: list[str], keys=KEYS) -> DataFrame:
    signed = F.when(F.col("metric").isin(HIGHER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    order = F.struct(signed, _model_order(models))
    return long.groupBy(*keys, "metric").agg(
        F.min_by("model", order).alias("model"), F.min_by("value", order).alias("value")
    )


def better_of_two(scores: DataFrame, first: str, second: str, keys=KEYS) -> DataFrame:
    """The first model only if its R2 is strictly greater."""
    r2 = {m: F.max(F.when(F.col("model") == m, F.col("R2"))) for m in (first, second)}
    return scores.groupBy(*keys).agg(r2[first].alias("r2_first"), r2[second].alias("r2_second")).withColumn(
        "better", F.when(F.col("r2_first") > F.col("r2_second"), F.lit(first)).otherwise(F.lit(second))
    )


def join_actual(actual: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Actual (keys, day, actual) with predicted (keys, day, model, predicted)."""
    return predicted.join(actual, [*keys, "day"])


def last_rows(predictions: DataFrame, n: int = 37, absolute: bool = True, by=("series_id", "model")) -> DataFrame:
    """Last n rows per model with the difference, absolute or predicted minus actual."""
    difference = F.col("predicted") - F.col("actual")
    w = Window.partitionBy(*by).orderBy(F.col("day").desc())
    return (
        predictions.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= n)
        .withColumn("difference", F.abs(difference) if absolute else difference)
        .drop("_r")
    )


def compare_forecasts(first: DataFrame, second: DataFrame, keys=KEYS) -> DataFrame:
    """Two forecasts (keys, step, day, predicted) side by side by horizon step.

    Adds the ensemble mean, the difference, and the symmetric percent
    difference (null when the two sum to zero).
    """
    a = first.select(*keys, "step", F.col("day").alias("day_first"), F.col("predicted").alias("first"))
    b = second.select(*keys, "step", F.col("day").alias("day_second"), F.col("predicted").alias("second"))
    mean = (F.col("first") + F.col("second")) / 2
    gap = F.col("first") - F.col("second")
    return a.join(b, [*keys, "step"]).select(
        "*",
        F.date_add(
            F.min(F.least("day_first", "day_second")).over(Window.partitionBy(*keys)), F.col("step") - 1
        ).alias("day"),
        mean.alias("ensemble"),
        gap.alias("difference"),
        (F.try_divide(gap, mean) * 100).alias("percent_difference"),
    )


def ensemble(predictions: DataFrame, keys=("series_id", "day")) -> DataFrame:
    """Mean over any number of models."""
    return predictions.groupBy(*keys).agg(F.avg("predicted").alias("predicted"))


def overlap(predictions: DataFrame, models: list[str], keys=KEYS) -> DataFrame:
    """Rows of the given models inside the days all of them cover."""
    per_model, per_series = Window.partitionBy(*keys, "model"), Window.partitionBy(*keys)
    wanted = predictions.where(F.col("model").isin(models)).withColumns(
        {"_lo": F.min("day").over(per_model), "_hi": F.max("day").over(per_model)}
    )
    bounds = {"common_start": F.max("_lo").over(per_series), "common_end": F.min("_hi").over(per_series)}
    out = wanted.withColumns(bounds).drop("_lo", "_hi")
    return out.where(F.col("day").between(F.col("common_start"), F.col("common_end")))
