"""Fitted models as a table that forecasts without a fit.

A row holds all that a forecast of one series needs: coefficients, the weights of its past levels, the
last rows before the origin with their residuals, the differences taken, the regressors' names
and the scaler. The table is partitioned by model and version; a write replaces the partitions it
holds and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.forecasting.design import Shape, differenced
from tillwise.forecasting.fit import spec_text
from tillwise.forecasting.forecast import forecast
from tillwise.forecasting.specs import Spec
from tillwise.functions.rolling import ordered
from tillwise.functions.scalars import at_least_zero
from tillwise.sources.sinks import write_partitions

MODEL_SCHEMA = (
    "series_id string, spec string, aic double, is_fallback boolean, d int, seasonal_d int, season int, differencing int, "
    "features array<string>, n long, sse double, const double, beta array<double>, theta array<double>, level_ar array<double>, "
    "recent array<struct<day:date,y:double,x:array<double>,residual:double>>, "
    "scaler map<string,struct<center:double,scale:double>>, model string, version int"
)
TARGET = "target"  # the scaler's entry for the forecast column


def model_rows(
    fitted, series: DataFrame, specs: list[Spec], fallback: Spec, origin: str = "last", features: tuple[str, ...] = (), scaler: DataFrame | None = None
) -> DataFrame:
    """One row per series of a fit, ready to be written.

    ``series`` is the table the fit was made on. ``origin`` "last" forecasts from the last observed row, "train"
    from the last row of the fit. ``scaler`` (series_id, scaler map) says how raw regressors and the target
    were scaled, if they were.
    """
    shape: Shape = fitted.shape
    keep = max(shape.level_lags, shape.ma, shape.differencing, 1)
    back = F.col("to_end") if origin == "last" else F.col("to_fit_end")
    tail = fitted.rows.where(~F.col("ahead") & (back >= 0) & (back < keep)).select("series_id", "block", "day", "y", "residual")
    tail = tail.join(fitted.best.select("series_id", "block"), ["series_id", "block"]).join(series.select("series_id", "day", "x"), ["series_id", "day"])
    recent = tail.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("day", "y", "x", "residual"))).alias("recent"))
    block = F.get(F.array(*[F.array(*[F.lit(v) for v in b]) for b in shape.blocks]), F.col("block"))
    out = fitted.best.join(recent, "series_id")
    out = out.join(scaler, "series_id", "left") if scaler is not None else out.withColumn("scaler", F.lit(None).cast("map<string,struct<center:double,scale:double>>"))
    return out.select(
        "series_id",
        spec_text(specs, fallback).alias("spec"),
        "aic",
        "is_fallback",
        block[0].alias("d"),
        block[1].alias("seasonal_d"),
        block[2].alias("season"),
        F.lit(shape.differencing).alias("differencing"),
        F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("features"),
        *["n", "sse", "const", "beta", "theta", "level_ar", "recent", "scaler"],
    )


def write_models(rows: DataFrame, path: str, model: str, version: int) -> None:
    """Write one version of a model; other models and versions stay as they are."""
    names = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
    stamped = rows.withColumns({"model": F.lit(model), "version": F.lit(version)})
    write_partitions(stamped.select(*names), path, "model", "version")


def read_models(spark: SparkSession, path: str, model: str, version: int | None = None) -> DataFrame:
    """The models of one version, by default the latest; only its partition is read."""
    rows = spark.read.schema(MODEL_SCHEMA).parquet(path).where(F.col("model") == model)
    if version is None:
        version = rows.agg(F.max("version")).scalar()
    return rows.where(F.col("version") == version)


def inputs(models: DataFrame, ahead: DataFrame, names: list[str]) -> DataFrame:
    """(series_id, day, x): raw regressor columns scaled by each series' stored scaler."""
    scaler = models.select("series_id", "scaler")
    entry = lambda c: F.col("scaler")[c]
    x = F.array(*[(F.col(c) - entry(c)["center"]) / entry(c)["scale"] for c in names])
    return ahead.join(scaler, "series_id").select("series_id", "day", x.cast("array<double>").alias("x"))


def forecast_from(models: DataFrame, ahead: DataFrame) -> DataFrame:
    """Forecast the rows of ``ahead`` (series_id, day, x) that follow each model's origin: (series_id, day, step, predicted, lower, upper).

    Series without a model, or without rows, give none. Only the differences and lengths that the stored models
    need are looked up first: a row per different specification.
    """
    sizes = models.groupBy("d", "seasonal_d", "season", "differencing").agg(
        F.max(F.size("level_ar")).alias("lags"), F.max(F.size("theta")).alias("ma"), F.max(F.size("beta")).alias("n_exog")
    ).collect()
    most = lambda name: max((r[name] for r in sizes), default=0)
    blocks = sorted({(r["d"], r["seasonal_d"], r["season"]) for r in sizes}) or [(0, 0, 0)]
    differencing = most("differencing")
    shape = Shape(blocks, most("lags") - differencing, most("ma"), 0, differencing, most("n_exog"))
    past = models.select("series_id", F.inline("recent")).select("series_id", "day", "y", "x", "residual", F.lit(False).alias("ahead"))
    missing = F.lit(None).cast("double")
    new = ahead.select("series_id", "day", missing.alias("y"), "x", missing.alias("residual"), F.lit(True).alias("ahead"))
    rows = past.unionByName(new.join(models.select("series_id"), "series_id", "left_semi"))
    position = F.count_if(~F.col("ahead")).over(Window.partitionBy("series_id")) - F.row_number().over(ordered())
    rows = differenced(rows.withColumn("to_end", position), shape.blocks, shape.n_exog)
    return forecast(rows, models.withColumn("block", _number(blocks)), shape, "future")


def _number(blocks: list[tuple[int, int, int]]) -> Column:
    here = lambda b: (F.col("d") == b[0]) & (F.col("seasonal_d") == b[1]) & (F.col("season") == b[2])
    return F.coalesce(*[F.when(here(b), F.lit(i)) for i, b in enumerate(blocks)])


def in_amounts(predicted: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions on the scaled log target back to amounts, by each series' stored scaler, clipped at zero."""
    p = F.col("scaler")[TARGET]
    out = predicted.join(models.select("series_id", "scaler"), "series_id")
    back = {c: at_least_zero(F.expm1(F.col(c) * p["scale"] + p["center"])) for c in ("predicted", "lower", "upper")}
    return out.withColumns(back).drop("scaler")
