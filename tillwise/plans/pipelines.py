"""The modelling pipelines end to end, for every series at once.

The daily table is the narrow waist: transactions are scanned once, the daily
rows are checkpointed to the shared folder, and the model stages branch from
there instead of repeating the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.forecasting import sequence, store
from tillwise.forecasting.design import LONG_AR, Shape
from tillwise.forecasting.fit import best_by_aic, design_rows, fit_candidates, with_fallback
from tillwise.forecasting.forecast import forecast
from tillwise.forecasting.specs import (
    ARIMA_FALLBACK,
    SARIMA_FALLBACK,
    SARIMAX_COMPARED,
    SARIMAX_FALLBACK,
    SARIMAX_MAIN,
    Spec,
    arima_grid,
    sarima_grid,
)
from tillwise.operators import clean, features, rollup, scale, split
from tillwise.session import materialise


@dataclass
class Fitted:
    """Candidates tried on a series table, those that could be fitted, and the best one per series."""

    rows: DataFrame
    shape: Shape
    tried: DataFrame
    fits: DataFrame
    best: DataFrame

    def predict(self, horizon: str) -> DataFrame:
        return forecast(self.rows, self.best, self.shape, horizon)


def fit_models(series: DataFrame, specs: list[Spec], fallback: Spec, n_exog: int = 0, chosen: DataFrame | None = None, long_ar: int = LONG_AR) -> Fitted:
    """Fit all candidates, keep the best by AIC, cover unfitted series by the fallback.

    ``chosen`` (series_id, ord) lets every series try candidates of its own; ``long_ar`` is the order of the
    autoregression behind moving-average terms.
    """
    wanted = list(specs)
    if fallback.block not in {s.block for s in specs}:
        wanted.append(fallback)
    rows, shape = design_rows(series, wanted, n_exog, long_ar)
    # Read by the fit and by both forecasts.
    rows = materialise(rows.drop("x"))
    tried = materialise(fit_candidates(rows, shape, specs, chosen))
    fits = tried.where("fitted").drop("fitted")
    return Fitted(rows, shape, tried, fits, with_fallback(best_by_aic(fits), series, shape, fallback))


def plain_series(daily: DataFrame, y: str = "amount", exog: list[str] = ()) -> DataFrame:
    """Series table on the raw daily mean, 80/20 split, no future rows."""
    x = F.array(*[F.col(c).cast("double") for c in exog]).cast("array<double>")
    return split.time_split(daily).select(
        "series_id", "day", F.col(y).alias("y"), x.alias("x"), (F.col("split") == "train").alias("in_fit"),
        F.lit(False).alias("ahead"),
    )


def scaled_series(sales: DataFrame, fit_on: str = "all", horizon: int = 7) -> DataFrame:
    """Nineteen-regressor series table on the standardised log daily mean, plus future rows.

    ``fit_on`` says which rows the scalers see: every observed row or train only.
    """
    names = features.SPARSE_FEATURES
    daily = clean.drop_any_null(features.sparse_features(rollup.daily_sparse(sales, impute="median")))
    observed = split.time_split(daily).withColumn("amount_log", F.log1p("amount"))
    table = features.with_future_rows(observed, horizon).withColumn(
        "split", F.when(F.col("step") > 0, F.lit("future")).otherwise(F.col("split"))
    )
    table = materialise(table)  # read by the scaler fit and by its application
    seen = F.col("split") != "future" if fit_on == "all" else F.col("split") == "train"
    table = scale.with_scaler(table, ["amount_log", *names], scale.STANDARD, where=seen)
    return table.select(
        "series_id",
        "day",
        "split",
        "amount",
        scale.scaled("amount_log").alias("y"),
        F.array(*[scale.scaled(c) for c in names]).alias("x"),
        (F.col("split") == "train").alias("in_fit"),
        (F.col("split") == "future").alias("ahead"),
        "scaler",
    )


def in_dollars(predicted: DataFrame, scalers: DataFrame) -> DataFrame:
    """Scaled predictions back to amounts: inverse standardise, expm1, clip at zero."""
    out = predicted.join(scalers, "series_id")
    return out.withColumns(
        {c: scale.amount_back(F.col(c), "amount_log") for c in ("predicted", "lower", "upper")}
    ).drop("scaler")


@dataclass
class Outcome:
    """Test predictions (with actuals), future forecast, chosen models of one pipeline, and what they were fitted on."""

    test: DataFrame
    future: DataFrame
    fitted: Fitted
    series: DataFrame
    scalers: DataFrame

    def model_rows(self, specs: list[Spec] = SARIMAX_MAIN) -> DataFrame:
        """The chosen models with their scalers, ready to be stored."""
        names = ["amount_log", *features.SPARSE_FEATURES]
        cells = [x for c in names for x in (F.lit(store.TARGET if c == "amount_log" else c), F.col("scaler")[c])]
        scaler = self.scalers.select("series_id", F.create_map(*cells).alias("scaler"))
        return store.model_rows(self.fitted, self.series, specs, SARIMAX_FALLBACK, "last", tuple(features.SPARSE_FEATURES), scaler)


def regression_pipeline(
    sales: DataFrame, specs: list[Spec] = SARIMAX_MAIN, fit_on: str = "all", horizon: int = 7
) -> Outcome:
    """Sparse daily series, nineteen regressors, candidates by AIC, test and 7-day forecasts."""
    table = scaled_series(sales, fit_on, horizon)
    scalers = materialise(table.groupBy("series_id").agg(F.first("scaler").alias("scaler")))
    series = table.drop("scaler")
    fitted = fit_models(series, specs, SARIMAX_FALLBACK, len(features.SPARSE_FEATURES))
    actual = series.select("series_id", "day", F.col("amount").alias("actual"))
    test = in_dollars(fitted.predict("test"), scalers).join(actual, ["series_id", "day"])
    return Outcome(test, in_dollars(fitted.predict("future"), scalers), fitted, series, scalers)


@dataclass
class Sequences:
    """Scaled training sequences of every series and the seeds of the recursion."""

    rows: DataFrame
    seeds: DataFrame

    def fit(self, loss: str = "huber"):
        """Pooled linear regressor; Spark ML keeps its own cached copy of the training rows."""
        return sequence.fit_linear(self.rows.where(F.col("split") == "train"), loss)

    def test(self, model) -> DataFrame:
        """Test predictions in amounts."""
        return sequence.predict(model, self.rows.where(F.col("split") == "test")).select(
            "series_id",
            "day",
            scale.unscaled("y", "amount").alias("actual"),
            scale.unscaled("predicted", "amount").alias("predicted"),
        )

    def future(self, model) -> DataFrame:
        """Recursive seven-day forecast in amounts."""
        out = sequence.recurse_linear(model, self.seeds).join(self.seeds.select("series_id", "scaler"), "series_id")
        return out.select("series_id", "day", "step", scale.unscaled("predicted", "amount").alias("predicted"))


def sequence_table(sales: DataFrame, fit_on: str = "all", valid: bool = False) -> Sequences:
    """Min-max scaled dense features as sequences with their split, and the seeds.

    With ``valid`` the last eighth of the train rows is set apart for validation; test rows are the same either way.
    """
    columns = ["amount", *features.DENSE_FEATURES]
    dense = features.dense_features(rollup.daily_dense(sales))
    seen = None
    if fit_on == "train":
        dense = split.time_split(dense)
        seen = F.col("split") == "train"
    dense = materialise(dense)  # read by the scaler fit and by its application
    table = scale.with_scaler(dense, columns, scale.MINMAX, where=seen)
    keep = F.struct("scaler.amount").alias("scaler")
    table = scale.scale_columns(table, columns).select("series_id", "day", *columns, keep)
    scalers = table.groupBy("series_id").agg(F.first("scaler").alias("scaler"))
    parted = split.three_way_split if valid else split.time_split
    rows = parted(features.sequences(table, "amount", features.DENSE_FEATURES)).join(scalers, "series_id")
    seeds = features.last_sequence(table, "amount", features.DENSE_FEATURES).join(scalers, "series_id")
    return Sequences(rows, seeds)


# Fixed value: order of the compared models (ties in ranks go to the earlier one).
SIX_MODELS = ["ARIMA", "ARIMAX", "SARIMA", "SARIMAX", "SEQ_SQUARED", "SEQ_HUBER"]


def six_model_predictions(sales: DataFrame) -> DataFrame:
    """Test predictions of six models on every series, as one long table.

    ARIMAX refits ARIMA's chosen orders with regressors and falls back to
    ARIMA's forecast where that fails.
    """
    daily = materialise(features.small_exog(rollup.daily_sparse(sales)))
    plain = materialise(plain_series(daily))
    exog = materialise(plain_series(daily, exog=features.SMALL_EXOG))
    k = len(features.SMALL_EXOG)

    arima = fit_models(plain, arima_grid(), ARIMA_FALLBACK)
    sarima = fit_models(plain, sarima_grid(), SARIMA_FALLBACK)
    sarimax = fit_models(exog, SARIMAX_COMPARED, SARIMA_FALLBACK, k)
    arimax = fit_models(exog, arima_grid(), ARIMA_FALLBACK, k, chosen=arima.best.where(F.col("ord").isNotNull()))
    arimax_rows = forecast(arimax.rows, arimax.fits, arimax.shape, "test")

    arima_rows = arima.predict("test")
    arimax_rows = arima_rows.select("series_id", "day", F.col("predicted").alias("_plain")).join(
        arimax_rows, ["series_id", "day"], "left"
    ).withColumn("predicted", F.coalesce("predicted", "_plain"))

    actual = plain.select("series_id", "day", F.col("y").alias("actual"))
    stacked = None
    for name, rows in (
        ("ARIMA", arima_rows),
        ("ARIMAX", arimax_rows),
        ("SARIMA", sarima.predict("test")),
        ("SARIMAX", sarimax.predict("test")),
    ):
        one = rows.select("series_id", F.lit(name).alias("model"), "day", "predicted")
        stacked = one if stacked is None else stacked.unionByName(one)
    out = stacked.join(actual, ["series_id", "day"])
    windows = sequence_table(sales)
    for name, loss in (("SEQ_SQUARED", "squaredError"), ("SEQ_HUBER", "huber")):
        out = out.unionByName(windows.test(windows.fit(loss)).withColumn("model", F.lit(name)))
    return out.select("series_id", "model", F.lit("test").alias("split"), "day", "actual", "predicted")
