"""Registered queries of the modelling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.forecasting import sequence, store
from tillwise.forecasting.design import differenced
from tillwise.forecasting.fit import design_rows, spec_text
from tillwise.forecasting.specs import (
    ARIMA_FALLBACK,
    SARIMA_FALLBACK,
    SARIMAX_FALLBACK,
    SARIMAX_MAIN,
    SARIMAX_SINGLE,
    Spec,
    arima_grid,
    sarima_grid,
)
from tillwise.functions.scalars import tidy
from tillwise.operators import clean, evaluate, features, rollup, split
from tillwise.operators.gram import gram_cells
from tillwise.plans import pipelines
from tillwise.plans.queries import _dense, _scratch, _sparse, query, report
from tillwise.session import materialise
from tillwise.sources.transactions import event_sales, line_sales, sales

AR1 = [Spec(1, 0, 0, trend=True)]
SMALL_GRID = [Spec(p, d, 0, trend=d == 0) for d in (0, 1) for p in (0, 1)]


def _plain(spark, sf_dir, exog=()):
    return materialise(pipelines.plain_series(features.small_exog(_sparse(spark, sf_dir)), exog=list(exog)))


@query
def differencing(spark, sf_dir):
    """Regular and seasonal differences of the daily mean and a regressor."""
    series = pipelines.plain_series(_sparse(spark, sf_dir), exog=["rating"])
    blocks = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 7), (1, 1, 7), (1, 1, 14)]
    out = differenced(series, blocks, 1).where(F.col("dy").isNotNull())
    out = out.select("series_id", "day", "block", "dy", F.col("dx")[0].alias("dx"))
    return report(out, {"dy": 3, "dx": 6})


@query
def ar1_fit(spark, sf_dir):
    """AR(1) with constant per series on the train rows."""
    fit = pipelines.fit_models(_plain(spark, sf_dir), AR1, AR1[0]).best
    out = fit.select("series_id", "n", "k", F.col("phi")[0].alias("phi"), "const", F.sqrt(F.col("sse") / F.col("n")).alias("sigma"), "aic")
    return report(out, {"phi": 5, "const": 1, "sigma": 2, "aic": 3})


@query
def ar1_forecast(spark, sf_dir):
    """AR(1) forecast of the test span with 95 % interval."""
    out = pipelines.fit_models(_plain(spark, sf_dir), AR1, AR1[0]).predict("test")
    return report(out, {"predicted": 1, "lower": 1, "upper": 1})


@query
def arx_fit(spark, sf_dir):
    """AR(1) with constant and one regressor."""
    fit = pipelines.fit_models(_plain(spark, sf_dir, ["rating"]), AR1, AR1[0], 1).best
    out = fit.select("series_id", "n", F.col("phi")[0].alias("phi"), F.col("beta")[0].alias("beta"), "const")
    return report(out, {"phi": 5, "beta": 1, "const": 0})


@query
def arma_fit(spark, sf_dir):
    """ARMA(1,1) with constant in two stages: residuals of a second-order autoregression, then the regression on their lag."""
    spec = Spec(1, 0, 1, trend=True)
    fit = pipelines.fit_models(_plain(spark, sf_dir), [spec], spec, long_ar=2).best
    out = fit.select("series_id", "n", F.col("phi")[0].alias("phi"), F.col("theta")[0].alias("theta"), (F.col("const") / 1e5).alias("const"))
    return report(out, {"phi": 5, "theta": 5, "const": 5})


@query
def ar_grid_best(spark, sf_dir):
    """Least AIC over a small grid that SQL can fit as well: p in 0, 1 and d in 0, 1."""
    best = pipelines.fit_models(_plain(spark, sf_dir), SMALL_GRID, SMALL_GRID[0]).best
    return report(best.select("series_id", spec_text(SMALL_GRID).alias("spec"), "n", "aic"), {"aic": 2})


@query
def gram_matrix(spark, sf_dir):
    """Sums of squares and cross products of (1, two lags, a regressor, the target) on the train rows, as digits and exponent."""
    rows, shape = design_rows(pipelines.plain_series(_sparse(spark, sf_dir), exog=["rating"]), [Spec(2, 0, 0, trend=True)], 1)
    sample = rows.where(F.col("in_fit") & (F.col("position") > shape.sample_after))
    cells = gram_cells(sample, ["series_id"], F.concat(F.array(F.lit(1.0)), "lags", "dx", F.array("dy")))
    power = F.floor(F.log10("product"))
    out = cells.select("series_id", "i", "j", power.cast("int").alias("power"), (F.col("product") / F.pow(F.lit(10.0), power)).alias("digits"))
    return report(out, {"digits": 8})


# A series tries the orders that are at most a third of its rows; on short series the longest cannot be fitted.
TRIED = [Spec(p, 0, 0, trend=True) for p in (1, 2, 10, 12)]


@query
def candidates_by_series(spark, sf_dir):
    """Every series tries candidates of its own; those that cannot be fitted are shown as such."""
    daily = _sparse(spark, sf_dir).unionByName(rollup.daily_sparse(event_sales(spark, sf_dir)))
    series = materialise(pipelines.plain_series(daily))
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"))
    orders = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s.p).alias("p")) for i, s in enumerate(TRIED)])
    chosen = sizes.select("series_id", "n_rows", F.inline(orders)).where(F.col("p") * 3 <= F.col("n_rows")).select("series_id", "ord")
    tried = pipelines.fit_models(series, TRIED, TRIED[0], chosen=chosen).tried
    return tried.select("series_id", spec_text(TRIED).alias("spec"), "n", "k", "fitted")


@query
def stored_ar1_forecast(spark, sf_dir):
    """AR(1) models written as version 1, a newer version beside them, version 1 read in a new plan: forecast without a fit."""
    path = _scratch(spark, "models")
    series = _plain(spark, sf_dir)
    for version, spec in ((1, AR1[0]), (2, Spec(2, 0, 0, trend=True))):
        fitted = pipelines.fit_models(series, [spec], spec)
        store.write_models(store.model_rows(fitted, series, [spec], spec, origin="train"), path, "AR", version)
    ahead = series.where(~F.col("in_fit")).select("series_id", "day", "x")
    return report(store.forecast_from(store.read_models(spark, path, "AR", 1), ahead), {"predicted": 1, "lower": 1, "upper": 1})


@query
def stored_sarimax_7d(spark, sf_dir):
    """The nineteen-regressor models stored with their scalers, read back, and fed raw regressors of the next seven days."""
    path = _scratch(spark, "models")
    base = sales(spark, sf_dir)
    store.write_models(pipelines.regression_pipeline(base).model_rows(), path, "SARIMAX", 1)
    models = store.read_models(spark, path, "SARIMAX")
    daily = clean.drop_any_null(features.sparse_features(rollup.daily_sparse(base, impute="median")))
    ahead = store.inputs(models, features.future_rows(daily), features.SPARSE_FEATURES)
    out = store.in_amounts(store.forecast_from(models, ahead), models)
    return report(out, {"predicted": 2, "lower": 2, "upper": 2})


@query
def future_exog(spark, sf_dir):
    """Regressors of the next seven days."""
    out = features.future_rows(clean.drop_any_null(features.sparse_features(_sparse(spark, sf_dir))))
    places = {"rating": 6, "credit_card_ratio": 6}
    places |= {c: 3 for c in ("ma3", "ma7", "ma14", "volatility", "lag1", "lag7", "lag30", "ewm7", "ewm30")}
    return report(out, places)


@query
def arima_grid_best(spark, sf_dir):
    """Full 48-candidate grid, best per series."""
    best = pipelines.fit_models(_plain(spark, sf_dir), arima_grid(), ARIMA_FALLBACK).best
    return best.select("series_id", spec_text(arima_grid(), ARIMA_FALLBACK).alias("spec"), tidy("aic", 3).alias("aic"), "is_fallback")


@query
def sarima_grid_best(spark, sf_dir):
    """Full 144-candidate seasonal grid, best per series."""
    best = pipelines.fit_models(_plain(spark, sf_dir), sarima_grid(), SARIMA_FALLBACK).best
    return best.select("series_id", spec_text(sarima_grid(), SARIMA_FALLBACK).alias("spec"), tidy("aic", 3).alias("aic"), "is_fallback")


@query
def sarimax_7d(spark, sf_dir):
    """Nineteen-regressor pipeline, scalers on all rows: 7-day forecast in dollars."""
    out = pipelines.regression_pipeline(sales(spark, sf_dir)).future
    return report(out, {"predicted": 2, "lower": 2, "upper": 2})


@query
def sarimax_scores(spark, sf_dir):
    """The same pipeline without look-ahead (scalers on train rows): test scores."""
    test = pipelines.regression_pipeline(sales(spark, sf_dir), fit_on="train").test
    return report(evaluate.score(test, by=("series_id",)), {"RMSE": 2, "MAE": 2, "MAPE": 3, "R2": 4})


@query
def sarimax_spec(spark, sf_dir):
    best = pipelines.regression_pipeline(sales(spark, sf_dir)).fitted.best
    return best.select("series_id", spec_text(SARIMAX_MAIN, SARIMAX_FALLBACK).alias("spec"), tidy("aic", 2).alias("aic"))


@query
def sarimax_single_scores(spark, sf_dir):
    """One fixed specification with the five small regressors."""
    series = _plain(spark, sf_dir, features.SMALL_EXOG)
    test = pipelines.fit_models(series, [SARIMAX_SINGLE], SARIMAX_SINGLE, len(features.SMALL_EXOG)).predict("test")
    actual = series.select("series_id", "day", F.col("y").alias("actual"))
    out = evaluate.score(test.join(actual, ["series_id", "day"]), by=("series_id",))
    return report(out, {"RMSE": 2, "MAE": 2, "MAPE": 3, "R2": 4})


@query
def brand_grid_best(spark, sf_dir):
    """ARIMA grid over one series per part brand: fit throughput on the line items."""
    daily = rollup.daily_sparse(line_sales(spark, sf_dir))
    best = pipelines.fit_models(materialise(pipelines.plain_series(daily)), arima_grid(), ARIMA_FALLBACK).best
    return best.select("series_id", spec_text(arima_grid(), ARIMA_FALLBACK).alias("spec"), tidy("aic", 3).alias("aic"))


@query
def seq_regressor(spark, sf_dir):
    """Pooled Huber regressor on 14-day sequences: test scores."""
    windows = pipelines.sequence_table(sales(spark, sf_dir))
    test = windows.test(windows.fit("huber"))
    return report(evaluate.score(test, by=("series_id",)), {"RMSE": 1, "MAE": 1, "MAPE": 3, "R2": 4})


@query
def seq_recursive_7d(spark, sf_dir):
    """Recursive seven-day forecast of the pooled regressor."""
    windows = pipelines.sequence_table(sales(spark, sf_dir))
    return report(windows.future(windows.fit("huber")), {"predicted": 1})


@query
def seq_split_sizes(spark, sf_dir):
    """Rows and last day of the train, validation and test parts of the sequences."""
    rows = pipelines.sequence_table(sales(spark, sf_dir), valid=True).rows
    return rows.groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))


@query
def seq_weighted_recursion(spark, sf_dir):
    """Seven days from a given linear model: rising weights on fourteen targets, and one on the newest day's items."""
    dense = features.dense_features(_dense(spark, sf_dir))
    seeds = features.last_sequence(dense, "amount", features.DENSE_FEATURES)
    width = 1 + len(features.DENSE_FEATURES)
    weights = [(i + 1) / 120 if c == 0 else 0.0 for i in range(features.STEPS) for c in range(width)]
    weights[-width + 1] = 10.0
    return report(sequence.recurse_weights(weights, 5.0, seeds), {"predicted": 1})


@query
def seq_boosted(spark, sf_dir):
    """Boosted trees that stop on validation rows: error on the test rows, which the fit never saw, and tree count."""
    windows = pipelines.sequence_table(sales(spark, sf_dir), valid=True)
    rows, seeds = windows.rows, windows.seeds
    model = sequence.fit_boosted(rows)
    out = sequence.predict(model, rows.where(F.col("split") == "test")).groupBy("series_id").agg(
        F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae")
    )
    ahead = sequence.recurse_model(model, seeds).groupBy("series_id").agg(F.avg("predicted").alias("mean_ahead"))
    return report(out.join(ahead, "series_id").withColumn("trees", F.lit(model.getNumTrees)), {"mae": 4, "mean_ahead": 4})


@query
def tabular_matrix(spark, sf_dir):
    """Feature matrix of the transaction-level regression."""
    base = clean.impute(clean.drop_null(sales(spark, sf_dir), ["amount"]), "rating", "mean", ["series_id"], ["sale_id"])
    return report(sequence.tabular_features(base), {"rating": 6})


@query
def tabular_regression(spark, sf_dir):
    """Linear regression on transactions: hash split, min-max scaled on train, scores on test."""
    base = clean.impute(clean.drop_null(sales(spark, sf_dir), ["amount"]), "rating", "mean", ["series_id"], ["sale_id"])
    table = materialise(split.hash_split(sequence.tabular_features(base), "sale_id"))
    train = F.col("split") == "train"
    bounds = table.where(train).agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in sequence.TABULAR]).alias("b")
    )
    box = bounds.scalar()
    scaled = table.withColumns(
        {
            c: (F.col(c) - box[c]["lo"]) / F.when(box[c]["hi"] == box[c]["lo"], F.lit(1.0)).otherwise(box[c]["hi"] - box[c]["lo"])
            for c in sequence.TABULAR
        }
    )
    model = sequence.fit_tabular(scaled.where(train), sequence.TABULAR)
    out = sequence.predict_tabular(model, scaled.where(~train), sequence.TABULAR)
    out = out.select(F.lit("all").alias("series_id"), F.col("amount").alias("actual"), "predicted")
    return report(evaluate.score(out, by=("series_id",)), {"RMSE": 1, "MAE": 1, "MAPE": 2, "R2": 4})


@query
def two_model_comparison(spark, sf_dir):
    """Sequence and regression pipelines side by side for seven days, with the ensemble."""
    base = sales(spark, sf_dir)
    windows = pipelines.sequence_table(base)
    seq = windows.future(windows.fit())
    reg = pipelines.regression_pipeline(base).future
    out = evaluate.compare_forecasts(seq, reg.select("series_id", "day", "step", "predicted"))
    return report(out, {"first": 1, "second": 1, "ensemble": 1, "difference": 1, "percent_difference": 3})


@query
def six_model_ranking(spark, sf_dir):
    """Six models on every series: average rank over four metrics."""
    scores = evaluate.score(pipelines.six_model_predictions(sales(spark, sf_dir)))
    ranks = evaluate.rank_models(evaluate.metrics_long(scores), pipelines.SIX_MODELS)
    return report(evaluate.average_rank(ranks, pipelines.SIX_MODELS), {"avg_rank": 4})




@query
def two_model_metrics(spark, sf_dir):
    """Both pipelines scored on their test spans: metric rows by model columns, better by R2."""
    base = sales(spark, sf_dir)
    windows = pipelines.sequence_table(base)
    a = windows.test(windows.fit()).select("series_id", "day", "actual", "predicted", F.lit("SEQ").alias("model"))
    b = pipelines.regression_pipeline(base).test
    b = b.select("series_id", "day", "actual", "predicted", F.lit("REG").alias("model"))
    scores = materialise(evaluate.score(a.unionByName(b)))
    table = evaluate.metrics_table(evaluate.metrics_long(scores), ["SEQ", "REG"])
    out = table.join(evaluate.better_of_two(scores, "SEQ", "REG").select("series_id", "better"), "series_id")
    return report(out, {"SEQ": 2, "REG": 2})
