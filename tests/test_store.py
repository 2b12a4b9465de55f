"""Gram sums, per-series candidate lists, stored models and per-model tables."""

import numpy as np
import pytest
from frames import column, day, same
from pyspark.sql import functions as F
from test_models import ar2, series_table  # noqa: F401

from tillwise.forecasting import store
from tillwise.forecasting.fit import fit_candidates, full_matrix, least_squares
from tillwise.forecasting.specs import SARIMAX_MAIN, Spec
from tillwise.operators import clean, features, rollup
from tillwise.operators.gram import gram, gram_cells
from tillwise.plans import pipelines
from tillwise.sources import sinks
from tillwise.sources.transactions import sales

SF = "/root/testdata/sf0.001"


def test_gram_equals_matrix_product(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.normal(size=(n, 4)) for k, n in (("a", 300), ("b", 7), ("c", 1))}
    rows = [(k, [float(x) for x in v]) for k, m in data.items() for v in m] + [("a", [1.0, None, 2.0, 3.0]), ("d", [None] * 4)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    got = {r["k"]: full_matrix(r["cells"]) for r in gram(df, ["k"], F.col("v")).collect()}
    assert set(got) == {"a", "b", "c"}  # a key whose rows are all incomplete has no matrix
    for k, m in data.items():
        assert np.allclose(got[k], m.T @ m, rtol=1e-12)


def test_gram_sums_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    plan = gram_cells(df, ["k"], F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_sum")  # printed from the top down
    assert {(r["k"], r["i"], r["j"]): r["product"] for r in gram_cells(df, ["k"], F.col("v")).collect()}[(0, 0, 0)] == 500


def test_only_matrices_reach_python(spark, ar2):  # noqa: F811
    spec = Spec(2, 1, 1)
    fitted = pipelines.fit_models(series_table(spark, ar2), [spec], spec)
    plan = fit_candidates(fitted.rows, fitted.shape, [spec])._jdf.queryExecution().analyzed()
    fields = plan.children().apply(0).output()
    assert {fields.apply(i).name() for i in range(fields.size())} == {"series_id", "block", "tries", "cells"}


def test_least_squares_refuses_exact_and_short_samples():
    def matrix(x, y):
        m = np.column_stack([np.ones(len(y)), x, y])
        return m.T @ m

    x = np.arange(40.0)
    assert least_squares(matrix(x, 2 * x + 1), [0], True) is None  # no error left: rounding alone
    assert least_squares(matrix(x[:3], x[:3] ** 2), [0], True) is None  # as many rows as parameters and one
    const, b, sse = least_squares(matrix(x, 2 * x + 1 + np.arange(40) % 2), [0], True)
    assert b[0] == pytest.approx(2, abs=0.01) and sse == pytest.approx(10, rel=0.01)


def test_every_series_solves_its_own_list(spark, ar2):  # noqa: F811
    specs = [Spec(1, 0, 0, trend=True), Spec(2, 0, 0, trend=True), Spec(2, 1, 1)]
    data = {k: v[:200] for k, v in ar2.items()} | {"short": np.sin(np.arange(8.0))}
    table = series_table(spark, data)
    every = {(r["series_id"], r["ord"]): r for r in pipelines.fit_models(table, specs, specs[0]).tried.collect()}
    assert len(every) == 12 and not any(r["fitted"] for (s, _), r in every.items() if s == "short")
    wanted = [("a", 0), ("a", 2), ("b", 1), ("short", 2), ("short", 2)]
    fitted = pipelines.fit_models(table, specs, specs[0], chosen=spark.createDataFrame(wanted, "series_id string, ord int"))
    tried = {(r["series_id"], r["ord"]): r for r in fitted.tried.collect()}
    assert set(tried) == set(wanted)
    for key, r in tried.items():
        assert r["fitted"] == every[key]["fitted"]
        assert not r["fitted"] or r["aic"] == pytest.approx(every[key]["aic"])
    best = {r["series_id"]: r for r in fitted.best.collect()}
    assert best["b"]["ord"] == 1 and best["c"]["is_fallback"] and best["short"]["is_fallback"]


@pytest.mark.parametrize("origin", ["train", "last"])
def test_stored_models_forecast_like_fresh_ones(spark, ar2, tmp_path, origin):  # noqa: F811
    """Seasonal differences, residuals and regressors survive the table; each series with a specification of its own."""
    rng = np.random.default_rng(9)
    n, h = 300, 7
    data = {k: ar2[k][:n] + 5 * np.sin(np.arange(n) * 2 * np.pi / 7) for k in "ab"} | {"short": np.arange(12.0)}
    exog = {k: [rng.normal(size=n + h)] for k in data}
    table = series_table(spark, data, exog=exog, future=h)
    specs = [Spec(2, 1, 2, 1, 1, 1, 7), Spec(1, 0, 1, trend=True)]
    chosen = spark.createDataFrame([("a", 0), ("b", 1), ("short", 0)], "series_id string, ord int")
    fitted = pipelines.fit_models(table, specs, specs[0], 1, chosen=chosen)
    path = str(tmp_path / "models")
    store.write_models(store.model_rows(fitted, table, specs, specs[0], origin), path, "m", 1)
    ahead = table.where(~F.col("in_fit") & ~F.col("ahead") if origin == "train" else F.col("ahead"))
    got = store.forecast_from(store.read_models(spark, path, "m"), ahead.select("series_id", "day", "x"))
    want = fitted.predict("test" if origin == "train" else "future")
    for c in ("day", "step", "predicted", "lower", "upper"):
        a, b = column(got, "series_id", c), column(want, "series_id", c)
        assert set(a) == set(b) and len(a["a"]) == (60 if origin == "train" else 7)
        assert all(a[k] == b[k] if c in ("day", "step") else same(a[k], b[k], 1e-8) for k in a)


def test_versions_and_models_stay_apart(spark, ar2, tmp_path):  # noqa: F811
    path = str(tmp_path / "models")
    table = series_table(spark, {"a": ar2["a"][:300]})
    for model, version, p in (("x", 1, 1), ("x", 2, 2), ("y", 7, 1), ("x", 1, 3)):
        spec = Spec(p, 0, 0, trend=True)
        fitted = pipelines.fit_models(table, [spec], spec)
        store.write_models(store.model_rows(fitted, table, [spec], spec), path, model, version)
    spec_of = lambda *a: [r["spec"] for r in store.read_models(spark, path, *a).collect()]
    assert spec_of("x") == ["(2,0,0)(0,0,0,0)+c"] and spec_of("x", 1) == ["(3,0,0)(0,0,0,0)+c"] and spec_of("y") == ["(1,0,0)(0,0,0,0)+c"]
    assert spec_of("none") == []
    assert store.forecast_from(store.read_models(spark, path, "none"), table.select("series_id", "day", "x")).count() == 0


def test_stored_scalers_take_raw_regressors(spark, tmp_path):
    base = sales(spark, SF)
    outcome = pipelines.regression_pipeline(base, SARIMAX_MAIN)
    store.write_models(outcome.model_rows(), str(tmp_path / "m"), "SARIMAX", 1)
    models = store.read_models(spark, str(tmp_path / "m"), "SARIMAX")
    assert models.first()["features"] == features.SPARSE_FEATURES
    daily = clean.drop_any_null(features.sparse_features(rollup.daily_sparse(base, impute="median")))
    ahead = store.inputs(models, features.future_rows(daily), features.SPARSE_FEATURES)
    got = column(store.in_amounts(store.forecast_from(models, ahead), models), "series_id", "predicted")
    want = column(outcome.future, "series_id", "predicted")
    assert set(got) == set(want) and all(same(got[k], want[k], 1e-6) for k in want)


def predictions(spark, model, values):
    rows = [("a", model, "test", day(i), 1.0, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, model string, split string, day date, actual double, predicted double")


def test_a_write_replaces_its_own_models_only(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_predictions(predictions(spark, "GRU", [1, 2, 3]), path)
    sinks.write_predictions(predictions(spark, "SARIMAX", [4]), path)
    sinks.write_predictions(predictions(spark, "GRU", [5, 6]), path)
    read = lambda: {m: sorted(v) for m, v in column(sinks.read_predictions(spark, path), "model", "predicted").items()}
    assert read() == {"GRU": [5, 6], "SARIMAX": [4]}
    broken = predictions(spark, "GRU", range(100)).repartition(4).withColumn("predicted", F.expr("if(predicted = 77, raise_error('stop'), predicted)").cast("double"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_predictions(broken, path)
    assert read() == {"GRU": [5, 6], "SARIMAX": [4]}
    metrics = str(tmp_path / "m")
    for model, value in (("GRU", 1.0), ("SARIMAX", 2.0), ("GRU", 3.0)):
        sinks.write_metrics(spark.createDataFrame([("a", model, "MAE", value)], "series_id string, model string, metric string, value double"), metrics)
    assert column(spark.read.parquet(metrics), "model", "value", "metric") == {"GRU": [3.0], "SARIMAX": [2.0]}
