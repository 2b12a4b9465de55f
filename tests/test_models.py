"""Fits and forecasts against brute force."""

import numpy as np
import pytest
from frames import column, day, same
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tillwise.forecasting import sequence
from tillwise.forecasting.design import LONG_AR, differenced
from tillwise.forecasting.fit import level_polynomial, solve
from tillwise.forecasting.forecast import psi_weights, roll_forward, running_squares
from tillwise.forecasting.specs import ARIMA_FALLBACK, SARIMA_FALLBACK, Spec, arima_grid, sarima_grid, spec_table
from tillwise.operators import features
from tillwise.plans import pipelines


def series_table(spark, data, fit_share=0.8, exog=None, future=0):
    rows = []
    for key, values in data.items():
        n = len(values)
        for i, v in enumerate(values):
            x = [float(e[i]) for e in exog[key]] if exog else []
            rows.append((key, day(i), float(v), x, i < int(n * fit_share), False))
        for j in range(future):
            x = [float(e[n + j]) for e in exog[key]] if exog else []
            rows.append((key, day(n + j), None, x, False, True))
    return spark.createDataFrame(
        rows, "series_id string, day date, y double, x array<double>, in_fit boolean, ahead boolean"
    )


@pytest.fixture(scope="module")
def ar2():
    rng = np.random.default_rng(11)
    out = {}
    for key in "abc":
        x = np.zeros(2000)
        for t in range(2, 2000):
            x[t] = 1 + 0.5 * x[t - 1] + 0.2 * x[t - 2] + rng.normal()
        out[key] = x
    return out


def test_grid_sizes(spark):
    assert len(arima_grid()) == 48 and len(sarima_grid()) == 144
    table = spec_table(spark, sarima_grid())
    assert table.count() == 144 and table.dropDuplicates(["p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q"]).count() == 144


def test_recovers_ar2(spark, ar2):
    spec = Spec(2, 0, 0, trend=True)
    best = pipelines.fit_models(series_table(spark, ar2), [spec], spec).best.collect()
    assert len(best) == 3
    for r in best:
        assert np.allclose(r["phi"], [0.5, 0.2], atol=0.1)
        assert r["const"] == pytest.approx(1, abs=0.4)


def test_gram_route_equals_lstsq(spark, ar2):
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(size=2000), rng.normal(size=2000)
    y = ar2["a"] + 3 * x1 - 2 * x2
    for spec in (Spec(3, 1, 0, 1, 1, 0, 7), Spec(2, 0, 0, trend=True), Spec(1, 2, 0)):
        table = series_table(spark, {"a": y}, exog={"a": [x1, x2]})
        r = pipelines.fit_models(table, [spec], spec, 2).best.first()
        z = np.column_stack([y, x1, x2])
        for _ in range(spec.D):
            z = np.vstack([np.full((spec.s, 3), np.nan), z[spec.s :] - z[: -spec.s]])
        for _ in range(spec.d):
            z = np.vstack([np.full((1, 3), np.nan), z[1:] - z[:-1]])
        lags = spec.ar_lags()
        start = spec.d + spec.D * spec.s + max(lags)
        design = np.column_stack([np.roll(z[:, 0], k) for k in lags] + [z[:, 1], z[:, 2]])
        if spec.trend:
            design = np.column_stack([np.ones(len(y)), design])
        use = slice(start, 1600)
        want, sse, *_ = np.linalg.lstsq(design[use], z[use, 0], rcond=None)
        got = ([r["const"]] if spec.trend else []) + [r["phi"][k - 1] for k in lags] + list(r["beta"])
        assert np.allclose(got, want, rtol=1e-8, atol=1e-9), spec
        assert r["sse"] == pytest.approx(float(sse[0]), rel=1e-6)
        assert r["n"] == 1600 - start


def test_moving_average_two_stage_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=3000)
    y = 5 + e + 0.6 * np.r_[0, e[:-1]]
    spec = Spec(0, 0, 1, trend=True)
    r = pipelines.fit_models(series_table(spark, {"a": y}), [spec], spec).best.first()
    n, m = 2400, LONG_AR
    lagged = np.column_stack([np.ones(3000)] + [np.roll(y, k) for k in range(1, m + 1)])
    long_ar = np.linalg.lstsq(lagged[m:n], y[m:n], rcond=None)[0]
    residual = y - lagged @ long_ar
    use = slice(m + 1, n)
    want = np.linalg.lstsq(np.column_stack([np.ones(3000), np.roll(residual, 1)])[use], y[use], rcond=None)[0]
    assert np.allclose([r["const"], r["theta"][0]], want, rtol=1e-8)
    assert r["theta"][0] == pytest.approx(0.6, abs=0.08)


def test_best_is_least_aic_of_the_whole_grid(spark, ar2):
    fitted = pipelines.fit_models(series_table(spark, ar2), arima_grid(), ARIMA_FALLBACK)
    fits = fitted.fits.toPandas()
    assert (fits.groupby("series_id").size() == 48).all()
    assert fits.groupby("series_id").n.nunique().max() == 1  # one sample for all candidates
    best = fitted.best.toPandas().set_index("series_id")
    for key, part in fits.groupby("series_id"):
        assert best.loc[key].aic == part.aic.min()
        assert best.loc[key].ord == part.sort_values(["aic", "ord"]).iloc[0].ord


def test_fold_values(spark):
    df = spark.range(1).select(F.array(F.lit(3.0), F.lit(2.0)).alias("past"), F.array(F.lit(0.5), F.lit(0.2)).alias("w"))
    zeros = F.array_repeat(F.lit(0.0), 7)
    got = df.select(roll_forward(zeros, F.col("w"), F.col("past"))).first()[0]
    assert same(got, [1.9, 1.55, 1.155, 0.8875, 0.67475, 0.514875, 0.3923875])
    oldest_first = df.select(roll_forward(zeros, F.col("w"), F.reverse("past"))).first()[0]
    assert same(np.round(oldest_first, 4), [1.6, 1.2, 0.92, 0.7, 0.534, 0.407, 0.3103])


def test_psi_weights(spark):
    theta, w = [0.4, 0.1], [0.5, 0.2, 0.0]
    df = spark.createDataFrame([(theta, w)], "t array<double>, w array<double>")
    got, squares = df.select(
        psi_weights(F.col("t"), F.col("w"), F.lit(6)).alias("p"),
        running_squares(psi_weights(F.col("t"), F.col("w"), F.lit(6))),
    ).first()
    want = [1.0]
    for j in range(1, 6):
        want.append(sum(w[i - 1] * want[j - i] for i in range(1, min(j, 3) + 1)) + (theta[j - 1] if j <= 2 else 0))
    assert same(got, want)
    assert same(squares, np.cumsum(np.square(want)))


def test_level_polynomial():
    # (1 - 0.5B)(1 - B)(1 - B^7)
    want = np.zeros(9)
    for lag, v in ((1, 1.5), (2, -0.5), (7, 1.0), (8, -1.5), (9, 0.5)):
        want[lag - 1] = v
    assert np.allclose(level_polynomial(np.array([0.5]), (1, 1, 7), 9), want)
    assert np.allclose(solve(np.diag([4.0, 0.0]), np.array([8.0, 0.0])), [2, 0], atol=1e-6)


def test_forecast_equals_recursion(spark, ar2):
    """Seasonal ARMA with regressors: the fold equals a plain loop with the same coefficients."""
    rng = np.random.default_rng(9)
    n, h = 400, 7
    x = rng.normal(size=n + h)
    y = ar2["b"][:n] + 2 * x[:n] + 5 * np.sin(np.arange(n) * 2 * np.pi / 7)
    spec = Spec(2, 1, 2, 1, 1, 1, 7)
    table = series_table(spark, {"a": y}, exog={"a": [x]}, future=h)
    fitted = pipelines.fit_models(table, [spec], spec, 1)
    m = fitted.best.first()
    residual = {r["day"]: r["residual"] for r in fitted.rows.collect()}
    for horizon, origin, steps in (("test", 320, n - 320), ("future", n, h)):
        level = list(y[:origin])
        e = [residual[day(i)] or 0.0 for i in range(origin)]
        dx = np.r_[np.full(7, np.nan), x[7:] - x[:-7]]
        dx = np.r_[np.nan, dx[1:] - dx[:-1]]
        want = []
        for i in range(origin, origin + steps):
            v = m["const"] + m["beta"][0] * dx[i]
            v += sum(a * level[i - k] for k, a in enumerate(m["level_ar"], 1))
            v += sum(t * e[i - k] for k, t in enumerate(m["theta"], 1))
            level.append(v)
            e.append(0.0)
            want.append(v)
        got = fitted.predict(horizon).orderBy("day").collect()
        assert [r["step"] for r in got] == list(range(1, steps + 1))
        assert [r["day"] for r in got] == [day(i) for i in range(origin, origin + steps)]
        assert same([r["predicted"] for r in got], want, 1e-8)
        width = np.array([r["upper"] - r["lower"] for r in got])
        assert (np.diff(width) > -1e-9).all() and width[0] == pytest.approx(2 * 1.959963984540054 * np.sqrt(m["sse"] / m["n"]))


def test_short_series_fall_back_and_never_fail(spark, ar2):
    data = {"long": ar2["a"][:300], "short": np.arange(12.0), "one": [4.0]}
    fitted = pipelines.fit_models(series_table(spark, data), sarima_grid(), SARIMA_FALLBACK)
    best = {r["series_id"]: r for r in fitted.best.collect()}
    assert set(best) == {"long", "short", "one"}
    assert not best["long"]["is_fallback"] and best["short"]["is_fallback"] and best["one"]["is_fallback"]
    got = column(fitted.predict("test"), "series_id", "predicted")
    assert len(got["long"]) == 60
    # (1 - B)(1 - B^7) on a straight line continues it.
    assert same(got["short"], [9.0, 10.0, 11.0])


def test_differencing_of_vectors(spark):
    y, x = np.arange(20.0) ** 2, np.arange(20.0) ** 3
    out = differenced(series_table(spark, {"a": y}, exog={"a": [x]}), [(0, 0, 0), (2, 0, 0), (1, 1, 7)], 1)
    for block, want in ((1, np.diff(y, 2)), (2, np.diff(y[7:] - y[:-7]))):
        rows = out.where((F.col("block") == block) & F.col("dy").isNotNull()).orderBy("day").collect()
        assert same([r["dy"] for r in rows], want)
    assert same([r["dx"][0] for r in rows], np.diff(x[7:] - x[:-7]))


@pytest.fixture(scope="module")
def seeds(spark):
    rng = np.random.default_rng(4)
    return [rng.normal(size=(14, 3)) for _ in range(4)]


def recursion(predict, seed):
    state, out = seed.copy(), []
    for _ in range(7):
        v = predict(state.ravel())
        row = state[-1].copy()
        row[0] = v
        state = np.vstack([state[1:], row])
        out.append(v)
    return out


def test_recursive_forecasts(spark, seeds):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 42)), rng.normal(size=300)
    train = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    table = spark.createDataFrame(
        [(f"s{i}", day(30), s.tolist()) for i, s in enumerate(seeds)], "series_id string, day date, x array<array<double>>"
    )
    linear = LinearRegression(regParam=0.01).fit(train)
    trees = GBTRegressor(maxIter=3, maxDepth=2, seed=1).fit(train)
    fold = column(sequence.recurse_linear(linear, table), "series_id", "predicted")
    chain = column(sequence.recurse_model(linear, table), "series_id", "predicted")
    boosted = column(sequence.recurse_model(trees, table), "series_id", "predicted")
    for i, seed in enumerate(seeds):
        want = recursion(lambda v: float(v @ linear.coefficients.toArray() + linear.intercept), seed)
        assert same(fold[f"s{i}"], want) and same(chain[f"s{i}"], want)
        assert same(boosted[f"s{i}"], recursion(lambda v: trees.predict(Vectors.dense(v)), seed))


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x = rng.normal(size=(14, 1))
        y = 2 * x[-1, 0] + (500 if i % 40 == 0 else 0)
        rows.append((x.tolist(), float(y)))
    train = spark.createDataFrame(rows, "x array<array<double>>, y double")
    huber, squared = sequence.fit_linear(train, "huber", 100), sequence.fit_linear(train, "squaredError")
    assert abs(huber.coefficients[13] - 2) < 0.05 and abs(huber.intercept) < 1
    assert abs(squared.intercept) > 5


def test_future_rows(spark):
    names = [c for c in features.SPARSE_FEATURES if c not in features.SPARSE_CALENDAR]
    values = {c: float(i) for i, c in enumerate(names)}
    base = spark.createDataFrame([("a", day(0), 1.0), ("a", day(58), 2.0)], "series_id string, day date, amount double")
    df = base.select("*", *[F.lit(v).alias(c) for c, v in values.items()], *features.calendar_columns("day", features.SPARSE_CALENDAR))
    got = features.future_rows(df).orderBy("day").collect()
    assert [r["day"] for r in got] == [day(59 + i) for i in range(7)]
    assert got[0]["is_month_end"] == 1 and got[1]["month"] == 3  # 2024-02-29, then March
    assert all(r[c] == v for r in got for c, v in values.items())
    full = features.with_future_rows(df)
    assert full.count() == 9 and full.where(F.col("amount").isNotNull()).count() == 2


def test_task_functions_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tillwise.forecasting import fit

    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps((fit.least_squares, fit.level_polynomial, Spec(1, 0, 0))))
    code = (
        "import pickle, numpy as np; f, p, s = pickle.load(open('f.pkl', 'rb'));"
        "x = np.arange(9.0); m = np.column_stack([np.ones(9), x, 2 * x + 1 + x % 2]);"
        "print(s.ar_lags(), f(m.T @ m, [0], True)[1])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True, check=True)
    lags, slope = done.stdout.strip().split("] [")
    assert lags == "[1" and float(slope.rstrip("]")) == pytest.approx(2)
