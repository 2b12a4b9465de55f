"""Window functions against pandas on series of many lengths in one job."""

import numpy as np
import pandas as pd
import pytest
from frames import column, daily, same
from pyspark.sql import functions as F

from tillwise.functions import rolling as r
from tillwise.operators import decompose, features

LENGTHS = [1, 3, 6, 7, 8, 14, 15, 30, 31, 59, 60, 120, 400]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    return {f"n{n:03d}": rng.normal(100, 20, n).round(2).tolist() for n in LENGTHS}


@pytest.fixture(scope="module")
def table(spark, series):
    w = r.ordered()
    df = daily(spark, series)
    out = df.select(
        "series_id",
        "day",
        "amount",
        *[r.rolling_mean("amount", n, w).alias(f"ma{n}") for n in (3, 7, 14, 30)],
        r.centered_mean("amount", 7, w).alias("c7"),
        r.centered_mean("amount", 30, w).alias("c30"),
        r.rolling_std("amount", 7, w).alias("sd7"),
        r.row_lag("amount", 7, w).alias("lag7"),
        r.row_diff("amount", w).alias("diff"),
    )
    return r.with_ewm(out, "amount", {"e7": 7, "e30": 30}).toPandas()


WANT = {
    "ma3": lambda x: x.rolling(3).mean(),
    "ma7": lambda x: x.rolling(7).mean(),
    "ma14": lambda x: x.rolling(14).mean(),
    "ma30": lambda x: x.rolling(30).mean(),
    "c7": lambda x: x.rolling(7, center=True).mean(),
    "c30": lambda x: x.rolling(30, center=True).mean(),
    "sd7": lambda x: x.rolling(7).std(),
    "lag7": lambda x: x.shift(7),
    "diff": lambda x: x.diff(),
    "e7": lambda x: x.ewm(span=7).mean(),
    "e30": lambda x: x.ewm(span=30).mean(),
}


@pytest.mark.parametrize("name", WANT)
def test_against_pandas(series, table, name):
    for key, values in series.items():
        got = table[table.series_id == key].sort_values("day")[name].tolist()
        assert same(got, WANT[name](pd.Series(values)).tolist(), 1e-8), (name, key)


def test_even_centred_frame_is_lopsided(spark):
    df = daily(spark, {"a": range(31)})
    got = column(df.select("series_id", "day", r.centered_mean("amount", 30, r.ordered()).alias("m")), "series_id", "m")["a"]
    assert [i + 1 for i, v in enumerate(got) if v is not None] == [16, 17]


def test_ewm_across_blocks_matches_pandas(spark):
    rng = np.random.default_rng(3)
    values = np.abs(rng.normal(50, 30, 3000)) + np.where(np.arange(3000) < 1300, 1e6, 0)
    got = column(r.with_ewm(daily(spark, {"a": values}), "amount", {"e": 7, "f": 200}), "series_id", "e")["a"]
    slow = column(r.with_ewm(daily(spark, {"a": values}), "amount", {"e": 7, "f": 200}), "series_id", "f")["a"]
    assert same(got, pd.Series(values).ewm(span=7).mean().tolist(), 1e-8)
    assert same(slow, pd.Series(values).ewm(span=200).mean().tolist(), 1e-8)


def test_fills(spark):
    data = {"a": [None, None, 1.0, None, 3.0, None], "b": [None] * 3, "c": [5.0]}
    df = daily(spark, data)
    w = r.ordered()
    out = df.select(
        "series_id",
        "day",
        r.backward_fill("amount").alias("b"),
        r.forward_fill("amount", w).alias("f"),
        F.coalesce(r.backward_fill("amount"), r.forward_fill("amount", w)).alias("both"),
    )
    for name, fn in (("b", lambda x: x.bfill()), ("f", lambda x: x.ffill()), ("both", lambda x: x.bfill().ffill())):
        got = column(out, "series_id", name)
        for key, values in data.items():
            assert same(got[key], fn(pd.Series(values, dtype=float)).tolist()), (name, key)


def test_edge_fill_equals_general_fill_on_rolling_columns(spark, series):
    df = daily(spark, series)
    w = r.ordered()
    base = df.select("*", r.centered_mean("amount", 7, w).alias("m"))
    out = base.select(
        "series_id", "day", r.edge_fill("m", w).alias("edge"), F.coalesce(r.backward_fill("m"), r.forward_fill("m", w)).alias("full")
    )
    assert out.where(~F.col("edge").eqNullSafe(F.col("full"))).count() == 0


def test_decomposition_matches_definition(spark, series):
    out = decompose.seasonal_decompose(daily(spark, series))
    pdf = out.toPandas()
    assert set(pdf.series_id) == {"n060", "n120", "n400"}  # 59 rows are too few, 60 enough
    for key, part in pdf.groupby("series_id"):
        x = np.array(series[key])
        n = len(x)
        weights = np.r_[0.5, np.ones(29), 0.5] / 30
        trend = np.full(n, np.nan)
        trend[15 : n - 15] = np.convolve(x, weights, "valid")
        phase = np.array([np.nanmean((x - trend)[k::30]) for k in range(30)])
        phase -= phase.mean()
        part = part.sort_values("day")
        assert same(part.trend, trend, 1e-8)
        assert same(part.seasonal, np.resize(phase, n), 1e-8)
        assert same(part.resid, x - trend - np.resize(phase, n), 1e-8)


def test_autocorrelation(spark, series):
    pdf = decompose.autocorrelation(daily(spark, series)).toPandas()
    for key in ("n031", "n120", "n400"):
        x = np.array(series[key])
        c = x - x.mean()
        want = np.array([(c[: len(c) - k] * c[k:]).sum() for k in range(31)]) / (c * c).sum()
        part = pdf[pdf.series_id == key].sort_values("lag")
        assert same(part.acf, want[: len(part)], 1e-8)
        band = 1.959963984540054 * np.sqrt(np.r_[0, (1 + 2 * np.r_[0, np.cumsum(want[1:] ** 2)][:30]) / len(x)])
        assert same(part.half_width, band[: len(part)], 1e-8)


def test_sequences(spark, series):
    df = daily(spark, series).withColumn("f", F.col("amount") * 2)
    out = features.sequences(df, "amount", ["f"]).toPandas()
    sizes = out.groupby("series_id").size().to_dict()
    assert sizes == {f"n{n:03d}": n - 14 for n in LENGTHS if n > 14}
    row = out[out.series_id == "n031"].sort_values("day").iloc[3]
    x = series["n031"]
    assert row.y == x[17]
    assert [list(v) for v in row.x] == [[v, v * 2] for v in x[3:17]]
    seeds = features.last_sequence(df, "amount", ["f"]).toPandas().set_index("series_id")
    assert [v[0] for v in seeds.loc["n031"].x] == series["n031"][-14:]
    assert "n008" not in seeds.index
