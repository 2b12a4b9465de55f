"""Edge cases of cleaning, roll-up, scaling, splits, scores."""

import datetime
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from frames import column, daily, day, sales, same
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillwise.functions import scalars
from tillwise.operators import clean, encode, evaluate, profile, rollup, scale, split
from tillwise.sources import sinks, transactions

D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def gap(spark):
    return sales(
        spark,
        [
            (1, "a", 10.0, "x", 4.0, day(0), "Cash"),
            (2, "a", 30.0, None, None, day(0), "Credit Card"),
            (3, "a", 5.0, "y", 2.0, day(1), None),
            (4, "a", None, "y", 1.0, day(2), "Cash"),
            (5, "a", 7.0, "x", None, day(4), "Credit Card"),
            (6, "b", None, "x", 3.0, day(0), "Cash"),
        ],
    )


def test_dense_fills_gaps_with_zero(gap):
    got = rows(rollup.daily_dense(gap), "series_id", "day")
    assert [(r[1], r[2], r[3]) for r in got] == [
        (day(0), 40.0, 1), (day(1), 5.0, 1), (day(2), 0.0, 0), (day(3), 0.0, 0), (day(4), 7.0, 1),
    ]
    # Mean rating of the kept rows is 3: it replaces the two nulls; empty days are 0.
    assert [r[4] for r in got] == [3.5, 2.0, 0.0, 0.0, 3.0]


def test_sparse_keeps_present_days_and_counts_null_payment(gap):
    got = rows(rollup.daily_sparse(gap), "series_id", "day")
    assert [(r[1], r[2], r[3], r[5]) for r in got] == [
        (day(0), 20.0, 1, 0.5), (day(1), 5.0, 1, 0.0), (day(4), 7.0, 1, 1.0),
    ]


def test_rollup_imputation_equals_row_imputation(spark):
    rng = np.random.default_rng(1)
    data = [
        (i, "ab"[i % 2], float(rng.integers(1, 99)), "x", None if rng.random() < 0.4 else float(rng.integers(1, 6)), day(i % 9), "Cash")
        for i in range(200)
    ]
    df = sales(spark, data)
    for how in ("mean", "median"):
        direct = clean.impute(df, "rating", how, ["series_id"], ["sale_id"]).groupBy("series_id", "day").agg(F.avg("rating").alias("want"))
        both = rollup.daily_sparse(df, impute=how).join(direct, ["series_id", "day"])
        assert both.count() == 18
        assert both.where(F.abs(F.col("rating") - F.col("want")) > 1e-12).count() == 0


def test_series_without_any_rating(spark):
    df = sales(spark, [(1, "a", 1.0, "x", None, day(0), "Cash"), (2, "a", 2.0, "x", None, day(2), "Cash")])
    assert [r[4] for r in rows(rollup.daily_dense(df), "day")] == [0.0, 0.0, 0.0]
    assert [r[4] for r in rows(rollup.daily_sparse(df, impute="median"), "day")] == [None, None]


def test_monthly_dense_has_empty_months(spark):
    df = sales(spark, [(1, "a", 4.0, "x", 1.0, D(2023, 12, 5), "Cash"), (2, "a", 6.0, "x", 1.0, D(2024, 2, 1), "Cash")])
    assert [(r[1], r[2]) for r in rows(rollup.monthly_dense(df), "month_end")] == [
        (D(2023, 12, 31), 4.0), (D(2024, 1, 31), None), (D(2024, 2, 29), 6.0),
    ]
    assert [r[1] for r in rows(rollup.monthly_present(df), "month")] == ["2023-12", "2024-02"]


def test_reindex_adds_unseen_weekday(spark):
    df = sales(spark, [(1, "a", 4.0, "x", 1.0, day(0), "Cash"), (2, "a", 6.0, "x", 1.0, day(2), "Cash")])
    got = rows(rollup.weekday_profile(df), "position")
    assert [(r[2], r[3]) for r in got][:3] == [("Monday", 4.0), ("Tuesday", None), ("Wednesday", 6.0)]
    assert len(got) == 7


def test_calendar(spark):
    df = spark.createDataFrame([(D(2024, 12, 30),), (D(2025, 1, 1),), (D(2024, 2, 29),)], "day date")
    out = df.select("day", *scalars.calendar_columns("day", list(scalars.CALENDAR)))
    got = {r["day"]: r for r in out.collect()}
    assert [got[d]["week_of_year"] for d in (D(2024, 12, 30), D(2025, 1, 1), D(2024, 2, 29))] == [1, 1, 9]
    assert [got[d]["is_month_end"] for d in (D(2024, 12, 30), D(2025, 1, 1), D(2024, 2, 29))] == [0, 0, 1]
    for d, r in got.items():
        ts = pd.Timestamp(d)
        assert (r["day_of_week"], r["month"], r["quarter"], r["year"], r["day_of_month"], r["is_weekend"]) == (
            ts.dayofweek, ts.month, ts.quarter, ts.year, ts.day, int(ts.dayofweek >= 5),
        )


def test_text_scalars(spark):
    r = spark.range(1).select(
        scalars.money_text(F.lit(3.14159)), scalars.date_text(F.lit("2024-03-05").cast("date")), scalars.whole(F.lit(-2.7)),
        scalars.at_least_zero(F.lit(-1.0)),
    ).first()
    assert tuple(r) == ("$3.14", "2024-03-05", -2, 0.0)


def test_codes(spark):
    same_day = day(3)
    df = sales(
        spark,
        [
            (4, "a", 1.0, "late", 1.0, same_day, "Cash"),
            (2, "a", 1.0, "second", 1.0, same_day, "Voucher"),
            (3, "a", 1.0, "second", 1.0, day(0), "Credit Card"),
            (1, "a", 1.0, "third", 1.0, same_day, None),
        ],
    )
    out = encode.code_by_first_seen(df, "item", "day", "sale_id", "code")
    out = out.withColumn("pay", encode.code_from_dict("payment", encode.PAYMENT_CODES))
    assert [(r["item"], r["code"], r["pay"]) for r in out.orderBy("sale_id").collect()] == [
        ("third", 1, None), ("second", 0, None), ("second", 0, 1), ("late", 2, 0),
    ]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]], "v double")
    got = [(r["bin"], r["n"]) for r in profile.histogram(df, "v", 5).orderBy("bin").collect()]
    assert [n for _, n in got] == np.histogram([0, 1, 2, 3, 4, 5, 6, 7, 8, 10], 5)[0].tolist()
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert sum(r["n"] for r in profile.histogram(flat, "v", 4).collect()) == 3


def test_scaling_of_constant_column_and_roundtrip(spark):
    df = daily(spark, {"a": [5.0] * 10, "b": [1.0, 2.0, 4.0]})
    for method in (scale.MINMAX, scale.STANDARD):
        out = scale.with_scaler(df, ["amount"], method).withColumn("z", scale.scaled("amount"))
        assert set(column(out, "series_id", "z")["a"]) == {0.0}
        back = out.withColumn("back", scale.unscaled("z", "amount"))
        assert back.where(F.abs(F.col("back") - F.col("amount")) > 1e-12).count() == 0
        params = scale.fit_scaler(df, ["amount"], method)
        joined = scale.attach_scaler(df, params, ["amount"]).withColumn("z2", scale.scaled("amount"))
        assert same(column(joined, "series_id", "z2")["b"], column(out, "series_id", "z")["b"])


def test_time_split_sizes(spark):
    df = daily(spark, {f"n{n}": range(n) for n in (1, 4, 5, 9, 10, 31)})
    out = split.time_split(df).groupBy("series_id").agg(F.count_if(F.col("split") == "train").alias("t"))
    assert {r[0]: r[1] for r in out.collect()} == {f"n{n}": int(n * 0.8) for n in (1, 4, 5, 9, 10, 31)}


def test_calendar_split(spark):
    df = daily(spark, {"a": range(101)})
    out = {r["day"]: r["split"] for r in split.calendar_split(df).collect()}
    assert out[day(70)] == "train" and out[day(71)] == "valid" and out[day(90)] == "valid" and out[day(91)] == "test"


@pytest.mark.parametrize("n", [1, 7, 500])
def test_hash_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "sale_id")
    got = {r["sale_id"] for r in split.hash_split(df.repartition(5), "sale_id").where("split = 'test'").collect()}
    ranked = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
    assert got == set(ranked[: math.ceil(0.2 * n)])


def predictions(spark, values):
    rows_ = [("s", m, "test", day(i), float(a), float(p)) for m, a_p in values.items() for i, (a, p) in enumerate(a_p)]
    return spark.createDataFrame(rows_, "series_id string, model string, split string, day date, actual double, predicted double")


def test_scores(spark):
    p = predictions(spark, {"m": [(1, 2), (3, 3), (8, 5)], "flat": [(2, 2), (2, 2)], "off": [(2, 3), (2, 2)], "zero": [(0, 1), (2, 2)]})
    got = {r["model"]: r for r in evaluate.score(p).collect()}
    a, b = np.array([1, 3, 8.0]), np.array([2, 3, 5.0])
    assert got["m"]["RMSE"] == pytest.approx(np.sqrt(((a - b) ** 2).mean()))
    assert got["m"]["MAE"] == pytest.approx(abs(a - b).mean())
    assert got["m"]["MAPE"] == pytest.approx(100 * (abs(a - b) / a).mean())
    assert got["m"]["R2"] == pytest.approx(1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert got["flat"]["R2"] == 1.0 and got["off"]["R2"] == 0.0
    assert math.isfinite(got["zero"]["MAPE"]) and got["zero"]["MAPE"] > 1e15


def test_ties_rank_by_model_order(spark):
    p = predictions(spark, {"b": [(1, 2), (3, 3)], "a": [(1, 2), (3, 3)], "c": [(1, 1), (3, 3)]})
    long = evaluate.metrics_long(evaluate.score(p))
    order = ["b", "a", "c"]
    places = evaluate.average_rank(evaluate.rank_models(long, order), order)
    assert {r["model"]: r["place"] for r in places.collect()} == {"c": 1, "b": 2, "a": 3}
    assert {r["model"] for r in evaluate.best_per_metric(long, order).collect()} == {"c"}
    assert evaluate.better_of_two(evaluate.score(p), "b", "a").first()["better"] == "a"


def test_forecasts_that_cancel(spark):
    f = "series_id string, step int, day date, predicted double"
    a = spark.createDataFrame([("s", 1, day(1), 2.0)], f)
    b = spark.createDataFrame([("s", 1, day(3), -2.0)], f)
    got = evaluate.compare_forecasts(a, b).first()
    assert got["ensemble"] == 0 and got["percent_difference"] is None and got["difference"] == 4
    assert got["day"] == day(1)  # dates count from the earlier start


def test_last_rows_signed_and_absolute(spark):
    p = predictions(spark, {"m": [(i, i - 1) for i in range(50)]})
    absolute = evaluate.last_rows(p, 37).collect()
    assert len(absolute) == 37 and {r["difference"] for r in absolute} == {1.0}
    assert min(r["day"] for r in absolute) == day(13)
    assert {r["difference"] for r in evaluate.last_rows(p, 37, absolute=False).collect()} == {-1.0}


def test_all_null_column_empties_only_its_series(spark):
    df = daily(spark, {"a": [None, None], "b": [1.0, 2.0]})
    assert {r["series_id"] for r in clean.drop_any_null(df).collect()} == {"b"}


def test_csv_source(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        "Item Purchased,Purchase Amount (USD),Review Rating,Date Purchase,Payment Method\n"
        "Scarf,12.5,4.1,05-02-2023,Cash\nBelt,,,17-02-2023,Credit Card\nHat,3,2,oops,Cash\n"
    )
    with pytest.raises(PySparkException):
        transactions.read_transactions_csv(spark, str(path)).collect()
    got = transactions.read_transactions_csv(spark, str(path), lenient_dates=True).orderBy("item").collect()
    assert [(r["item"], r["amount"], r["rating"], r["day"], r["series_id"]) for r in got] == [
        ("Belt", None, None, D(2023, 2, 17), "all"), ("Hat", 3.0, 2.0, None, "all"), ("Scarf", 12.5, 4.1, D(2023, 2, 5), "all"),
    ]
    by_item = transactions.read_transactions_csv(spark, str(path), lenient_dates=True, series_column="Item Purchased")
    assert by_item.select("series_id").distinct().count() == 3


def test_sinks(spark, tmp_path):
    p = predictions(spark, {"m": [(1, 2)], "k": [(3, 4)]})
    sinks.write_predictions(p, str(tmp_path / "p"))
    assert (tmp_path / "p" / "model=m").is_dir()
    back = sinks.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.select(*p.columns).collect())) == sorted(map(str, p.collect()))
    sinks.write_metrics(evaluate.metrics_long(evaluate.score(p)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 8
    params = scale.fit_scaler(daily(spark, {"a": [1.0, 2.0]}), ["amount"], scale.MINMAX)
    sinks.write_scaler_params(params, str(tmp_path / "s"))
    assert tuple(spark.read.parquet(str(tmp_path / "s")).first()) == ("a", "amount", 1.0, 1.0)
