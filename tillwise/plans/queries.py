"""The query registry: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the given tables whole, applies operators, and rounds for
comparison only in its last projection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import rolling, scalars
from tillwise.functions.rolling import ordered
from tillwise.functions.scalars import MONTHS, tidy
from tillwise.operators import clean, decompose, encode, evaluate, features, profile, rollup, scale, split
from tillwise.plans.contestants import BASELINES, baseline_predictions, recent_mean, repeat_last_week
from tillwise.session import shared_folder
from tillwise.sources import sinks
from tillwise.sources.transactions import CSV_SCHEMA, event_sales, parse_day, read_table, read_transactions_csv, sales

QUERIES: dict = {}


def query(fn):
    """Register under the function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def report(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Round the named double columns, keep the others."""
    return df.select(*[tidy(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def _sparse(spark, sf_dir, impute="mean") -> DataFrame:
    return rollup.daily_sparse(sales(spark, sf_dir), impute=impute)


def _dense(spark, sf_dir) -> DataFrame:
    return rollup.daily_dense(sales(spark, sf_dir))


# ---- flagship --------------------------------------------------------------


@query
def weekly_naive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, dense daily roll-up, MA7, calendar, 80/20 split, lag-7 prediction, scores."""
    w = ordered()
    daily = _dense(spark, sf_dir)
    shaped = daily.select(
        "series_id",
        "day",
        F.col("amount").alias("actual"),
        F.lag("amount", 7).over(w).alias("predicted"),
        rolling.rolling_mean("amount", 7, w).alias("ma7"),
        scalars.is_weekend("day").alias("is_weekend"),
    )
    test = split.time_split(shaped).where((F.col("split") == "test") & F.col("predicted").isNotNull())
    shape = [
        F.avg("ma7").alias("mean_ma7"),
        F.sum("is_weekend").alias("weekend_days"),
        F.min("day").alias("test_start"),
    ]
    out = evaluate.score(test, by=("series_id",), extra=shape).drop("MAPE")
    return report(out, {"RMSE": 2, "MAE": 2, "R2": 6, "mean_ma7": 2})


# ---- profiles --------------------------------------------------------------


@query
def head_rows(spark, sf_dir):
    return profile.head(sales(spark, sf_dir), ["day", "sale_id"], 5)


@query
def null_profile(spark, sf_dir):
    return profile.column_info(sales(spark, sf_dir))


@query
def describe_all(spark, sf_dir):
    out = profile.describe_all(sales(spark, sf_dir), ["amount", "rating"], ["series_id", "item", "payment"])
    return report(out, {c: 3 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(sales(spark, sf_dir), "payment")


@query
def histogram_amount(spark, sf_dir):
    return report(profile.histogram(sales(spark, sf_dir), "amount", 30), {"bin_start": 3, "bin_end": 3})


@query
def histogram_rating(spark, sf_dir):
    return report(profile.histogram(sales(spark, sf_dir), "rating", 20), {"bin_start": 6, "bin_end": 6})


@query
def histogram_daily_mean(spark, sf_dir):
    """Distribution of the standardised log daily mean (50 bins)."""
    daily = _sparse(spark, sf_dir, "median").select("series_id", "day", F.log1p("amount").alias("amount_log"))
    out = scale.with_scaler(daily, ["amount_log"], scale.STANDARD).select(scale.scaled("amount_log").alias("z"))
    # Rounded first, so that both engines bin the same values.
    return report(profile.histogram(out.select(tidy("z", 6).alias("z")), "z", 50), {"bin_start": 6, "bin_end": 6})


@query
def rating_amount_points(spark, sf_dir):
    points = profile.paired_points(sales(spark, sf_dir), "rating", "amount")
    return points.groupBy("series_id", "rating").agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("lowest"), F.max("amount").alias("highest")
    )


@query
def rating_amount_correlation(spark, sf_dir):
    return report(profile.pair_correlation(sales(spark, sf_dir), "rating", "amount"), {"corr": 6})


@query
def shared_range(spark, sf_dir):
    """Common value range of the dense (sum) and sparse (mean) daily series."""
    base = rollup.daily_totals(sales(spark, sf_dir))
    sums = base.select(F.col("amount_sum").alias("v"))
    means = base.select((F.col("amount_sum") / F.col("n_rows")).alias("v"))
    return report(profile.shared_range([(sums, "v"), (means, "v")]), {"y_min": 2, "y_max": 2, "y_limit": 2})


# ---- cleaning --------------------------------------------------------------


def _impute(spark, sf_dir, how):
    kept = clean.drop_null(sales(spark, sf_dir), ["amount"])
    out = clean.impute(kept, "rating", how, ["series_id"], ["sale_id"], out="rating_filled")
    return report(out.select("sale_id", "series_id", "amount", "rating_filled"), {"rating_filled": 6})


@query
def clean_impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean")


@query
def clean_impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median")


@query
def clean_complete_rows(spark, sf_dir):
    """Drop rows with any null, keep a copy of the target, add a missing column, flags."""
    kept = clean.keep_original(clean.drop_any_null(sales(spark, sf_dir)), "amount")
    kept = clean.add_missing(kept, ["discount"])
    return kept.select(
        "sale_id",
        "amount_original",
        "discount",
        clean.equals_flag("payment", "Credit Card").alias("is_credit"),
        clean.member_flag("item", ["1-URGENT", "2-HIGH"]).alias("is_rush"),
    )


@query
def null_as_zero(spark, sf_dir):
    filled = clean.zero_fill(sales(spark, sf_dir), ["amount", "rating"])
    out = filled.groupBy("series_id").agg(
        F.avg("amount").alias("mean_amount"),
        F.avg("rating").alias("mean_rating"),
        F.count(F.lit(1)).alias("n"),
        F.sum(clean.equals_flag("payment", "Credit Card")).alias("n_credit"),
    )
    return report(out, {"mean_amount": 3, "mean_rating": 6})


@query
def date_ranges(spark, sf_dir):
    """Row counts up to, between and after two dates."""
    base = sales(spark, sf_dir).select("series_id", "day")
    a, b = F.lit("1997-06-30").cast("date"), F.lit("2000-01-01").cast("date")
    parts = [
        ("up_to", clean.up_to(base, a)),
        ("between", clean.between_open(base, a, b)),
        ("after", clean.later_than(base, b)),
    ]
    stacked = None
    for name, part in parts:
        one = part.select("series_id", F.lit(name).alias("part"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_dates(spark, sf_dir):
    """Strict and lenient date parsing of order dates as text, some of them broken."""
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    broken = F.when(F.col("o_orderkey") % 17 == 0, F.lit("n/a")).otherwise(text)
    out = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parse_day(text, "dd-MM-yyyy").cast("date").alias("strict_day"),
        parse_day(broken, "dd-MM-yyyy", lenient=True).cast("date").alias("lenient_day"),
    )
    return out


@query
def encode_categories(spark, sf_dir):
    base = sales(spark, sf_dir).select("sale_id", "day", "item", "payment")
    out = encode.code_by_first_seen(base, "item", "day", "sale_id", "item_code")
    code = encode.code_from_dict("payment", encode.PAYMENT_CODES)
    return out.select("sale_id", "item_code", code.alias("payment_code"))


@query
def customer_codes(spark, sf_dir):
    """First-appearance codes for a large dictionary: every customer with an order."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey"
    )
    return encode.first_seen_codes(orders, "customer", "day", "o_orderkey").select("customer", "code")


@query
def distinct_items(spark, sf_dir):
    return sales(spark, sf_dir).select("series_id", "item").dropDuplicates()


# ---- roll-ups --------------------------------------------------------------


@query
def daily_dense(spark, sf_dir):
    return report(_dense(spark, sf_dir), {"amount": 2, "rating": 6})


@query
def daily_sparse(spark, sf_dir):
    return report(_sparse(spark, sf_dir), {"amount": 3, "rating": 6, "credit_card_ratio": 6})


@query
def daily_sparse_median(spark, sf_dir):
    return report(_sparse(spark, sf_dir, "median"), {"amount": 3, "rating": 6, "credit_card_ratio": 6})


@query
def daily_dense_events(spark, sf_dir):
    """Times of day floored to days on the event table; no ratings at all."""
    return report(rollup.daily_dense(event_sales(spark, sf_dir)), {"amount": 3, "rating": 6})


@query
def daily_mean(spark, sf_dir):
    return report(rollup.mean_by(sales(spark, sf_dir), ["day"]), {"amount": 3})


@query
def monthly_dense(spark, sf_dir):
    return report(rollup.monthly_dense(sales(spark, sf_dir)), {"amount": 3})


@query
def monthly_present(spark, sf_dir):
    return report(rollup.monthly_present(sales(spark, sf_dir)), {"amount": 3})


@query
def weekday_profile(spark, sf_dir):
    return report(rollup.weekday_profile(sales(spark, sf_dir)), {"amount": 3})


@query
def month_profile(spark, sf_dir):
    return report(rollup.month_profile(sales(spark, sf_dir)), {"amount": 3})


@query
def weekday_month_pivot(spark, sf_dir):
    return report(rollup.weekday_month_pivot(sales(spark, sf_dir)), {m: 3 for m in MONTHS})


@query
def series_span(spark, sf_dir):
    return rollup.series_span(sales(spark, sf_dir))


@query
def last_known_values(spark, sf_dir):
    daily = _sparse(spark, sf_dir)
    out = rollup.last_known(daily, ["amount", "items", "rating"])
    return report(out, {"amount": 3, "rating": 6})


# ---- windows and features --------------------------------------------------


@query
def features_dense(spark, sf_dir):
    out = features.dense_features(_dense(spark, sf_dir))
    return report(out, {"amount": 2, "rating": 6, "ma7": 2, "ma30": 2})


_SPARSE_PLACES = {
    "amount": 3, "rating": 6, "credit_card_ratio": 6, "ma3": 3, "ma7": 3, "ma14": 3, "volatility": 3,
    "lag1": 3, "lag7": 3, "lag30": 3, "ewm7": 3, "ewm30": 3,
}


@query
def features_sparse(spark, sf_dir):
    return report(features.sparse_features(_sparse(spark, sf_dir)), _SPARSE_PLACES)


@query
def features_sparse_events(spark, sf_dir):
    """Short series: lag30 is all null, so dropping incomplete rows leaves nothing but complete ones."""
    out = features.sparse_features(rollup.daily_sparse(event_sales(spark, sf_dir)))
    kept = clean.drop_any_null(out, ["lag7", "lag30"])
    gone = out.where(F.col("lag30").isNull())
    return kept.select("series_id", "day", F.lit("kept").alias("state")).unionByName(
        gone.select("series_id", "day", F.lit("dropped").alias("state"))
    )


@query
def ma_centered(spark, sf_dir):
    w = ordered()
    out = _sparse(spark, sf_dir).select(
        "series_id",
        "day",
        rolling.centered_mean("amount", 7, w).alias("ma7"),
        rolling.centered_mean("amount", 30, w).alias("ma30"),
    )
    return report(out, {"ma7": 3, "ma30": 3})


@query
def fill_gaps_both_ways(spark, sf_dir):
    """Backward then forward fill of daily amounts with interior nulls."""
    w = ordered()
    daily = sales(spark, sf_dir).groupBy("series_id", "day").agg(F.min("amount").alias("amount"))
    out = daily.select(
        "series_id",
        "day",
        rolling.backward_fill("amount").alias("bfill"),
        rolling.forward_fill("amount", w).alias("ffill"),
    )
    return out.select("*", F.coalesce("bfill", "ffill").alias("filled"))


@query
def daily_change_hist(spark, sf_dir):
    w = ordered()
    changes = _sparse(spark, sf_dir).select(tidy(rolling.row_diff("amount", w), 3).alias("change"))
    return report(profile.histogram(changes, "change", 30), {"bin_start": 3, "bin_end": 3})


@query
def small_exog(spark, sf_dir):
    out = features.small_exog(_sparse(spark, sf_dir)).select("series_id", "day", *features.SMALL_EXOG)
    return report(out, {"rating": 6, "credit_card_ratio": 6})


@query
def sequences_14(spark, sf_dir):
    """Fourteen-row sequences over the dense features, with their 80/20 split."""
    dense = features.dense_features(_dense(spark, sf_dir))
    seq = split.time_split(features.sequences(dense, "amount", features.DENSE_FEATURES))
    out = seq.select(
        "series_id",
        "day",
        "split",
        F.size("x").alias("steps"),
        F.size(F.col("x")[0]).alias("width"),
        F.col("x")[0][0].alias("oldest"),
        F.col("x")[13][0].alias("newest"),
        F.aggregate("x", F.lit(0.0), lambda s, r: s + r[1]).alias("items_sum"),
        "y",
    )
    return report(out, {"oldest": 2, "newest": 2, "y": 2, "items_sum": 2})


# ---- scaling ---------------------------------------------------------------


@query
def scaled_minmax(spark, sf_dir):
    cols = ["amount", *features.DENSE_FEATURES]
    dense = features.dense_features(_dense(spark, sf_dir))
    out = scale.scale_columns(scale.with_scaler(dense, cols, scale.MINMAX), cols).drop("scaler")
    return report(out.select("series_id", "day", *cols), {c: 6 for c in cols})


@query
def scaled_standard(spark, sf_dir):
    cols = features.SPARSE_FEATURES
    sparse = clean.drop_any_null(features.sparse_features(_sparse(spark, sf_dir, "median")))
    logged = sparse.withColumn("amount_log", F.log1p("amount"))
    out = scale.with_scaler(logged, [*cols, "amount_log"], scale.STANDARD)
    out = out.withColumn("amount_scaled", scale.scaled("amount_log"))
    out = scale.scale_columns(out, cols)
    keep = ["amount_scaled", *cols]
    return report(out.select("series_id", "day", *keep), {c: 6 for c in keep})


@query
def scaler_params(spark, sf_dir):
    """Parameter table fitted on train rows only."""
    daily = split.time_split(_sparse(spark, sf_dir))
    out = scale.fit_scaler(daily, ["amount", "items"], scale.STANDARD, where=F.col("split") == "train")
    return report(out, {"center": 3, "scale": 3})


@query
def scale_train_only(spark, sf_dir):
    """Fit on train, transform test through the parameter table."""
    daily = split.time_split(_sparse(spark, sf_dir))
    params = scale.fit_scaler(daily, ["amount", "items"], scale.MINMAX, where=F.col("split") == "train")
    test = scale.attach_scaler(daily.where(F.col("split") == "test"), params, ["amount", "items"])
    out = test.select("series_id", "day", scale.scaled("amount").alias("amount"), scale.scaled("items").alias("items"))
    return report(out, {"amount": 6, "items": 6})


@query
def scale_roundtrip(spark, sf_dir):
    """Scale, invert, clip: gives back the daily amounts."""
    daily = _sparse(spark, sf_dir).withColumn("amount_log", F.log1p("amount"))
    mm = scale.with_scaler(daily, ["amount"], scale.MINMAX, name="mm").withColumn("a", scale.scaled("amount", "mm"))
    st = scale.with_scaler(mm, ["amount_log"], scale.STANDARD, name="st").withColumn("b", scale.scaled("amount_log", "st"))
    out = st.select(
        "series_id",
        "day",
        scale.unscaled("a", "amount", "mm").alias("from_minmax"),
        scale.amount_back("b", "amount_log", "st").alias("from_standard"),
        scale.amount_back(F.col("b") - 1000.0, "amount_log", "st").alias("clipped"),
    )
    return report(out, {"from_minmax": 3, "from_standard": 3, "clipped": 3})


# ---- splits ----------------------------------------------------------------


@query
def split_80_20(spark, sf_dir):
    return split.time_split(_sparse(spark, sf_dir).select("series_id", "day"))


@query
def split_calendar(spark, sf_dir):
    return split.calendar_split(_sparse(spark, sf_dir).select("series_id", "day"))


@query
def split_hash(spark, sf_dir):
    kept = clean.drop_null(sales(spark, sf_dir), ["amount"]).select("sale_id", "series_id")
    return split.hash_split(kept, "sale_id")


@query
def split_hash_repeated(spark, sf_dir):
    """The split by an id that many rows share: test and train rows of every id."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return split.hash_split(lines, "l_orderkey").groupBy("l_orderkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def events_by_timestamp(spark, sf_dir):
    """Roll-up by exact timestamp, not by day: mean, count, trailing mean, deviation and lag over the timestamps present."""
    w = ordered(order="ts")
    rows = rollup.daily_sparse(event_sales(spark, sf_dir), impute=None, order="ts")
    out = rows.select(
        "series_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        "amount",
        "items",
        rolling.rolling_mean("amount", 3, w).alias("ma3"),
        rolling.rolling_std("amount", 7, w).alias("volatility"),
        rolling.row_lag("amount", 7, w).alias("lag7"),
    )
    return report(out, {"amount": 3, "ma3": 3, "volatility": 3, "lag7": 3})


# ---- decomposition ---------------------------------------------------------


@query
def decompose_30(spark, sf_dir):
    out = decompose.seasonal_decompose(_sparse(spark, sf_dir))
    return report(out, {c: 3 for c in ("observed", "trend", "seasonal", "resid")})


@query
def decompose_30_events(spark, sf_dir):
    """Thirty-day series: too short, no rows."""
    out = decompose.seasonal_decompose(rollup.daily_sparse(event_sales(spark, sf_dir)))
    return out.groupBy().agg(F.count(F.lit(1)).alias("n"))


@query
def acf_30(spark, sf_dir):
    out = decompose.autocorrelation(_sparse(spark, sf_dir))
    return report(out, {"acf": 6, "half_width": 6})


# ---- evaluation ------------------------------------------------------------


def _scored(spark, sf_dir):
    preds = baseline_predictions(_sparse(spark, sf_dir)).where(F.col("split") == "test")
    return evaluate.score(preds)


def _long(spark, sf_dir):
    return evaluate.metrics_long(_scored(spark, sf_dir))


@query
def metrics_by_model(spark, sf_dir):
    return report(_scored(spark, sf_dir), {"RMSE": 3, "MAE": 3, "MAPE": 4, "R2": 6})


@query
def metrics_pivot(spark, sf_dir):
    return report(evaluate.metrics_table(_long(spark, sf_dir), BASELINES), {m: 3 for m in BASELINES})


@query
def model_ranking(spark, sf_dir):
    ranks = evaluate.rank_models(_long(spark, sf_dir), BASELINES)
    return report(evaluate.average_rank(ranks, BASELINES), {"avg_rank": 4})


@query
def best_per_metric(spark, sf_dir):
    return report(evaluate.best_per_metric(_long(spark, sf_dir), BASELINES), {"value": 3})


@query
def better_by_r2(spark, sf_dir):
    out = evaluate.better_of_two(_scored(spark, sf_dir), "seasonal_naive", "train_mean")
    return report(out, {"r2_first": 6, "r2_second": 6})


@query
def ensemble_7d(spark, sf_dir):
    daily = _sparse(spark, sf_dir).select("series_id", "day", "amount")
    out = evaluate.compare_forecasts(repeat_last_week(daily), recent_mean(daily))
    out = out.withColumns({"ensemble_text": scalars.money_text(tidy("ensemble", 2)), "day_text": scalars.date_text("day")})
    return report(out, {"first": 3, "second": 3, "ensemble": 3, "difference": 3, "percent_difference": 4})


@query
def ensemble_all_models(spark, sf_dir):
    preds = baseline_predictions(_sparse(spark, sf_dir)).where(F.col("split") == "test")
    return report(evaluate.ensemble(preds), {"predicted": 3})


@query
def overlap_window(spark, sf_dir):
    """Common days of a model scored on sequences (dense) and one on rows (sparse)."""
    dense = _dense(spark, sf_dir)
    seq = split.time_split(features.sequences(dense, "amount", ["items"])).where(F.col("split") == "test")
    a = seq.select("series_id", F.lit("sequence").alias("model"), "day", F.col("y").alias("actual"))
    b = split.time_split(_sparse(spark, sf_dir)).where(F.col("split") == "test")
    b = b.select("series_id", F.lit("rows").alias("model"), "day", F.col("amount").alias("actual"))
    out = evaluate.overlap(a.unionByName(b), ["sequence", "rows"])
    return report(out, {"actual": 3})


def _last(spark, sf_dir, absolute):
    preds = baseline_predictions(_sparse(spark, sf_dir)).where(F.col("split") == "test")
    out = evaluate.last_rows(preds, 37, absolute=absolute)
    return report(out, {"actual": 3, "predicted": 3, "difference": 3})


@query
def last_37_absolute(spark, sf_dir):
    return _last(spark, sf_dir, True)


@query
def last_37_signed(spark, sf_dir):
    return _last(spark, sf_dir, False)


@query
def score_summary(spark, sf_dir):
    """Metrics truncated to whole numbers, as the printed summary shows them."""
    s = _scored(spark, sf_dir)
    return s.select("series_id", "model", *[scalars.whole(m).alias(m) for m in ("RMSE", "MAE", "MAPE")], tidy("R2", 2).alias("R2"))


@query
def actual_vs_predicted(spark, sf_dir):
    """Predictions joined to actuals by date."""
    daily = _sparse(spark, sf_dir)
    predicted = baseline_predictions(daily).where((F.col("split") == "test") & (F.col("model") == "naive"))
    actual = daily.select("series_id", "day", F.col("amount").alias("actual"))
    out = evaluate.join_actual(actual, predicted.select("series_id", "day", "model", "predicted"))
    out = out.withColumn("difference", F.abs(F.col("actual") - F.col("predicted")))
    return report(out, {"predicted": 3, "actual": 3, "difference": 3})


@query
def future_spine(spark, sf_dir):
    """Seven days after the last day of every series, with calendar features."""
    ends = rollup.series_span(sales(spark, sf_dir)).select("series_id", "last_day")
    days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", 7))
    out = ends.select("series_id", F.explode(days).alias("day"))
    return out.select("*", *scalars.calendar_columns("day", ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend", "is_month_end"]))


# ---- sources and sinks -----------------------------------------------------


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_source(spark, sf_dir):
    """Sales written as a header CSV and read back through the CSV source."""
    path = _scratch(spark, "csv")
    item, amount, rating, date, payment = CSV_SCHEMA.fieldNames()
    text = sales(spark, sf_dir).select(
        F.col("item").alias(item),
        F.col("amount").alias(amount),
        F.col("rating").alias(rating),
        F.date_format("day", "dd-MM-yyyy").alias(date),
        F.col("payment").alias(payment),
        F.col("sale_id").alias("Sale"),
        F.col("series_id").alias("Segment"),
    )
    text.write.option("header", True).csv(path)
    back = read_transactions_csv(spark, path, text.schema, series_column="Segment", id_column="Sale")
    return back.select("sale_id", "series_id", "amount", "item", "rating", "day", "payment")


@query
def predictions_sink(spark, sf_dir):
    """Predictions written by model, one model read back (one directory scanned)."""
    path = _scratch(spark, "predictions")
    sinks.write_predictions(baseline_predictions(_sparse(spark, sf_dir)), path)
    out = sinks.read_predictions(spark, path).where((F.col("model") == "naive") & (F.col("split") == "test"))
    return report(out, {"actual": 3, "predicted": 3})


@query
def predictions_by_model(spark, sf_dir):
    """Two models written one after the other to one table, the first written again with other rows; both read back."""
    path = _scratch(spark, "predictions")
    rows = baseline_predictions(_sparse(spark, sf_dir))
    for model, part in (("naive", "train"), ("seasonal_naive", "test"), ("naive", "test")):
        sinks.write_predictions(rows.where((F.col("model") == model) & (F.col("split") == part)), path)
    return report(sinks.read_predictions(spark, path), {"actual": 3, "predicted": 3})
