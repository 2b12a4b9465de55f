"""Roll-ups from transactions to daily, monthly and seasonal tables.

Every grouping here aggregates on the map side first, so a hot series sends at
most one partial row per day and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS
from tillwise.functions.scalars import MONTHS, WEEKDAYS, day_name, month_name
from tillwise.operators.keyed import exact_quantiles

CREDIT = "Credit Card"


def share_equal(column: str, value) -> Column:
    """Share of rows equal to the value; null is not equal but stays in the denominator."""
    return F.avg(F.when(F.col(column) == value, F.lit(1.0)).otherwise(F.lit(0.0)))


def fill_gaps(df: DataFrame, zero: list[str], keys=KEYS, order: str = "day") -> DataFrame:
    """Every calendar day between a series' first and last row; new days hold 0 in ``zero``.

    Each present row emits itself and the empty days before the next row, so
    one window replaces the spine and its join. Other columns become null on
    the new days.
    """
    following = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    days = F.sequence(F.col(order), F.coalesce(F.date_sub(following, 1), F.col(order)))
    spread = df.withColumn("_days", days).select("*", F.explode("_days").alias("_day"))
    present = F.col("_day") == F.col(order)
    return spread.select(
        *keys,
        F.col("_day").alias(order),
        *[
            F.when(present, F.col(c)).otherwise(F.lit(0).cast(t) if c in zero else F.lit(None)).alias(c)
            for c, t in df.dtypes
            if c not in (*keys, order)
        ],
    )


def daily_totals(sales: DataFrame, keys=KEYS, impute: str | None = "mean", order: str = "day") -> DataFrame:
    """One row per series and day with a non-null amount: sums, counts, rating mean.

    ``order`` may be any other column that can be sorted, such as a timestamp, which is then not cut to its day.

    Imputing ratings row by row and then averaging per day equals
    (rating sum + fill * missing) / rows, so the fill value meets day rows
    instead of transactions and no transaction-level join is needed.
    """
    kept = sales.where(F.col("amount").isNotNull())
    daily = kept.groupBy(*keys, order).agg(
        F.sum("amount").alias("amount_sum"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("item").alias("items"),
        F.sum("rating").alias("_rating_sum"),
        F.count("rating").alias("_ratings"),
        share_equal("payment", CREDIT).alias("credit_card_ratio"),
    )
    per_series = Window.partitionBy(*keys)
    if impute == "median":
        medians = exact_quantiles(kept, list(keys), "rating", {"_fill": 0.5}).select(*keys, "_fill")
        daily = daily.join(medians, list(keys), "left")
    elif impute == "mean":
        daily = daily.withColumn(
            "_fill", F.try_divide(F.sum("_rating_sum").over(per_series), F.sum("_ratings").over(per_series))
        )
    else:
        daily = daily.withColumn("_fill", F.lit(None).cast("double"))
    missing = F.col("n_rows") - F.col("_ratings")
    rating = F.when(
        F.col("_fill").isNull(), F.try_divide(F.col("_rating_sum"), F.col("_ratings"))
    ).otherwise((F.coalesce("_rating_sum", F.lit(0.0)) + F.col("_fill") * missing) / F.col("n_rows"))
    return daily.withColumn("rating", rating).drop("_rating_sum", "_ratings", "_fill")


def daily_dense(sales: DataFrame, keys=KEYS, impute: str | None = "mean") -> DataFrame:
    """Amount sum, item count, mean rating for every calendar day; empty days are 0."""
    daily = daily_totals(sales, keys, impute).select(
        *keys, "day", F.col("amount_sum").alias("amount"), "items", F.coalesce("rating", F.lit(0.0)).alias("rating")
    )
    return fill_gaps(daily, ["amount", "items", "rating"], keys)


def daily_sparse(sales: DataFrame, keys=KEYS, impute: str | None = "mean", order: str = "day") -> DataFrame:
    """Mean amount, item count, mean rating, credit share for every day (or other ``order`` value) present."""
    return daily_totals(sales, keys, impute, order).select(
        *keys,
        order,
        (F.col("amount_sum") / F.col("n_rows")).alias("amount"),
        "items",
        "rating",
        "credit_card_ratio",
    )


def mean_by(df: DataFrame, by: list, value: str = "amount") -> DataFrame:
    """Mean of a measure per group (nulls ignored, all-null groups give null)."""
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def monthly_dense(sales: DataFrame, keys=KEYS) -> DataFrame:
    """Mean per calendar month, labelled by month end; empty months are null."""
    monthly = mean_by(sales, [*keys, F.last_day("day").alias("month_end")])
    following = F.lead("month_end").over(Window.partitionBy(*keys).orderBy("month_end"))
    gap = F.coalesce(F.months_between(following, F.col("month_end")).cast("int") - 1, F.lit(0))
    spread = monthly.withColumn("_gap", gap).select("*", F.explode(F.sequence(F.lit(0), F.col("_gap"))).alias("_k"))
    return spread.select(
        *keys,
        F.last_day(F.add_months("month_end", F.col("_k"))).alias("month_end"),
        F.when(F.col("_k") == 0, F.col("amount")).alias("amount"),
    )


def monthly_present(sales: DataFrame, keys=KEYS) -> DataFrame:
    return mean_by(sales, [*keys, F.date_format("day", "yyyy-MM").alias("month")])


def reindex(df: DataFrame, label: str, value: str, domain: list[str], keys=KEYS) -> DataFrame:
    """Every label of the fixed domain per series, in order; absent labels are null.

    The aggregate per series is at most the size of the domain, so it rides in
    a map and the domain is exploded against it.
    """
    cells = F.map_from_entries(F.collect_list(F.struct(label, value)))
    inside = df.where(F.col(label).isin(*domain)).groupBy(*keys).agg(cells.alias("_cells"))
    labels = F.array(*[F.lit(d) for d in domain])
    return inside.select(*keys, "_cells", F.posexplode(labels).alias("position", label)).select(
        *keys, "position", label, F.element_at("_cells", F.col(label)).alias(value)
    )


def weekday_profile(sales: DataFrame, keys=KEYS) -> DataFrame:
    means = mean_by(sales, [*keys, day_name("day").alias("weekday")])
    return reindex(means, "weekday", "amount", WEEKDAYS, keys)


def month_profile(sales: DataFrame, keys=KEYS) -> DataFrame:
    means = mean_by(sales, [*keys, month_name("day").alias("month")])
    return reindex(means, "month", "amount", MONTHS, keys)


def weekday_month_pivot(sales: DataFrame) -> DataFrame:
    """Mean by weekday (rows, Monday first) and month (columns, January first)."""
    named = sales.select(day_name("day").alias("weekday"), month_name("day").alias("month"), "amount")
    table = named.groupBy("weekday").pivot("month", MONTHS).agg(F.avg("amount"))
    order = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday")).cast("int") - 1
    spine = sales.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in WEEKDAYS])).alias("weekday"))
    return spine.join(table, "weekday", "left").select(order.alias("position"), "weekday", *MONTHS)


def series_span(df: DataFrame, keys=KEYS, order: str = "day") -> DataFrame:
    """First and last day and the days between them."""
    return df.groupBy(*keys).agg(
        F.min(order).alias("first_day"),
        F.max(order).alias("last_day"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("span_days", F.datediff("last_day", "first_day"))


def last_known(df: DataFrame, columns: list[str], keys=KEYS, order: str = "day") -> DataFrame:
    """The latest row of every series."""
    return df.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in columns]
    )
