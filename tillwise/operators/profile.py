"""Table profiles: what head / info / describe / value counts / histograms report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.operators.keyed import exact_quantiles


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First n rows in an explicit order (per-partition top n, merged)."""
    return df.orderBy(*order).limit(n)


def column_info(df: DataFrame) -> DataFrame:
    """Column, type, non-null count and row count, in one pass."""
    types = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(types[c]).alias("data_type"),
                    F.count(c).alias("non_null"),
                )
                for c in df.columns
            ]
        ).alias("_cols"),
    )
    return counts.select("n_rows", F.inline("_cols"))


def describe_all(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row per column: count, unique, top, freq, mean, std, min, quartiles, max.

    Numeric statistics are null for text columns and the other way round. Ties
    for ``top`` go to the smallest value.
    """
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in numeric
            ]
        ).alias("_cols")
    ).select(F.inline("_cols"))
    long = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numeric])
        )
    )
    quartiles = exact_quantiles(long, ["column_name"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    numbers = moments.join(quartiles, "column_name", "left")

    words = (
        df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in text]))
        )
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_name")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("_top"),
        )
        .select(
            "column_name",
            "count",
            "unique",
            F.col("_top.value").alias("top"),
            (-F.col("_top.neg")).alias("freq"),
        )
    )
    return numbers.unionByName(words, allowMissingColumns=True).select(
        "column_name", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def value_counts(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the non-null values with their percentage share and rank."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    )
    if keys:
        total = F.sum("n").over(Window.partitionBy(*keys))
    else:
        total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 1))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max, empty bins included.

    The last bin is closed on the right. A single-valued column gets a range
    of one around its value.
    """
    bounds = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    single = F.col("lo") == F.col("hi")
    box = bounds.select(
        F.struct(
            F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    ).scalar()
    lo, hi = box["lo"], box["hi"]
    spot = F.floor(F.lit(bins) * (F.col(column) - lo) / (hi - lo))
    counts = (
        df.where(F.col(column).isNotNull())
        .select(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return spine.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def paired_points(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The (x, y) points with a value for both."""
    return df.na.drop(subset=[x, y]).select(*keys, x, y)


def pair_correlation(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return paired_points(df, x, y, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr")
    )


def shared_range(tables: list[tuple[DataFrame, str]], headroom: float = 1.1) -> DataFrame:
    """Least minimum and greatest maximum over several tables' columns."""
    ends = None
    for df, column in tables:
        one = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        ends = one if ends is None else ends.unionByName(one)
    return ends.agg(F.min("lo").alias("y_min"), F.max("hi").alias("y_max")).withColumn(
        "y_limit", F.col("y_max") * headroom
    )


