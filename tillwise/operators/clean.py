"""Row cleaning: null handling, flags, date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.scalars import flag
from tillwise.operators.keyed import attach_by_key, exact_quantiles


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """After filling, only an all-null column is still null: its series drops out."""
    return df.na.drop("any", subset=columns)


def impute(
    df: DataFrame,
    column: str,
    how: str,
    keys: list[str],
    spread_on: list[str],
    out: str | None = None,
) -> DataFrame:
    """Replace nulls by the key's mean or median of the rows given."""
    sizes = df.groupBy(*keys).agg(F.avg(column).alias("_fill"), F.count(F.lit(1)).alias("_rows"))
    if how == "median":
        medians = exact_quantiles(df, keys, column, {"_fill": 0.5}).select(*keys, "_fill")
        sizes = sizes.drop("_fill").join(medians, keys, "left")
    elif how != "mean":
        raise ValueError(f"impute: unknown method {how!r}")
    filled = attach_by_key(df, sizes, keys, ["_fill"], "_rows", spread_on)
    return filled.withColumn(out or column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, subset=columns)


def add_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Expected columns that are absent become the constant 0."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def keep_original(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_original", F.col(column))


def equals_flag(column: str, value) -> Column:
    return flag(F.col(column) == value)


def member_flag(column: str, values: list) -> Column:
    return flag(F.col(column).isin(*values))


def up_to(df: DataFrame, end, order: str = "day") -> DataFrame:
    return df.where(F.col(order) <= end)


def between_open(df: DataFrame, after, end, order: str = "day") -> DataFrame:
    return df.where((F.col(order) > after) & (F.col(order) <= end))


def later_than(df: DataFrame, after, order: str = "day") -> DataFrame:
    return df.where(F.col(order) > after)
