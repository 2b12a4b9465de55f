"""Category codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.keyed import attach_by_key, dense_codes

# Payment codes.
PAYMENT_CODES = {"Cash": 0, "Credit Card": 1}


def code_from_dict(column: str, codes: dict) -> Column:
    """Static look-up as a map literal; a value not in it gives null."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.element_at(pairs, F.col(column))


def first_seen_codes(df: DataFrame, column: str, order: str, tie: str) -> DataFrame:
    """Dictionary (value, code): dense codes by first appearance in (order, tie)."""
    firsts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct(order, tie)).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    return dense_codes(firsts, column, F.struct(F.col("_first"), F.col(column)), "code").select(
        column, F.col("code").cast("int").alias("code"), "_rows"
    )


def code_by_first_seen(df: DataFrame, column: str, order: str, tie: str, out: str) -> DataFrame:
    codes = first_seen_codes(df, column, order, tie).withColumnRenamed("code", out)
    return attach_by_key(df, codes, [column], [out], "_rows", [tie])
