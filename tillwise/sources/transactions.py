"""Transaction sources.

All of them yield the same columns:
``sale_id BIGINT, series_id STRING, amount DOUBLE, item STRING, rating DOUBLE,
day DATE, payment STRING`` (CSV and event sources also carry ``ts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header names of the retail transactions file.
AMOUNT_HEADER = "Purchase Amount (USD)"
ITEM_HEADER = "Item Purchased"
RATING_HEADER = "Review Rating"
DATE_HEADER = "Date Purchase"
PAYMENT_HEADER = "Payment Method"

CSV_SCHEMA = T.StructType(
    [
        T.StructField(ITEM_HEADER, T.StringType()),
        T.StructField(AMOUNT_HEADER, T.DoubleType()),
        T.StructField(RATING_HEADER, T.DoubleType()),
        T.StructField(DATE_HEADER, T.StringType()),
        T.StructField(PAYMENT_HEADER, T.StringType()),
    ]
)


def parse_day(text, fmt: str, lenient: bool = False):
    """Date text to TIMESTAMP_NTZ: strict raises on a bad value, lenient gives null."""
    text = F.col(text) if isinstance(text, str) else text
    if lenient:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(fmt))


def read_transactions_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CSV_SCHEMA,
    date_format: str = "dd-MM-yyyy",
    series_column: str | None = None,
    id_column: str | None = None,
    lenient_dates: bool = False,
) -> DataFrame:
    """Header CSV with an explicit schema; a header that differs from it raises.

    With no ``series_column`` the whole file is one series, named ``all``. With
    no ``id_column`` the id used to break ties is a hash of the row, so equal
    ids mean equal rows.
    """
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    ts = parse_day(F.col(f"`{DATE_HEADER}`"), date_format, lenient_dates)
    return raw.select(
        (
            F.col(f"`{id_column}`").cast("bigint")
            if id_column
            else F.xxhash64(*[F.col(f"`{c}`") for c in schema.fieldNames()])
        ).alias("sale_id"),
        (F.col(f"`{series_column}`") if series_column else F.lit("all")).alias("series_id"),
        F.col(f"`{AMOUNT_HEADER}`").alias("amount"),
        F.col(f"`{ITEM_HEADER}`").alias("item"),
        F.col(f"`{RATING_HEADER}`").alias("rating"),
        ts.alias("ts"),
        ts.cast("date").alias("day"),
        F.col(f"`{PAYMENT_HEADER}`").alias("payment"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment as the series.

    The base tables hold no nulls, so nulls are planted by key arithmetic to
    exercise the cleaning operators. The join side is left to AQE, which
    broadcasts customers only under the size limit and splits a hot customer.
    """
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("sale_id"),
        F.col("c_mktsegment").alias("series_id"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderpriority").alias("item"),
        F.when(key % 7 == 0, F.lit(None)).otherwise((key % 41 + 10).cast("double") / 10).alias("rating"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(key % 13 == 0, F.lit(None))
        .when(F.col("o_orderstatus") == "F", F.lit("Credit Card"))
        .otherwise(F.lit("Cash"))
        .alias("payment"),
    )


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream table read as sales: one series per event type, times of day kept."""
    events = read_table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("sale_id"),
        F.col("event_type").alias("series_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("item"),
        F.lit(None).cast("double").alias("rating"),
        F.col("ts"),
        F.col("ts").cast("date").alias("day"),
        F.lit(None).cast("string").alias("payment"),
    )


def line_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part brand: more and longer series, for fit throughput."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sale_id"),
        F.col("p_brand").alias("series_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("item"),
        F.lit(None).cast("double").alias("rating"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.lit(None).cast("string").alias("payment"),
    )
