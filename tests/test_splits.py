"""Splits with repeated ids, three-way splits, and roll-ups by exact timestamps."""

import datetime
import hashlib
import math
from collections import Counter

import pytest
from frames import daily
from pyspark.sql import functions as F

from tillwise.forecasting import sequence
from tillwise.functions import rolling
from tillwise.operators import rollup, split


def plain_test_ids(ids, share=0.2):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
    return Counter(order[: math.ceil(share * len(ids))])


@pytest.mark.parametrize(
    "ids", [[1, 1, 1, 2, 2, 3, 4, 4, 4, 4], [5] * 10, list(range(10)), [7] * 99 + [8], [1], [i % 3 for i in range(1000)]], ids=len
)
@pytest.mark.parametrize("alike", [True, False])
def test_repeated_ids_keep_the_exact_size(spark, ids, alike):
    rows = [(i, 0 if alike else n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, other long").repartition(4)
    out = split.hash_split(df, "id")
    assert Counter(r["id"] for r in out.where("split = 'test'").collect()) == plain_test_ids(ids)
    assert Counter((r["id"], r["other"]) for r in out.collect()) == Counter(rows)


def test_ties_are_resolved_alike_in_every_run(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)], "id long, other long")
    runs = [{r["other"] for r in split.hash_split(df.repartition(k), "id").where("split = 'test'").collect()} for k in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 20


def test_split_of_nothing_and_of_null_ids(spark):
    assert split.hash_split(spark.createDataFrame([], "id long"), "id").count() == 0
    out = split.hash_split(spark.createDataFrame([(None,)] * 5 + [(1,)] * 5, "id long"), "id")
    assert out.where("split = 'test'").count() == 2


def test_three_way_split(spark):
    df = daily(spark, {"a": range(100), "b": range(9), "c": range(1)})
    sizes = {(r["series_id"], r["split"]): r["count"] for r in split.three_way_split(df).groupBy("series_id", "split").count().collect()}
    assert sizes == {("a", "train"): 70, ("a", "valid"): 10, ("a", "test"): 20, ("b", "train"): 6, ("b", "valid"): 1, ("b", "test"): 2, ("c", "test"): 1}


def test_boosted_fit_never_sees_test_rows(spark):
    """Other targets on the test rows leave the model as it is; other targets on the valid rows may stop it elsewhere."""
    rows = [([[float(i % 7), float(i)]], math.sin(i), "train" if i < 70 else "valid" if i < 80 else "test") for i in range(100)]
    df = spark.createDataFrame(rows, "x array<array<double>>, y double, split string")
    spoiled = df.withColumn("y", F.when(F.col("split") == "test", F.lit(1e9)).otherwise(F.col("y")))
    assert sequence.fit_boosted(df).toDebugString.split("\n")[1:] == sequence.fit_boosted(spoiled).toDebugString.split("\n")[1:]


def test_roll_up_by_timestamp(spark):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [(1, "a", 2.0, "x", None, at(9, 0)), (2, "a", 4.0, "x", None, at(9, 0)), (3, "a", 9.0, "y", 3.0, at(9, 1)), (4, "a", None, "y", 3.0, at(9, 2))]
    sales = spark.createDataFrame(rows, "sale_id long, series_id string, amount double, item string, rating double, ts timestamp_ntz")
    sales = sales.withColumns({"day": F.col("ts").cast("date"), "payment": F.lit(None).cast("string")})
    out = rollup.daily_sparse(sales, impute=None, order="ts").withColumn("before", rolling.row_lag("amount", 1, rolling.ordered(order="ts")))
    got = [(r["ts"], r["amount"], r["items"], r["rating"], r["before"]) for r in out.orderBy("ts").collect()]
    assert got == [(at(9, 0), 3.0, 2, None, None), (at(9, 1), 9.0, 1, 3.0, 3.0)]
