"""Properties over generated series (each example is one small Spark job)."""

import numpy as np
from frames import column, daily, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.functions import rolling as r
from tillwise.operators import decompose, features, rollup, scale, split
from tillwise.sources.transactions import sales

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
amounts = st.floats(0, 1e6, allow_nan=False).map(lambda v: round(v, 2))
tables = st.dictionaries(st.sampled_from("abcd"), st.lists(amounts, min_size=1, max_size=90), min_size=1)


@FEW
@given(tables)
def test_scaling_inverts(spark, data):
    df = daily(spark, data).withColumn("amount_log", F.log1p("amount"))
    out = scale.with_scaler(df, ["amount"], scale.MINMAX, name="m").withColumn("a", scale.scaled("amount", "m"))
    out = scale.with_scaler(out, ["amount_log"], scale.STANDARD, name="s").withColumn("b", scale.scaled("amount_log", "s"))
    out = out.select(
        "amount", "a", scale.unscaled("a", "amount", "m").alias("back"), scale.amount_back("b", "amount_log", "s").alias("back2")
    )
    for row in out.collect():
        assert -1e-9 <= row["a"] <= 1 + 1e-9
        assert np.isclose(row["back"], row["amount"], rtol=1e-9, atol=1e-6)
        assert np.isclose(row["back2"], row["amount"], rtol=1e-7, atol=1e-6)


@FEW
@given(tables)
def test_split_parts_add_up(spark, data):
    df = daily(spark, data)
    sizes = split.time_split(df).groupBy("series_id").pivot("split", ["train", "test"]).count().na.fill(0).collect()
    assert {r_["series_id"]: (r_["train"], r_["train"] + r_["test"]) for r_ in sizes} == {
        k: (int(len(v) * 0.8), len(v)) for k, v in data.items()
    }
    parts = {r_["split"] for r_ in split.calendar_split(df).collect()}
    assert parts <= {"train", "valid", "test"}


@FEW
@given(tables)
def test_autocorrelation_bounds_and_decomposition_sum(spark, data):
    df = daily(spark, data)
    for row in decompose.autocorrelation(df).collect():
        if row["acf"] is not None:
            assert abs(row["acf"]) <= 1 + 1e-9
            assert row["lag"] > 0 or row["acf"] == 1
    for row in decompose.seasonal_decompose(df).where(F.col("trend").isNotNull()).collect():
        assert np.isclose(row["trend"] + row["seasonal"] + row["resid"], row["observed"], rtol=1e-9, atol=1e-6)


@FEW
@given(st.lists(st.one_of(st.none(), amounts), min_size=1, max_size=40))
def test_filling_both_ways_leaves_nulls_only_if_all_are(spark, values):
    df = daily(spark, {"a": values})
    filled = df.select("series_id", "day", F.coalesce(r.backward_fill("amount"), r.forward_fill("amount", r.ordered())).alias("f"))
    nulls = [v is None for v in column(filled, "series_id", "f")["a"]]
    assert all(nulls) if all(v is None for v in values) else not any(nulls)


def test_independent_of_partitions_and_row_order(spark):
    base = sales(spark, "/root/testdata/sf0.001")

    def run(df, partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return features.sparse_features(rollup.daily_sparse(df, impute="median")).toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    one = run(base, 1).sort_values(["series_id", "day"]).reset_index(drop=True)
    two = run(base.orderBy(F.xxhash64("sale_id")).repartition(5), 7).sort_values(["series_id", "day"]).reset_index(drop=True)
    assert (one.series_id == two.series_id).all() and (one.day == two.day).all()
    for c in one.columns[2:]:
        assert same(one[c], two[c], 1e-9), c
