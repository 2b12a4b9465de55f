"""Hot-key look-ups, exact quantiles, global codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.operators import keyed


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; a thousand others share the rest."""
    return spark.range(30_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"),
        (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7).alias("v"),
    )


def test_attach_by_key(skewed):
    params = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    params = params.where(F.col("key") != "k1")  # a key without parameters stays, with nulls
    out = keyed.attach_by_key(skewed, params, ["key"], ["top"], "n", ["id"])
    want = skewed.join(params.select("key", "top"), "key", "left").select("id", "key", "v", "top")
    assert out.count() == 30_000
    assert out.exceptAll(want).count() == 0
    assert out.where(F.col("top").isNull()).select("key").distinct().count() == 1


@pytest.mark.parametrize("buckets", [2, 16, 128])
def test_exact_quantiles(skewed, buckets):
    probs = {"lo": 0.0, "q25": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["key"]: r for r in keyed.exact_quantiles(skewed, ["key"], "v", probs, buckets).collect()}
    pdf = skewed.toPandas()
    for key, part in pdf.groupby("key"):
        want = np.quantile(part.v, list(probs.values()))
        assert np.allclose([got[key][p] for p in probs], want, rtol=1e-12), key
        assert got[key]["n_values"] == len(part)


def test_quantiles_of_few_and_null_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in keyed.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": 3.0}


def test_dense_codes(spark):
    entries = spark.range(2_000).select(F.col("id").cast("string").alias("key"), F.hash("id").alias("h"))
    out = keyed.dense_codes(entries, "key", F.struct("h", "key"), "code").collect()
    want = {r["key"]: i for i, r in enumerate(sorted(out, key=lambda r: (r["h"], r["key"])))}
    assert {r["key"]: r["code"] for r in out} == want


def test_range_of(spark):
    cuts = [1.0, 3.0, 3.0, 8.0, 9.0]
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 8.5, 9.0, 10.0]
    df = spark.createDataFrame([(v, cuts) for v in values], "v double, cuts array<double>")
    got = [r[0] for r in df.select(keyed.range_of(F.col("v"), F.col("cuts"), 5)).collect()]
    assert got == [sum(c < v for c in cuts) for v in values]


@pytest.mark.parametrize("most_rows", [50, 700])
def test_exact_quantiles_cut_large_buckets_again(spark, skewed, most_rows, monkeypatch):
    """However coarse the first cuts, no group that is ranked value by value exceeds the bound, and nothing changes."""
    seen = []
    whole = keyed._refined

    def watched(*args):
        out = whole(*args)
        seen.append(out.groupBy("key", "_start").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(keyed, "_refined", watched)
    probs = {"lo": 0.0, "q25": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["key"]: r for r in keyed.exact_quantiles(skewed, ["key"], "v", probs, 4, most_rows).collect()}
    assert len(seen) == 1 and seen[0] <= most_rows
    for key, part in skewed.toPandas().groupby("key"):
        assert np.allclose([got[key][p] for p in probs], np.quantile(part.v, list(probs.values())), rtol=1e-12), key


def test_dense_codes_of_a_million_keys(spark):
    """Ranges follow the count, so no task sorts more than the bound; codes are the places in the whole order."""
    bound, n = 50_000, 1_000_000
    entries = spark.range(n).select((F.col("id") * 7919 % n).alias("key")).withColumn("h", F.when(F.col("key") < 300_000, F.lit(0)).otherwise(F.hash("key")))
    out = keyed.dense_codes(entries, "key", F.struct("h", "key"), "code", most_rows=bound)
    ordered = out.orderBy("code").select("h", "key", "code").toPandas()
    assert (ordered.code == np.arange(n)).all()
    assert ordered[["h", "key"]].equals(ordered[["h", "key"]].sort_values(["h", "key"]).reset_index(drop=True))
    ranges = entries.repartitionByRange(-(-2 * n // bound), F.struct("h", "key")).groupBy(F.spark_partition_id()).count()
    assert ranges.agg(F.max("count")).first()[0] <= bound


def test_dense_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "key string")
    assert keyed.dense_codes(empty, "key", F.col("key"), "code").count() == 0
