"""Helpers several operators use: staged tables, prefix sums over buckets, connected components."""

from __future__ import annotations

import gc
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import shared_folder

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(df: DataFrame) -> str:
    """A fresh folder under the cluster's shared scratch folder."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/tillwise-{uuid.uuid4().hex}"


STAGED: list[str] = []  # the folders of this session's staged tables, in order


def stage_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, runs the work above once for several readers, and lets a
    lost executor's share be read again by any other.
    """
    path = new_folder(df)
    df.write.option("compression", compression).parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_NAMES: dict[str, str] = {}  # the catalog names of staged tables that have one


def stage_buckets(df: DataFrame, key: str, compression: str = "snappy") -> DataFrame:
    """As ``stage_table``, dealt by ``key``: joins on it find these rows in place and shuffle the other side only.

    ``key`` must not have hot values. As many buckets as the session has shuffle partitions, one file each.
    """
    spark = df.sparkSession
    path = new_folder(df)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    dealt.option("compression", compression).option("path", path).saveAsTable(name)
    STAGED.append(path)
    _NAMES[path] = name
    return spark.table(name)


def read_by(df: DataFrame) -> set[str]:
    """The staged tables that a frame reads."""
    files = df.inputFiles()
    return {folder for folder in STAGED if any(folder.split("/")[-1] in file for file in files)}


def discard(spark, folders: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for folder in folders:
        if folder in _NAMES:
            spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(folder)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in STAGED:
            STAGED.remove(folder)


def sweep(spark) -> None:
    """Let the driver's collectors run, so that Spark deletes the shuffle files of plans nobody holds any more.

    Spark notices only then; on a large heap that may be long after the disk has filled. The driver's
    event queue holds on to the last query until another one comes, hence the small one.
    """
    gc.collect()
    spark.range(1).collect()
    spark._jvm.System.gc()


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, whatever task runs in it."""
    name = "_tillwise_worker_state"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.state = {}
        sys.modules[name] = module
    return sys.modules[name].state


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same keys, ordered by bucket and then by ``order``.

    A key may hold most rows: only one bucket of a key meets in a task, and the
    buckets' totals (one row each) are summed by a second, small window.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(starts, [*keys, bucket])
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is its smallest reachable node.

    Alternating large-star and small-star rounds. Minima are combined before the
    shuffle and a hub's rows meet only in joins, which can be split, so one
    component may hold a third of all nodes. Every round is a staged table.
    """
    pairs = edges.where(F.col(a) != F.col(b))
    stars = stage_table(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _all_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        )
        small = large.join(low, "u").select(F.inline(links)).where(F.col("u") != F.col("v"))
        stars = stage_table(small.distinct())
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _all_stars(links: DataFrame) -> bool:
    """Every node is either a root or has one link, to a root."""
    roles = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    seen = roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return seen.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("root") == 1))).isEmpty()
