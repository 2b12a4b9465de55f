"""Train / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS, ordered
from tillwise.session import materialise

TRAIN_SHARE = 0.8


def time_split(df: DataFrame, share: float = TRAIN_SHARE, keys=KEYS, order: str = "day") -> DataFrame:
    """First floor(share * n) rows of every series are train, the rest test."""
    position = F.row_number().over(ordered(keys, order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(
        "split", F.when(position <= F.floor(size * F.lit(share)), F.lit("train")).otherwise(F.lit("test"))
    )


def calendar_split(
    df: DataFrame, train: float = 0.7, valid: float = 0.2, keys=KEYS, order: str = "day"
) -> DataFrame:
    """Train / valid / test by shares of the calendar span."""
    per_series = Window.partitionBy(*keys)
    first, last = F.min(order).over(per_series), F.max(order).over(per_series)
    span = F.datediff(last, first)
    train_end = F.date_add(first, F.floor(span * F.lit(train)).cast("int"))
    valid_end = F.date_add(train_end, F.floor(span * F.lit(valid)).cast("int"))
    out = df.withColumns({"train_end": train_end, "valid_end": valid_end})
    return out.withColumn(
        "split",
        F.when(F.col(order) <= F.col("train_end"), F.lit("train"))
        .when(F.col(order) <= F.col("valid_end"), F.lit("valid"))
        .otherwise(F.lit("test")),
    )


def three_way_split(df: DataFrame, train: float = 0.7, until: float = 0.8, keys=KEYS, order: str = "day") -> DataFrame:
    """First floor(train * n) rows of every series are train, those up to floor(until * n) valid, the rest test."""
    position = F.row_number().over(ordered(keys, order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    part = F.when(position <= F.floor(size * F.lit(train)), F.lit("train")).when(position <= F.floor(size * F.lit(until)), F.lit("valid"))
    return df.withColumn("split", part.otherwise(F.lit("test")))


PREFIXES = 1 << 16


def _cut(keys: DataFrame, share: float | None = None, want: int | None = None):
    """(key, take, equal): the key up to which the first rows are ``want`` or ceil(share * n).

    ``keys`` has a row per row of the table: a key ``k`` and the prefix ``p`` it sorts by first. Counts per prefix name
    the one that holds the cut, and only its different keys are ranked, each once with its count. ``take``
    of the ``equal`` rows with that key lie before the cut.
    """
    sizes = keys.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    # At most PREFIXES rows: windows without a key are safe here.
    wanted = F.lit(want).cast("long") if want is not None else F.ceil(F.lit(share) * total)
    ends = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"), "n", wanted.alias("want"))
    edge = ends.where((F.col("want") > F.col("before")) & (F.col("want") <= F.col("before") + F.col("n")))
    inside = keys.join(F.broadcast(edge.select("p", (F.col("want") - F.col("before")).alias("need"))), "p")  # one row
    counted = inside.groupBy("p", "k", "need").agg(F.count(F.lit(1)).alias("m"))
    ranked = counted.withColumn("start", F.sum("m").over(Window.partitionBy("p").orderBy("k")) - F.col("m"))
    hit = ranked.where((F.col("need") > F.col("start")) & (F.col("need") <= F.col("start") + F.col("m")))
    return hit.select("k", (F.col("need") - F.col("start")).alias("take"), F.col("m").alias("equal")).first()


def hash_split(df: DataFrame, id_column: str, seed: int = 42, test_share: float = 0.2) -> DataFrame:
    """Random split of the whole table with exactly ceil(test_share * n) test rows.

    Rows are ordered by (md5 of id and seed, id), the first ones being test. Only the cut-off is
    searched; the large table itself is filtered, not sorted or shuffled. Where the cut falls inside
    the rows of a repeated id, those are ordered by a hash of all their columns, and rows alike in that
    too are numbered once in a table of their own; which of two equal rows goes where makes no difference.
    """
    digest = F.md5(F.concat_ws("-", F.col(id_column).cast("string"), F.lit(str(seed))))
    key = F.struct(digest.alias("h"), F.col(id_column).alias("id"))
    found = _cut(df.select(F.substring(digest, 1, 4).alias("p"), key.alias("k")), share=test_share)
    if found is None:
        return df.withColumn("split", F.lit("train"))
    named = lambda test: F.when(test, F.lit("test")).otherwise(F.lit("train"))
    cut = F.lit(found["k"]["h"]), F.lit(found["k"]["id"])
    before = (digest < cut[0]) | ((digest == cut[0]) & (F.col(id_column) < cut[1]))
    tied = (digest == cut[0]) & F.col(id_column).eqNullSafe(cut[1])
    if found["take"] == found["equal"]:
        return df.withColumn("split", named(F.coalesce(before, F.lit(False)) | tied))
    outside = df.where(~tied).withColumn("split", named(F.coalesce(before, F.lit(False))))
    order = F.xxhash64(*[F.col(c) for c in df.columns])
    ties = df.where(tied)
    second = _cut(ties.select(F.shiftright(order, 48).alias("p"), order.alias("k")), want=found["take"])
    inside = ties.where(order != second["k"]).withColumn("split", named(order < second["k"]))
    alike = materialise(ties.where(order == second["k"]).withColumn("_at", F.monotonically_increasing_id()))
    place = F.xxhash64("_at")
    third = _cut(alike.select(F.shiftright(place, 48).alias("p"), place.alias("k")), want=second["take"])
    last = alike.withColumn("split", named(place <= third["k"])).drop("_at")
    return outside.unionByName(inside).unionByName(last)
