"""Keyed look-ups, exact quantiles and global order that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import materialise

# At most this many keys can each hold 1/HOT_SHARE of the rows, which bounds
# the table of hot keys that is broadcast.
HOT_SHARE = 512
SALTS = 64
# Different values, or entries, of one group that a task may sort.
MOST_ROWS = 1_000_000


def attach_by_key(
    rows: DataFrame,
    params: DataFrame,
    keys: list[str],
    values: list[str],
    weight: str,
    spread_on: list[str],
) -> DataFrame:
    """Left join one-row-per-key ``params`` to ``rows`` without piling up a hot key.

    ``weight`` is the row count behind each key. Keys above 1/HOT_SHARE of the
    total are joined by broadcast (at most HOT_SHARE rows, whatever the data
    size) and their rows are spread over SALTS by a hash of ``spread_on``; all
    other keys take the ordinary join, which AQE may turn into a broadcast when
    the parameter table is small.
    """
    total = params.agg(F.sum(weight)).scalar()
    hot = params.where(F.col(weight) * HOT_SHARE >= total).select(
        *keys, F.struct(*values).alias("_hot")
    )
    cold = params.where(F.col(weight) * HOT_SHARE < total).select(
        *keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold")
    )
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread_on), F.lit(SALTS)).cast("int") + 1
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt)
        .join(cold, [*keys, "_salt"], "left")
        .select(*rows.columns, *[found[v].alias(v) for v in values])
    )


def range_of(value: Column, cuts: Column, most: int) -> Column:
    """How many of the sorted cut points (at most ``most``) lie below the value.

    A binary search written as a fold over halving step sizes: log2(most)
    comparisons per row. Reading past the end gives null, which stops a step.
    """
    halving = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in halving]),
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at),
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 128, most_rows: int = MOST_ROWS
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of ``probs``.

    Values are first counted, so repeats cost nothing. A sketch over all keys proposes cut points, running
    counts of the buckets between them tell which few hold a wanted rank, and only those are ranked
    value by value. Where such a bucket of a key has more than ``most_rows`` different values it is cut
    again by a sketch of its own, until none has, so no task ranks more; the result does not
    depend on how good any cut is.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    sketch = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10 * buckets)
    size, cuts = counted.agg(F.count(F.lit(1)), sketch).first()
    if size > most_rows:
        counted = materialise(counted)  # read again by every level
    live = counted.withColumns({"_start": F.lit(0).cast("long"), "_n": F.lit(0).cast("long"), "_cuts": F.lit(cuts).cast("array<double>")})
    live = _wanted_buckets(live, keys, probs, buckets, F.sum("_size").over(Window.partitionBy(*keys)))
    if size > most_rows:
        live = _refined(live, keys, probs, buckets, most_rows)

    inner = F.sum("_c").over(Window.partitionBy(*keys, "_start").orderBy("_v"))
    ranked = live.withColumn("_from", F.col("_start") + inner - F.col("_c"))
    picks = []
    for p, (low, high) in _ranks(probs).items():
        for side, rank in (("lo", low), ("hi", high)):
            hit = _holds(rank, F.col("_from"), F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{p}"))
    out = ranked.groupBy(*keys, "_n").agg(*picks)
    between = {p: F.lit(q) * (F.col("_n") - 1) - _ranks(probs)[p][0] for p, q in probs.items()}
    return out.select(
        *keys,
        F.col("_n").alias("n_values"),
        *[(F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * between[p]).alias(p) for p in probs],
    )


def _ranks(probs: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """The two ranks (from 0) of ``_n`` values that each quantile lies between."""
    last = F.col("_n") - 1
    return {p: (F.floor(F.lit(q) * last), F.ceil(F.lit(q) * last)) for p, q in probs.items()}


def _holds(rank: Column, start: Column, size: Column) -> Column:
    return (rank >= start) & (rank < start + size)


def _wanted_buckets(live: DataFrame, keys: list[str], probs: dict[str, float], buckets: int, n: Column) -> DataFrame:
    """(*keys, _v, _c, _start, _n): the counted values in buckets that hold a wanted rank.

    ``live`` holds groups of values, told apart by the rank ``_start`` of their first one, with the
    cut points of each; ``_start`` becomes that of the bucket.
    """
    placed = live.withColumn("_b", range_of(F.col("_v"), F.col("_cuts"), buckets)).drop("_cuts")
    totals = placed.groupBy(*keys, "_start", "_b").agg(F.sum("_c").alias("_size"), F.max("_n").alias("_n"))
    before = F.sum("_size").over(Window.partitionBy(*keys, "_start").orderBy("_b")) - F.col("_size")
    totals = totals.withColumns({"_first": F.col("_start") + before, "_n": n})
    wanted = F.lit(False)
    for low, high in _ranks(probs).values():
        wanted = wanted | _holds(low, F.col("_first"), F.col("_size")) | _holds(high, F.col("_first"), F.col("_size"))
    kept = totals.where(wanted).select(*keys, "_start", "_b", "_first", "_n")
    hit = placed.drop("_n").join(kept, [*keys, "_start", "_b"])
    return hit.select(*keys, "_v", "_c", F.col("_first").alias("_start"), "_n")


def _refined(live: DataFrame, keys: list[str], probs: dict[str, float], buckets: int, most_rows: int) -> DataFrame:
    """Cut every group of more than ``most_rows`` values again, by its own sketch, until there is none."""
    sketch = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_cuts")
    while True:
        live = materialise(live)
        groups = live.groupBy(*keys, "_start").agg(F.count(F.lit(1)).alias("_rows"), sketch)
        large = materialise(groups.where(F.col("_rows") > most_rows))
        if large.isEmpty():
            return live
        by = [*keys, "_start"]
        open_ = attach_by_key(live, large, by, ["_cuts"], "_rows", ["_v"]).where(F.col("_cuts").isNotNull())
        done = live.join(large.select(*by), by, "left_anti")
        live = done.unionByName(_wanted_buckets(open_, keys, probs, buckets, F.col("_n")))


def dense_codes(entries: DataFrame, key: str, order: Column, code: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """0-based position of every entry in the global ``order`` (which must be unique).

    Entries are dealt to as many ranges of the order as keep one below about ``most_rows``, sorted and
    numbered inside each, and shifted by the sizes of the ranges before, a table of one row per range.
    """
    listed = materialise(entries.withColumn("_order", order))
    ranges = max(1, -(-2 * listed.count() // most_rows))
    placed = listed.repartitionByRange(ranges, "_order").sortWithinPartitions("_order")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()))  # range number, then place in it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    shifted = F.broadcast(sizes.select("_part", before.alias("_before")))
    out = placed.withColumn("_part", part).join(shifted, "_part")
    return out.withColumn(code, place + F.col("_before")).drop("_part", "_before", "_at", "_order")
