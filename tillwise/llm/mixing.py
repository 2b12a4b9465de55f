"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's words, in shuffled document order, form one stream that is cut
into blocks of equal length. A slot of the schedule takes the next golden-ratio
point, finds the source whose stretch of the cumulative weights holds it, and
plays that source's next block; a source's stream starts again when it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.shared import WORD, running_sum, stage_table, text_or_empty

CYCLE = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 256
LEAST_BLOCKS = 256
# Fixed value: 2^32 divided by the golden ratio, rounded to an odd number.
GOLDEN = 2654435769
UNIT = 1 << 32
SLOTS_PER_CHUNK = 8192


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words); a null text has no words."""
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, cycle=CYCLE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: position (by code point, null last), weight, size and target in words.

    The targets share all words by weight and stop at ``most`` times the source's
    size; the excess goes to the others by weight until none is above. Sources
    fill up in the order of cap over weight, so the final level follows from
    running sums over the sources (one row each; the windows hold nothing else).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("position", F.row_number().over(place) - 1)
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    ranked = ranked.withColumn("weight", weights[F.pmod("position", F.lit(len(cycle)))])
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    so_far = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(so_far), F.lit(0)).alias("_cap"),
        F.coalesce(F.sum("weight").over(so_far), F.lit(0)).alias("_weight"),
        F.sum("source_size").over(whole).alias("_all"),
        F.sum("weight").over(whole).alias("_weights"),
    )
    level = (F.col("_all") - F.col("_cap")) / (F.col("_weights") - F.col("_weight"))
    fits = level * F.col("weight") <= F.col("cap")
    ranked = ranked.withColumn("_level", F.max(F.when(fits, level)).over(whole))
    # The first source in filling order that is not cut fixes the level; later ones would give a lower one.
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("source", "position", "weight", "source_size", target.alias("target"))


def _points(slot: Column) -> Column:
    """slot times the golden ratio, modulo 1, as an integer below 2^32 (no product exceeds 63 bits)."""
    low = F.pmod(slot, F.lit(1 << 16)) * GOLDEN
    high = F.pmod(F.pmod(F.floor(slot / F.lit(1 << 16)), F.lit(1 << 16)) * (GOLDEN % (1 << 16)), F.lit(1 << 16))
    return F.pmod(low + high * (1 << 16), F.lit(UNIT))


def schedule(spark, plan: DataFrame) -> DataFrame:
    """(slot, position, rank): the source of every slot and how often that source came before.

    ``plan`` has one row per source: position, blocks and quota (slots wanted).
    Cells of the unit interval turn the look-up into an equal join.
    """
    total = plan.agg(F.sum("quota")).first()[0] or 0
    cells = 1 << 12
    width = UNIT // cells
    after = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.floor(F.sum("quota").over(after) * F.lit(float(UNIT)) / F.lit(float(max(total, 1))))
    bounds = plan.select("position", cut.cast("long").alias("high"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("position")), F.lit(0)))
    bounds = bounds.where(F.col("low") < F.col("high"))
    spread = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    bounds = bounds.select("position", "low", "high", F.explode(spread).alias("cell"))
    slots = spark.range(int(total)).select(F.col("id").alias("slot"), _points(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    hit = slots.join(bounds, "cell").where((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
    hit = hit.select("slot", "position", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"), F.lit(1).alias("one"))
    return running_sum(hit, ["position"], "chunk", [F.col("slot")], "one", "rank").select("slot", "position", "rank")


def blocks(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(position, block, doc_id, size, start, words): the documents' stretches in every block.

    Documents of a source are ordered by a hash of their id, in 4,096 buckets of it.
    A source's last block may be shorter than its other blocks.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    laid = sized.where(F.col("size") > 0).select("position", "doc_id", "size", mark.alias("mark"))
    laid = laid.withColumn("bucket", F.substring("mark", 1, 3))
    laid = running_sum(laid, ["position"], "bucket", [F.col("mark"), F.col("doc_id"), F.col("size")], "size", "start")
    laid = laid.join(plan.select("position", "block_words"), "position")
    reach = F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))
    cut = laid.withColumn("block", F.explode(reach))
    first = F.col("block") * F.col("block_words")
    words = F.least(F.col("start") + F.col("size"), first + F.col("block_words")) - F.greatest(F.col("start"), first)
    return cut.select("position", "block", "doc_id", "size", "start", words.alias("words"))


def mix(docs: DataFrame, cycle=CYCLE, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 0):
    """Returns (schedule, blocks, taken).

    schedule: slot, position (of the source), block and round. blocks: which words of
    which documents a block holds. taken: one row per input row with doc_id, size,
    source, source_size, target and taken, the words that the slots take from it;
    no block is played more than ``most`` times.

    A source's blocks have ``block_words`` words, or fewer where the source has not
    LEAST_BLOCKS such blocks. Null texts are empty; empty documents and sources are given
    nothing; a null source is a source of its own; repeated rows count each for
    itself; other columns are ignored; an empty table gives empty results.
    """
    spark = docs.sparkSession
    counted = stage_table(sizes(docs))
    plan = source_targets(counted, cycle, most)
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {LEAST_BLOCKS}")))
    plan = plan.withColumn("block_words", length.cast("long"))
    plan = plan.withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words"))
    plan = stage_table(plan.withColumn("quota", F.round(F.col("target") / F.col("block_words")).cast("long")))
    names = plan.select(F.col("source").alias("_source"), "position")
    sized = counted.join(names, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "position")

    slots = schedule(spark, plan).join(plan.select("position", "blocks"), "position")
    slots = slots.where(F.col("rank") < F.col("blocks") * most)
    slots = slots.select("slot", "position", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("round"))
    cut = blocks(sized, plan, seed)
    plays = slots.groupBy("position", "block").agg(F.count("*").alias("plays"))
    taken = cut.join(plays, ["position", "block"], "left").groupBy("position", "start", "doc_id", "size")
    taken = taken.agg(F.sum(F.col("words") * F.coalesce("plays", F.lit(0))).alias("taken"))
    empty = sized.where(F.col("size") == 0).select("position", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    taken = taken.select("position", "doc_id", "size", "taken").unionByName(empty)
    taken = taken.join(plan.select("position", "source", "source_size", "target"), "position")
    return slots, cut, taken.select("doc_id", "size", "source", "source_size", "target", "taken")


def repeated(docs: DataFrame, cycle=CYCLE, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes its words.

    The part of a copy that is left over is rounded along the ids' hash, up or down with its
    own share as the chance, so sources still come near their targets and reruns agree.
    Rows without words are never taken by a mix of words; they stay once.
    """
    # The caller's columns travel in one struct, so no name of theirs can meet one of these.
    rows = stage_table(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("_row")))
    numbered = rows.select(F.col("_row").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    _, _, taken = mix(numbered, cycle, most, block_words, seed)
    chance = F.pmod(F.xxhash64(F.lit(f"{seed}:copy"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.expr("taken div size")
    part = (F.col("taken") % F.col("size")) / F.col("size")
    copies = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(whole + (part > chance).cast("long"))
    counted = taken.select(F.col("doc_id").alias("_row"), copies.alias("_copies")).where("_copies > 0")
    again = rows.join(counted, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return again.select("row.*")
