"""Line dedup by MinHash: near-equal lines of the whole corpus form components, one line of each stays.

Distinct lines are hashed to character shingles, seen as places on a circle of 64-bit numbers. Evenly
spaced points cut the circle into arcs; the first hashes at or after a point form a band, which two lines
share as often as their Jaccard similarity says. Bands are the join keys; lines of few shingles have their
first hashes as keys too, which miss no pair. Candidates are verified by the Jaccard similarity of all
hashes, and components come from distributed union-find. All of it is DataFrame functions.

One character changed inside a line changes up to CHARS shingles on either side of the comparison, so with 8
characters and 0.8 lines under 79 characters that differ in one inner character are not near copies.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.shared import STAGED, WORD, components, discard, read_by, stage_buckets, stage_table, sweep

CHARS = 8
JACCARD = 0.8
ROWS = 4
# 1 - (1 - 0.8^4)^12 = 99.8 % of pairs at the least similarity. Simulated: 99.8 to 100 % for 26 to 400 shingles.
BANDS = 12
# Lines of up to so many shingles have exact keys too. At 0.8 a line of 20 can match one of 25, so no pair whose shorter line has up to 20 is lost.
SHORT = 25
# Lines of a family that are ranked in one task, and the hash buckets whose counts order the shingles of larger ones.
FAMILY = 4096
ORDER_BITS = 20
# In near_by_hashes, hashes have HASH_BITS bits; the bits above them number the lines that are hashed together.
HASH_BITS = 52
MASK = np.uint64((1 << HASH_BITS) - 1)
GROUP_LINES = 1 << (64 - HASH_BITS)
GROUP_CHARS = 1 << 20
SLACK = 2
# Characters of a line that are cut into shingles at once.
PIECE = 1024
# Shingles of a line that are hashed in one row.
RUN = 32
_FACTORS = [np.uint64(random.Random(k).getrandbits(64) | 1) for k in range(3)]


def shingles(line: str, chars: int = CHARS) -> set[str]:
    """All runs of ``chars`` characters; a shorter line is its own only shingle."""
    return {line[i : i + chars] for i in range(len(line) - chars + 1)} if len(line) > chars else {line}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * _FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[1]
    return x ^ (x >> np.uint64(32))


def _groups(lines: list[str]):
    """Slices of at most GROUP_LINES lines and GROUP_CHARS characters; a longer line is a slice of its own."""
    start = total = 0
    for i, line in enumerate(lines):
        if i > start and (i - start == GROUP_LINES or total + len(line) > GROUP_CHARS):
            yield start, i
            start, total = i, 0
        total += len(line)
    if lines:
        yield start, len(lines)


def line_hashes(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the different shingle hashes of line i, ascending, are hashes[starts[i]:starts[i + 1]].

    Every hash carries the number of its line in the bits above HASH_BITS. Lines shorter than a shingle are filled up.
    """
    pad = "\0" * (chars - 1)
    codes = np.frombuffer((pad.join(lines) + pad + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    count = np.maximum(lengths - chars + 1, 1)
    offset = np.cumsum(lengths + chars - 1) - (lengths + chars - 1)
    line = np.arange(len(lines), dtype=np.uint64) << np.uint64(HASH_BITS)
    place = np.arange(count.sum()) + np.repeat(offset - (np.cumsum(count) - count), count)
    n = len(codes) - chars + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(chars):
        rolled = rolled * _FACTORS[2] + codes[k : k + n]
    found = (_mixed(rolled[place]) & MASK) | np.repeat(line, count)
    found.sort()
    found = found[np.append(True, found[1:] != found[:-1])]
    return found, np.append(np.searchsorted(found, line), len(found))


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the entries of consecutive rows that have so many entries."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each (_row), written down so that it never changes.

    They are dealt by their numbers, so that texts move once for all later joins on them.
    """
    return stage_buckets(docs.withColumn("_row", F.monotonically_increasing_id()), "_row", "zstd")


def split_lines(rows: DataFrame) -> DataFrame:
    """(_late, doc_id, _row, pos, line) of all lines; rows without an id sort last."""
    head = [F.col("doc_id").isNull().alias("_late"), F.col("doc_id"), F.col("_row")]
    return rows.where(F.col("text").isNotNull()).select(*head, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def shingle_hashes(line: Column, chars: int = CHARS) -> Column:
    """The hashes of the different shingles of a line; a line shorter than a shingle is its own only shingle.

    Texts of one byte a character are cut as bytes, others as four-byte characters; the hash of a shingle is that
    of its UTF-8 either way. A line is cut into pieces first, so that a shingle costs the same in lines of any length.
    """
    n = F.greatest(F.char_length(line) - chars + 1, F.lit(1))

    def cut(raw: Column, width: int, text) -> Column:
        starts = F.sequence(F.lit(0), n - 1, F.lit(PIECE))
        # Each step hands its result on as a lambda's variable, which is computed once.
        pieces = F.get(F.transform(F.array(raw), lambda r: F.transform(starts, lambda k: r.substr(k * width + 1, F.lit((PIECE + chars - 1) * width)))), F.lit(0))
        starts_in = lambda p: F.sequence(F.lit(1), F.greatest(F.octet_length(p) - chars * width, F.lit(0)) + 1, F.lit(width))
        hashed = lambda p, i: F.xxhash64(text(p.substr(i, F.lit(chars * width))))
        return F.flatten(F.transform(pieces, lambda p: F.transform(starts_in(p), lambda i: hashed(p, i))))

    plain = cut(line.cast("binary"), 1, lambda p: p)
    wide = cut(F.encode(line, "UTF-32"), 4, lambda p: F.decode(p, "UTF-32"))
    return F.array_distinct(F.when(F.octet_length(line) == F.char_length(line), plain).otherwise(wide))


def first_count(n: Column, jaccard: float) -> Column:
    """n - ceil(jaccard * n) + 1: two sets that similar share one of so many first members in any common order."""
    return (n - F.ceil(n * jaccard - 1e-9) + 1).cast("int")


def band_keys(hashed: DataFrame, bands: int, per_band: int, jaccard: float) -> DataFrame:
    """Rows with ascending ``hashes``, with their number n and the keys (bands) in place of them: the first
    ``per_band`` hashes at or after each of the points that cut the circle of all numbers into arcs.

    Where an arc holds no hash, the next one's key says the same. Lines of up to SHORT shingles have their first
    hashes, which miss no pair that similar, as keys too.
    """
    others = [c for c in hashed.columns if c != "hashes"]
    points = [F.lit(-(1 << 63) + (j << 64) // bands).cast("bigint") for j in range(bands)]
    n = F.size("hashes")
    # Sorted in between the hashes, the points say how many hashes lie before them. The first hashes follow the last ones.
    circle = F.when(n < per_band, F.flatten(F.array_repeat("hashes", per_band + 1))).otherwise(F.concat("hashes", F.slice("hashes", 1, per_band)))
    placed = hashed.select(*others, "hashes", n.alias("n"), F.sort_array(F.concat("hashes", F.array(*points))).alias("placed"), circle.alias("circle"))
    # Written out for each point and not as a lambda, so that it is compiled; the hash of an array is that of its members.
    keys = F.array(*[F.xxhash64(F.slice("circle", (F.array_position("placed", p) - j).cast("int"), per_band)) for j, p in enumerate(points)])
    exact = F.when(F.col("n") <= SHORT, F.slice("hashes", 1, first_count(F.col("n"), jaccard))).otherwise(F.array().cast("array<bigint>"))
    exact = F.transform(exact, lambda h: F.xxhash64(F.lit(-1), h))
    return placed.select(*others, "n", F.array_distinct(F.concat(keys, exact)).alias("bands"))


def line_hashes_in_rows(lines: DataFrame, chars: int = CHARS) -> DataFrame:
    """Rows with a ``line`` and, in its place, the hashes of its shingles, repeats included; rows are told apart by
    their other columns.

    As ``shingle_hashes``, but compiled: a row for each run of shingles, gathered again where it lies if the rows were
    dealt by some of the columns. The hash is that of a shingle's UTF-32.
    """
    others = [c for c in lines.columns if c != "line"]
    n = F.greatest(F.char_length("line") - chars + 1, F.lit(1))
    runs = lines.select(*others, F.encode("line", "UTF-32").alias("raw"), n.alias("n"))
    runs = runs.select(*others, "raw", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))).alias("at"))
    # The last run ends with the line, so it may hold shingles of the one before again.
    at, size = F.least(F.col("at"), F.greatest(F.col("n") - RUN, F.lit(0))), RUN + chars - 1
    runs = runs.select(*others, F.substr("raw", at * 4 + 1, F.lit(size * 4)).alias("run"), F.least(F.col("n"), F.lit(RUN)).alias("n"))
    # Little code for a shingle: Java does not compile a method that grows too long.
    told = F.array(*[F.xxhash64(F.col("run").substr(4 * k + 1, 4 * chars)) for k in range(RUN)])
    hashed = runs.select(*others, F.slice(told, F.lit(1), F.col("n")).alias("hashes"))
    return hashed.groupBy(*others).agg(F.flatten(F.collect_list("hashes")).alias("hashes"))


def distinct_lines(rows: DataFrame, chars: int = CHARS, bands: int = BANDS, per_band: int = ROWS, jaccard: float = JACCARD) -> tuple[DataFrame, DataFrame]:
    """(id, first) and (id, n, bands): every different line with a word by its first place, its number of different
    shingles and its band keys.

    Equal lines meet by a digest, so no line is shuffled; signatures are taken where the texts lie (see ``cut_lines``).
    """
    spoken = split_lines(rows).where(F.col("line").rlike(WORD))
    once = spoken.groupBy(F.unhex(F.md5("line")).alias("mark")).agg(F.min(F.struct("_late", "doc_id", "_row", "pos")).alias("first"))
    once = stage_table(once.select(F.monotonically_increasing_id().alias("id"), "first"), "zstd")
    sweep(rows.sparkSession)
    hashed = line_hashes_in_rows(cut_lines(once, rows).drop("first"), chars)
    hashed = hashed.select("id", F.array_distinct(F.sort_array("hashes")).alias("hashes"))
    return once, stage_table(band_keys(hashed, bands, per_band, jaccard), "zstd")


def cut_lines(places: DataFrame, rows: DataFrame) -> DataFrame:
    """(_row, id, first, line) of the lines at these places (id, first), cut out of the rows that hold them; dealt by _row."""
    wanted = places.groupBy(F.col("first._row").alias("_row")).agg(F.collect_list(F.struct("id", "first")).alias("wanted"))
    held = rows.select("_row", "text").join(wanted, "_row").select("_row", F.split("text", "\n").alias("held"), "wanted")
    told = held.select("_row", "held", F.explode("wanted").alias("w"))
    return told.select("_row", "w.id", "w.first", F.get("held", F.col("w.first.pos")).alias("line"))


def line_texts(ids: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, line) of the lines with these ids; written down."""
    placed = places.join(ids.select("id").distinct(), "id", "left_semi")
    texts = stage_table(cut_lines(placed, rows).select("id", "line"), "zstd")
    sweep(rows.sparkSession)
    return texts


def sizes_fit(jaccard: float) -> Column:
    """Whether sets of sizes n and _n can be that similar; rules pairs out for certain."""
    return F.least("n", "_n") >= F.greatest("n", "_n") * jaccard - 1e-9


def plausible(pairs: DataFrame, lines: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """The pairs (a, b) that sizes do not rule out; no text moves for it."""
    left = lines.select(F.col("id").alias("a"), "n")
    right = lines.select(F.col("id").alias("b"), F.col("n").alias("_n"))
    return pairs.join(left, "a").join(right, "b").where(sizes_fit(jaccard)).select("a", "b")


def _pair_groups(xs: list[str], ys: list[str]):
    """Slices of at most GROUP_LINES / 2 pairs and GROUP_CHARS characters; a longer pair is a slice of its own."""
    start = total = 0
    for i, (x, y) in enumerate(zip(xs, ys)):
        size = len(x) + len(y)
        if i > start and (2 * (i - start) >= GROUP_LINES or total + size > GROUP_CHARS):
            yield start, i
            start, total = i, 0
        total += size
    if xs:
        yield start, len(xs)


def near_by_hashes(xs: list[str], ys: list[str], jaccard: float, chars: int) -> np.ndarray:
    """Whether the shingle hashes of x and y say that they may be that similar, for every pair (x, y).

    Up to SLACK equal hashes of different shingles cannot hide a pair; what passes is compared by its strings.
    """
    at = {}
    left = np.array([at.setdefault(x, len(at)) for x in xs])
    right = np.array([at.setdefault(y, len(at)) for y in ys])
    hashes, starts = line_hashes(list(at), chars)
    n = np.diff(starts)
    taken = np.concatenate([left, right])
    row, k = _within(n[taken])
    pair = row % len(xs)
    met = (pair.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes[starts[taken[row]] + k] & MASK)
    met.sort()
    both = np.bincount((met[1:][met[1:] == met[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(xs)) + SLACK
    return both >= jaccard * (n[left] + n[right] - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, jaccard: float = JACCARD, chars: int = CHARS) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity of shingle sets, told by their 64-bit hashes, is high enough; written down.

    ``texts`` holds (id, line) of their lines.
    """
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("_x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("_y"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("line")) for k, c in enumerate(("_x", "_y"))]))
    told = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").repartition("a", "b")
    told = line_hashes_in_rows(told.select("a", "b", sides.alias("s")).select("a", "b", "s.side", "s.line"), chars)
    sets = told.select("a", "b", F.array_distinct("hashes").alias("hashes")).groupBy("a", "b").agg(F.collect_list("hashes").alias("sets"))
    x, y = F.get("sets", F.lit(0)), F.get("sets", F.lit(1))
    shared = sets.select("a", "b", F.size(F.array_intersect(x, y)).alias("both"), (F.size(x) + F.size(y)).alias("all"))
    # The counts are written before they are compared, so that no filter repeats the sets' work.
    return stage_table(shared, "zstd").where(F.col("both") >= jaccard * (F.col("all") - F.col("both"))).select("a", "b")


def links(lines: DataFrame, places: DataFrame, rows: DataFrame, jaccard: float = JACCARD, chars: int = CHARS) -> DataFrame:
    """(node, component) over all lines that share a band and reach the similarity.

    First every line of a bucket meets one line of it only, the one that shares most buckets with others
    (of variants of one line, most likely the original), which settles buckets of
    near copies in linear work. Lines still in different components of one bucket meet where they share
    a bucket and a rare shingle, which loses no link and does not pair up the bucket.
    """
    spark = lines.sparkSession
    made = len(STAGED)
    placed = lines.select("id", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("size > 1")
    shared = stage_table(shared, "zstd")
    sweep(spark)
    twos = shared.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    many = stage_table(placed.join(shared.where("size > 2").select("key", "size"), "key"), "zstd")
    sweep(spark)
    met = many.join(many.groupBy("id").agg(F.sum("size").alias("_met")), "id")
    middle = met.groupBy("key").agg(F.max(F.struct("_met", "id"))["id"].alias("middle"))
    crowd = stage_table(many.join(middle, "key"), "zstd")
    star = crowd.where(F.col("id") != F.col("middle")).select(F.least("id", "middle").alias("a"), F.greatest("id", "middle").alias("b"))
    pairs = stage_table(plausible(twos.unionByName(star).distinct(), lines, jaccard), "zstd")
    # Whoever meets others later is in one of these pairs or in a bucket of more than two.
    texts = line_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")), places, rows)
    near = verified(pairs, texts, jaccard, chars)
    sweep(spark)
    found = components(near)
    member = crowd.join(found.withColumnRenamed("node", "id"), "id", "left")
    member = member.select("key", "id", "middle", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    open_ = stage_table(member.join(mixed.where(F.col("_a") != F.col("_b")).select("key"), "key", "left_semi"), "zstd")
    sweep(spark)
    if not open_.isEmpty():
        # Lines that share a bucket, or are joined by lines that do, are a family.
        family = components(open_, "id", "middle").select(F.col("node").alias("id"), F.col("component").alias("family"))
        left = open_.select("id", "component").distinct().join(family, "id")
        keys = stage_table(open_.groupBy("id").agg(F.collect_list("key").alias("keys")), "zstd")
        more = rare_pairs(left, texts, jaccard, chars)
        for c in ("a", "b"):
            more = more.join(keys.select(F.col("id").alias(c), F.col("keys").alias(f"_{c}")), c)
        more = stage_table(more.where(F.arrays_overlap("_a", "_b")).select("a", "b"), "zstd")
        found = components(near.unionByName(verified(more, texts, jaccard, chars)))
    # The components lie in the last table; all others made here have been read for the last time.
    discard(spark, sorted(set(STAGED[made:]) - read_by(found)))
    sweep(spark)
    return found


def rare_pairs(members: DataFrame, texts: DataFrame, jaccard: float = JACCARD, chars: int = CHARS) -> DataFrame:
    """Pairs (a, b) of members (id, component), with texts (id, line), in different components that may reach the similarity;
    none that does is missing. If the members have a ``family``, only its lines are paired.

    In any fixed order of all shingles, two sets that similar share one of the first n - ceil(jaccard * n) + 1 of
    each, and at the first that they share enough must be left after it in both; in the smaller set it is one of the
    first n - ceil(2 * jaccard / (1 + jaccard) * n) + 1. The order goes from shingles rare in the family to
    common ones (in families of more than FAMILY lines, by the counts of hash buckets), so lines with text of their own
    meet few others, and what many lines have in common is behind the first shingles of those that are not similar.
    """
    if "family" not in members.columns:
        members = members.withColumn("family", F.lit(0))
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    held = members.join(sizes, "family").join(texts, "id").select("id", "component", "family", "line", (F.col("size") > FAMILY).alias("large"))
    held = stage_table(held, "zstd")

    def told(part: DataFrame, key: str) -> DataFrame:
        # Dealt by the key, so that hashes, counts and ranks are taken where the texts lie and never written.
        sets = line_hashes_in_rows(stage_buckets(part.drop("large"), key, "zstd"), chars)
        sets = sets.select("id", "component", "family", F.array_distinct("hashes").alias("hashes"))
        return sets.select("id", "component", "family", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle"))

    def first(ranked: DataFrame) -> DataFrame:
        return ranked.where(F.col("at") < first_count(F.col("n"), jaccard)).select("id", "component", "family", "n", "shingle", "at")

    one = Window.partitionBy("family", "shingle")
    order = Window.partitionBy("family", "id").orderBy("times", "shingle")
    near = told(held.where("not large"), "family")
    near = near.select("*", F.count("*").over(one).alias("times"), F.min("component").over(one).alias("_a"), F.max("component").over(one).alias("_b"))
    rare = first(near.withColumn("at", F.row_number().over(order) - 1).where("_a <> _b"))
    if held.where("large").limit(1).count():
        # One row for each of the 2 ** ORDER_BITS buckets at most, whatever the table's size.
        bucket = F.shiftrightunsigned("shingle", 64 - ORDER_BITS).alias("bucket")
        far = told(held.where("large"), "id")
        often = stage_table(far.groupBy(bucket).agg(F.count("*").alias("times")))
        far = far.withColumn("bucket", bucket).join(F.broadcast(often), "bucket")
        order = Window.partitionBy("id").orderBy("times", "bucket", "shingle")
        rare = rare.unionByName(first(far.withColumn("at", F.row_number().over(order) - 1)))
    rare = stage_table(rare, "zstd")
    mixed = rare.groupBy("family", "shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    met = stage_table(rare.join(mixed.select("family", "shingle"), ["family", "shingle"], "left_semi"), "zstd")
    sweep(members.sparkSession)
    small = met.withColumnRenamed("id", "a").where(F.col("at") < first_count(F.col("n"), 2 * jaccard / (1 + jaccard)))
    other = met.select("family", "shingle", F.col("id").alias("b"), F.col("component").alias("_other"), F.col("n").alias("_n"), F.col("at").alias("_at"))
    needed = F.ceil((F.col("n") + F.col("_n")) * (jaccard / (1 + jaccard)) - 1e-9)
    left = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    smaller = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("a") < F.col("b")))
    fits = (F.col("component") != F.col("_other")) & smaller & sizes_fit(jaccard) & (left >= needed)
    return small.join(other, ["family", "shingle"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dedup(docs: DataFrame, jaccard: float = JACCARD, chars: int = CHARS) -> DataFrame:
    """The documents with all their columns; of every component of lines only the first line stays.

    First is the smallest doc_id (rows without one come last), then the first row and line.
    Lines without a word are kept as they are and never compared; a null text stays null; a text
    that loses all its lines becomes empty; repeated rows count as different documents,
    so the later ones lose their lines; other columns pass through whatever their names; an empty table gives no rows.
    Adds n_lines and n_dropped, in place of columns of these names.
    """
    # The caller's columns travel in one struct, so no name of theirs can meet one of these.
    rows = numbered(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")))
    sweep(docs.sparkSession)
    places, lines = distinct_lines(rows, chars, jaccard=jaccard)
    sweep(docs.sparkSession)
    member = places.join(links(lines, places, rows, jaccard, chars), F.col("id") == F.col("node"))
    least = member.groupBy("component").agg(F.min("first").alias("least"))
    lost = member.join(least, "component").where(F.col("first") != F.col("least")).select("id")
    kept = places.join(lost, "id", "left_anti").select(F.col("first._row").alias("_row"), F.col("first.pos").alias("pos"))
    kept = stage_table(kept.groupBy("_row").agg(F.collect_list("pos").alias("_kept")), "zstd")
    discard(docs.sparkSession, sorted(read_by(lines) | read_by(places) | read_by(member)))
    sweep(docs.sparkSession)

    # One row a document, so the work on its lines is linear: positions kept, and those without a word, in order.
    told = rows.join(kept, "_row", "left").select("row", "text", F.split("text", "\n").alias("held"), "_kept")
    places = F.sequence(F.lit(0), F.size("held") - 1)
    mute = F.filter(places, lambda k: ~F.get("held", k).rlike(WORD))
    stay = F.sort_array(F.array_union(F.coalesce("_kept", F.array().cast("array<int>")), mute)).alias("stay")
    told = told.select("row", "text", "held", F.when(F.col("text").isNotNull(), stay).alias("stay"))
    text = F.array_join(F.transform("stay", lambda k: F.get("held", k)), "\n").alias("text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("held"))
    n_dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size("held") - F.size("stay"))
    out = told.select("row", text, n_lines.cast("int").alias("n_lines"), n_dropped.cast("int").alias("n_dropped"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in names], "n_lines", "n_dropped")
