"""SimHash near-duplicates through Golay-code keys.

A 64-bit fingerprint is split into three segments of at most 22 bits, each read as
a word of the perfect binary Golay code (23 bits, 12 of them free, radius 3). A word's
labels are the indexes of the codewords that it and its 23 neighbours decode to: one
or six. Two words at distance 2 have a common neighbour or are neighbours, so they
share a label. Of three segments with four errors in all, two have at most two errors
each; so fingerprints within four bits share a pair of labels in one of the three
segment pairs. Those pairs are the join keys; equal keys are verified by distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import components, stage_table, worker_state

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 1024
BATCH_SHINGLES = 1 << 15
# Fixed value: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
FOUND = "overflow boolean, key long, block int, a long, b long"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BATCH_SHINGLES):
        spans = zip(starts[i : min(n, i + BATCH_SHINGLES)].tolist(), last[i : i + BATCH_SHINGLES].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fingerprint long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 4,096 high parts, and for each of the 2,048 syndromes the 6 patterns that lead to labels (repeated if one)."""
    of_bit = [1]
    for _ in range(22):
        x = of_bit[-1] << 1
        of_bit.append(x ^ GENERATOR if x >> 11 else x)
    bits = [(1 << i, of_bit[i]) for i in range(23)]
    leader = np.zeros(2048, np.int64)
    for i, (e1, s1) in enumerate(bits):  # every syndrome has one pattern of at most three bits
        leader[s1] = e1
        for j, (e2, s2) in enumerate(bits[:i]):
            leader[s1 ^ s2] = e1 | e2
            for e3, s3 in bits[:j]:
                leader[s1 ^ s2 ^ s3] = e1 | e2 | e3
    high = np.zeros(4096, np.int64)
    for i in range(12):
        high ^= (np.arange(4096) >> i & 1) * of_bit[11 + i]
    patterns = np.zeros((2048, 6), np.int64)
    for syndrome in range(2048):
        near = {int(leader[syndrome])} | {e ^ int(leader[syndrome ^ s]) for e, s in bits}
        patterns[syndrome] = np.resize(sorted(near), 6)
    return high, patterns


def labels(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indexes of 23-bit words, and which of them are not repeated."""
    state = worker_state()
    if "golay" not in state:
        state["golay"] = golay_tables()
    high, patterns = state["golay"]
    near = patterns[high[words >> 11] ^ (words & 0x7FF)]
    single = near[:, 0] == near[:, 1]
    fresh = np.ones(near.shape, bool)
    fresh[single, 1:] = False
    return (words[:, None] ^ near) >> 11, fresh


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all segment-pair keys of signed 64-bit fingerprints."""
    unsigned = prints.view(np.uint64)
    parts = [labels((unsigned >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows = np.broadcast_to(np.arange(len(prints))[:, None, None], (len(prints), 6, 6))
    out = []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, fresh_a), (b, fresh_b) = parts[i], parts[j]
        key = (pair << 24) | (a[:, :, None] << 12) | b[:, None, :]
        fresh = fresh_a[:, :, None] & fresh_b[:, None, :]
        out.append((key[fresh], rows[fresh]))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def linked(prints: np.ndarray, runs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the distance inside each run (equal neighbouring run numbers).

    A spanning set only: (smallest position reachable, position), at most one per row.
    """
    n = len(prints)
    ends = np.searchsorted(runs, runs, side="right")
    left, right = [], []
    active, step = np.arange(n), 1
    while (active := active[ends[active] > active + step]).size:
        near = np.bitwise_count(prints[active] ^ prints[active + step]) <= distance
        left.append(active[near])
        right.append(active[near] + step)
        step += 1
    return spanning(n, left, right)


def spanning(n: int, left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(old, root):
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    rows = np.flatnonzero(root != np.arange(n))
    return root[rows], rows


def _runs(distance: int):
    """Over rows sorted by key: links inside each key's run; a run above BLOCK rows is passed on in blocks."""

    def table(over, key, block, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), over)), pa.array(key, pa.int64()), pa.array(block, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            names=["overflow", "key", "block", "a", "b"],
        )

    def settle(key, prints):
        root, row = linked(prints, key, distance)
        if row.size:
            pairs = np.unique(np.stack([prints[row], prints[root]], axis=1), axis=0)
            none = np.zeros(len(pairs), np.int64)
            yield table(False, none, none, pairs[:, 0], pairs[:, 1])

    def run(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        big, passed = None, 0  # the key whose run is being passed on, and how many of its rows are
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(key)))
            for s, n in zip(starts.tolist(), sizes.tolist()):
                if key[s] == big or n > BLOCK:
                    passed = passed if key[s] == big else 0
                    big = key[s]
                    yield table(True, key[s : s + n], (passed + np.arange(n)) // BLOCK, prints[s : s + n], prints[s : s + n])
                    passed += n
            whole = np.repeat((sizes <= BLOCK) & (key[starts] != big), sizes) if len(key) else np.zeros(0, bool)
            tail = len(key) - int(sizes[-1]) if len(key) else 0
            done = whole[:tail]
            yield from settle(key[:tail][done], prints[:tail][done])
            held_key, held = key[tail:][whole[tail:]], prints[tail:][whole[tail:]]
        yield from settle(held_key, held)

    return run


def _across(distance: int):
    """Links inside a pair of blocks of one run."""

    def run(group):
        group = group.sort_by([("a", "ascending")])
        prints = np.asarray(group.column("a"))
        block = np.asarray(group.column("block"))
        first = np.flatnonzero(block == block.min())
        second = np.flatnonzero(block == block.max())
        left, right = [], []
        for i in first:
            near = second[np.bitwise_count(prints[second] ^ prints[i]) <= distance]
            left.append(np.full(len(near), i))
            right.append(near)
        root, row = spanning(len(prints), left, right)
        return pa.table({"a": prints[row], "b": prints[root]})

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links of a table of distinct fingerprints (column fingerprint) that connect all within the distance."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the segment keys hold for distances up to 4")

    def emit(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(prints), 2000):
                key, row = keys(part := prints[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part[row], pa.int64())], names=["key", "fingerprint"])

    keyed = distinct.select("fingerprint").mapInArrow(emit, "key long, fingerprint long")
    sorted_runs = keyed.repartition("key").sortWithinPartitions("key", "fingerprint")
    found = stage_table(sorted_runs.mapInArrow(_runs(distance), FOUND).distinct())
    near = found.where(~F.col("overflow")).select("a", "b")
    over = found.where("overflow").select("key", "block", "a")
    if over.isEmpty():
        return near
    last = over.groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    pairs = over.join(last, "key").select("key", "block", "a", other.alias("other"))
    pairs = pairs.select("key", "block", "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return near.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(_across(distance), "a long, b long").distinct())


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable over links of at most ``distance``
    differing bits. A null or empty text has fingerprint zero; repeated rows share a
    fingerprint; a null doc_id gets its group's smallest id (null if there is none);
    other columns are ignored; an empty table gives no rows.
    """
    prints = stage_table(fingerprints(docs, shingle))
    distinct = stage_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, distance))
    named = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fingerprint", "component_id")
    out = prints.join(named, "fingerprint")
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", text.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, row: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group with all its columns: the smallest doc_id's (rows without one come last), then the smallest ``row``.

    ``row`` names a column that numbers the rows of a written table. Texts are fingerprinted where
    they lie; only fingerprints and numbers are shuffled, until the chosen rows are fetched.
    """
    slim = docs.select(F.col(row).alias("doc_id"), "text")
    prints = fingerprints(slim, shingle).withColumnRenamed("doc_id", row)
    named = stage_table(prints.join(docs.select(row, F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.col(row).alias("row")).alias("place")), row))
    distinct = stage_table(named.groupBy("fingerprint").agg(F.min("place").alias("place")))
    found = components(links(distinct, distance)).withColumnRenamed("node", "fingerprint")
    grouped = distinct.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    chosen = grouped.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return docs.join(chosen, row, "left_semi")
