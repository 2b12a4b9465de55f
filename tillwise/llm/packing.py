"""Packing token pieces into fixed windows by non-negative least squares on their lengths.

Documents are cut into whole windows, one piece whose length is a multiple of
GRAIN, and a tail below GRAIN. Shallow combinations of grid lengths that fill a
window exactly are the columns of a least-squares problem against the length
histogram; its rounded solution says how often each combination is used, and a
greedy pass over the histogram packs the rest together with the tails. Only
histograms (a row per length) reach the driver; a piece finds its sequence from
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.shared import running_sum, stage_table
from tillwise.llm.tokens import encoder

WINDOW = 2048
GRAIN = 32
DEPTH = 4
BUCKETS = 1024
PIECES = "doc_id long, row_id long, start long, length long, doc_tokens long, ids binary"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def cuts(tokens: int, window: int = WINDOW, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole = tokens // window * window
    grid = whole + (tokens - whole) // grain * grain
    ends = [*range(window, whole + 1, window), *[e for e in (grid, tokens) if e > whole]]
    return [(a, b - a) for a, b in zip([0, *ends], ends) if b > a]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """A row per piece: doc_id, row_id (a number of the document's row), start, length, doc_tokens and the ids.

    Ids are little-endian whole numbers of two bytes where the vocabulary allows, else of four.
    """

    def cut(batches):
        worker = encoder(vocabulary)
        width = 2 if worker.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places, starts, lengths, totals, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                whole = np.frombuffer(worker.encode(text.as_py() or "") + end, "<u4").astype(f"<u{width}").tobytes()
                n = len(whole) // width
                for start, length in cuts(n, window, grain):
                    places.append(i)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(n)
                    ids.append(whole[width * start : width * (start + length)])
            columns = [[names[i] for i in places], [numbers[i] for i in places], starts, lengths, totals]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(ids, pa.binary())], names=PIECE_NAMES)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text")
    return numbered.mapInArrow(cut, PIECES)


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write ``units`` as a sum of up to ``depth`` whole parts, largest first."""

    def extend(rest, most, left):
        if rest == 0:
            yield ()
        elif left:
            for part in range(min(rest, most), (rest + left - 1) // left - 1, -1):
                for more in extend(rest - part, part, left - 1):
                    yield (part, *more)

    return list(extend(units, units, depth))


def nonnegative_least_squares(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Active-set solution of min |a x - y| with x >= 0."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, np.abs(y).max(initial=0.0))
    for _ in range(10 * a.shape[0]):
        gradient = np.where(used, -np.inf, a.T @ (y - a @ x))
        if used.all() or gradient.max() <= limit:
            break
        used[gradient.argmax()] = True
        while True:
            trial = np.zeros_like(x)
            trial[used] = np.linalg.lstsq(a[:, used], y, rcond=None)[0]
            if trial[used].min() > 0:
                break
            falling = used & (trial <= 0)
            step = np.min(x[falling] / (x[falling] - trial[falling] + 1e-300))
            x = x + step * (trial - x)
            used &= x > limit
            x[~used] = 0
            if not used.any():
                trial = x
                break
        x = trial
    return x


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each of ``parts``: (length, how many) in this order."""

    parts: tuple[tuple[int, int], ...]
    times: int


def plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that use every piece of the histogram exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    units = window // grain
    columns = [c for c in combinations(units, depth) if all(left.get(p * grain) for p in c)]
    out: list[Pattern] = []
    if columns:
        matrix = np.zeros((units, len(columns)))
        for j, combination in enumerate(columns):
            for part in combination:
                matrix[part - 1, j] += 1
        wanted = np.array([left.get(grain * (i + 1), 0) for i in range(units)], float)
        for j, times in enumerate(np.round(nonnegative_least_squares(matrix, wanted)).astype(int)):
            parts = tuple((grain * p, columns[j].count(p)) for p in sorted(set(columns[j]), reverse=True))
            times = min([int(times), *(left[n] // k for n, k in parts)])  # rounding may ask for more than there is
            if times > 0:
                out.append(Pattern(parts, times))
                for n, k in parts:
                    left[n] -= times * k
    lengths = sorted((n for n in left if left[n]), reverse=True)
    while lengths:
        room, parts = window, []
        for n in lengths:
            k = min(room // n, left[n])
            if k:
                parts.append((n, k))
                room -= k * n
        times = min(left[n] // k for n, k in parts)
        out.append(Pattern(tuple(parts), times))
        for n, k in parts:
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
    return out


def segments(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past last rank, per sequence, first sequence, offset) for every part of every pattern."""
    out, taken, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for n, k in pattern.parts:
            low = taken.get(n, 0)
            taken[n] = low + k * pattern.times
            out.append((n, low, taken[n], k, sequence, offset))
            offset += k * n
        sequence += pattern.times
    return out


def place(cut: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to pieces that lie in a table of their own.

    Pieces of equal length are ranked by a hash bucket of their document, so the
    commonest length is spread over BUCKETS groups. The look-up table is broadcast: a
    length has at most as many parts as there are patterns, and their number depends
    on the window alone.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = segments(plan(histogram, window, grain, depth))
    schema = "_length long, _low long, _high long, _each long, _first long, _offset long"
    lookup = F.broadcast(spark.createDataFrame(table, schema))
    marked = cut.withColumn("_bucket", F.pmod(F.xxhash64("row_id", "start"), F.lit(BUCKETS))).withColumn("_one", F.lit(1))
    order = [F.col("row_id"), F.col("start")]
    ranked = running_sum(marked, ["length"], "_bucket", order, "_one", "_rank")
    hit = ranked.join(lookup, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    turn = F.col("_rank") - F.col("_low")
    hit = hit.withColumn("sequence_id", F.col("_first") + F.floor(turn / F.col("_each")))
    hit = hit.withColumn("offset", F.col("_offset") + turn % F.col("_each") * F.col("length"))
    return hit.select(*cut.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, end_id: int = 1) -> DataFrame:
    """Pieces of all documents, ids included, with their sequence and offset.

    A null text is empty and gives the end id alone; repeated rows are packed each for itself and told apart by
    row_id; other columns are ignored; an empty table gives no rows.
    """
    return place(stage_table(pieces(docs, vocabulary, end_id, window, grain)), window, grain, depth)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, without padding; a group holds one window at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with the crc32 of their ids, as unsigned 32-bit numbers, in place of the ids."""
    names = [c for c in packed.columns if c != "ids"]

    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            sums = [zlib.crc32(np.frombuffer(raw.as_buffer(), f"<u{raw.as_buffer().size // n}").astype("<u4")) for raw, n in zip(batch.column("ids"), lengths)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    return packed.mapInArrow(run, ", ".join([*[f"{c} long" for c in names], "ids_crc32 long"]))
