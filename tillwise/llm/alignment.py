"""Alignment of two tokenizers' ids over the same texts, with a fast path for ids of the same bytes.

Byte offsets where tokens of A (byte-level BPE) and B (pieces with byte fallback) both end cut a text
into groups. Most groups hold one token of either side. Ids of A are mapped once to the id of B with
the same bytes; groups that follow this map are counted in vectors as long as the vocabulary. Only the
links of other groups are shuffled as pairs: pairs that hold a large share of them are then looked
up in the task, like the vectors, and all others are joined.

A space after a character that is not white space starts a new token on both sides, so texts are cut
there and every different piece is encoded and aligned once while it is in a worker's cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import stage_table, worker_state
from tillwise.llm.tokens import byte_alphabet

CACHE_ENTRIES = 180_000
LONGEST_CACHED = 64
RUN = re.compile(r"\s ")
SPACE = "▁"
# Irregular pairs with more than this share of all irregular links are looked up, so at most as many.
HOT_PAIRS = 1024
BATCH_DOCS = 100
ALIGNED = "_row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same array<int>, pairs array<long>"
SCORED = (
    "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "cold array<struct<pair:long,times:long>>"
)


class Groups(NamedTuple):
    text: bytes  # a1,a2|b1;a3|b2,b3
    n_a: int
    n_b: int
    n_groups: int
    same: bytes  # A ids (int32) of the groups that follow the identity map
    pairs: bytes  # a * (ids of B) + b (int64) of all other links


NOTHING = Groups(b"", 0, 0, 0, b"", b"")


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace(SPACE, " ").encode() for p, one in zip(pieces, single)]
        self.size_b = len(pieces)
        # Pieces with a space inside could join two words; without them every word can be encoded alone.
        spoken = [p for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.cut_at_spaces = all(SPACE not in p.lstrip(SPACE) for p in spoken)
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(self.size_b), key=lambda i: single[i]):  # whole pieces go before single bytes
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                by_bytes.setdefault(self.bytes_b[i], i)
        self.bytes_a_length = [*map(len, self.bytes_a)]
        self.identity = [by_bytes.get(x, -1) for x in self.bytes_a]
        self.mapped = np.array(self.identity)
        self.cache: dict[str, Groups] = {}

    def groups(self, a: list[int], b: list[int], expected: bytes) -> Groups | None:
        """The groups of two encodings, or None where either does not give back the expected bytes."""
        of_a, of_b = [*map(self.bytes_a.__getitem__, a)], [*map(self.bytes_b.__getitem__, b)]
        if not a or b"".join(of_a) != expected or b"".join(of_b) != expected:
            return None
        identity, parts, same, pairs = self.identity, [], [], []
        ends_b, at = {}, 0  # byte offset to the number of B tokens that end there or before
        for j, x in enumerate(of_b, 1):
            at += len(x)
            ends_b[at] = j
        at = first_a = first_b = 0
        for i, x in enumerate(of_a, 1):
            at += len(x)
            j = ends_b.get(at)
            if j is None:
                continue
            if i - first_a == 1 and j - first_b == 1:
                p, q = a[first_a], b[first_b]
                parts.append(f"{p}|{q}")
                regular = identity[p] == q
            else:
                p, q = a[i - 1], b[j - 1]
                parts.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                regular = False
            if regular:
                same.append(p)
            else:
                pairs.append(p * self.size_b + q)
            first_a, first_b = i, j
        return Groups(";".join(parts).encode(), len(a), len(b), len(parts), array("i", same).tobytes(), array("q", pairs).tobytes() if pairs else b"")

    def whole(self, text: str) -> Groups:
        spaced = " " + text
        a = self.a.encode(spaced, add_special_tokens=False).ids
        return self.groups(a, self.b.encode(text, num_threads=1), spaced.encode()) or NOTHING

    def _fresh(self, pieces: list[str]) -> dict[str, Groups | None]:
        """The groups of pieces, each as if encoded alone; None where a piece does not come back."""
        pieces = sorted(pieces, key=lambda p: p[-1].isspace())  # a piece that ends in white space would swallow the next one's space
        alone = sum(p[-1].isspace() for p in pieces)
        together = pieces[: len(pieces) - alone]
        ids = self.a.encode_batch_fast(["".join(together), *pieces[len(together) :]], add_special_tokens=False)
        first, raw = ids[0].ids, [p.encode() for p in pieces]
        ends = np.cumsum([0, *map(len, raw[: len(together)])])
        reach = np.cumsum([0, *map(self.bytes_a_length.__getitem__, first)])
        bounds = np.searchsorted(reach, ends)
        if (reach[np.minimum(bounds, len(first))] != ends).any():
            each_a = [x.ids for x in self.a.encode_batch_fast(together, add_special_tokens=False)]
        else:
            bounds = bounds.tolist()
            each_a = [first[i:j] for i, j in zip(bounds, bounds[1:])]
        each_a += [x.ids for x in ids[1:]]
        each_b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        return dict(zip(pieces, map(self.groups, each_a, each_b, raw)))

    def align(self, texts: list[str]) -> list[list[Groups]]:
        """For every text its groups in order, as those of its pieces; pieces new to the worker are encoded together."""
        cut = [None if self._uncut(text) else f" {text}".replace(" ", "\0 ").split("\0")[1:] for text in texts]
        cache = self.cache
        missing = {p for pieces in cut if pieces for p in pieces if p not in cache}
        odd = {p for p in missing if p == " " or SPACE in p}
        fresh = dict.fromkeys(odd)
        if missing - odd:
            fresh |= self._fresh(list(missing - odd))
        out = []
        for text, pieces in zip(texts, cut):
            if not text:
                out.append([NOTHING])
            elif pieces is None:
                out.append([self.whole(text)])
            else:
                found = [cache[p] if p in cache else fresh[p] for p in pieces]
                # A piece that does not come back has another meaning, or none, inside the whole text.
                out.append([self.whole(text)] if None in found else found)
        room = CACHE_ENTRIES - len(cache)
        if room > 0:
            keep = [p for p in missing if fresh[p] is not None and len(p) <= LONGEST_CACHED][:room]
            cache.update((p, fresh[p]) for p in keep)
        return out

    def _uncut(self, text: str) -> bool:
        return not text or not self.cut_at_spaces or "\0" in text or RUN.search(" " + text) is not None


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for these files; loaded once per Python worker."""
    state = worker_state()
    key = ("aligner", path_a, path_b)
    if key not in state:
        state[key] = Aligner(path_a, path_b)
    return state[key]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document: its counts, the digest of its groups, its regular A ids and its other links."""

    def run(batches):
        worker = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                n_a, n_b, n_groups, digests, same, pairs = [], [], [], [], [], []
                for found in worker.align([text or "" for text in part.column(2).to_pylist()]):
                    texts, a, b, groups, regular, other = zip(*found)
                    n_a.append(sum(a))
                    n_b.append(sum(b))
                    n_groups.append(sum(groups))
                    digests.append(hashlib.sha256(b";".join(texts)).hexdigest() if n_a[-1] else "")
                    same.append(b"".join(regular))
                    pairs.append(b"".join(other))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)],
                        pa.array(digests, pa.string()), _lists(same, pa.int32(), 4), _lists(pairs, pa.int64(), 8),
                    ],
                    names=[c.split()[0] for c in ALIGNED.split(", ")],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, ALIGNED)


def _lists(rows: list[bytes], kind: pa.DataType, width: int) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(r) // width for r in rows]]).astype(np.int32)
    values = pa.Array.from_buffers(kind, int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, from 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def same_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How often every A id stands in a regular group, over all documents; as long as A's vocabulary."""

    def run(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(_flat(batch.column(0))[0], minlength=size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["a", "n"])

    rows = aligned.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for row in rows:  # bounded by the vocabulary
        out[row["a"]] = row["n"]
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n) of the links of all irregular groups."""

    def run(batches):
        for batch in batches:
            pairs, n = np.unique(_flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Adds n_links, n_best and count_sum to the rows of a table that ``align`` made and that lies in the shared folder."""
    worker = aligner(path_a, path_b)
    size_b, identity = worker.size_b, worker.mapped
    span = len(worker.bytes_a) * size_b  # no pair's code reaches it
    same = same_counts(aligned, len(worker.bytes_a))
    counted = stage_table(pair_counts(aligned))
    best = np.zeros(size_b, np.int64)
    mapped = identity >= 0
    np.maximum.at(best, identity[mapped], same[mapped])
    for row in counted.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).collect():  # bounded by the vocabulary
        best[row["b"]] = max(best[row["b"]], row["n"])
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = sorted((r["pair"], r["n"]) for r in counted.where(F.col("n") * HOT_PAIRS > total).collect())  # at most HOT_PAIRS
    hot_pair, hot_n = (np.array([h[i] for h in hot], np.int64) for i in (0, 1))

    def run(batches):
        for batch in batches:
            out = [batch.column(i) for i in range(5)]
            ids, ends = _flat(batch.column(6))
            pairs, pair_ends = _flat(batch.column(7))
            n = same[ids]
            found = np.searchsorted(hot_pair, pairs)
            known = np.zeros(len(pairs), np.int64)
            if len(hot_pair):
                found = np.minimum(found, len(hot_pair) - 1)
                known = np.where(hot_pair[found] == pairs, hot_n[found], 0)
            sums = _sums(n, ends) + _sums(known, pair_ends)
            highest = _sums(n == best[identity[ids]], ends) + _sums((known > 0) & (known == best[pairs % size_b]), pair_ends)
            links = np.diff(ends) + np.diff(pair_ends)
            # The other pairs of a document, each once with its number.
            place = np.repeat(np.arange(batch.num_rows), np.diff(pair_ends))[known == 0]
            cold, times = np.unique(place * span + pairs[known == 0], return_counts=True)
            cold_ends = np.searchsorted(cold, span * np.arange(batch.num_rows + 1)).astype(np.int32)
            listed = pa.StructArray.from_arrays([pa.array(cold % span, pa.int64()), pa.array(times, pa.int64())], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*out, *[pa.array(x, pa.int64()) for x in (links, highest, sums)], batch.column(5), pa.ListArray.from_arrays(pa.array(cold_ends), listed)],
                names=columns,
            )

    columns = [c.split()[0] for c in SCORED.split(", ")]
    scored = stage_table(aligned.mapInArrow(run, SCORED))
    limits = aligned.sparkSession.createDataFrame(list(enumerate(best.tolist())), "b int, highest long")  # a row per id of B
    rare = counted.where(F.col("n") * HOT_PAIRS <= total).withColumn("b", (F.col("pair") % size_b).cast("int"))
    rare = rare.join(F.broadcast(limits), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("top"))
    spread = scored.select("_row", F.inline("cold")).join(rare, "pair").groupBy("_row")
    added = spread.agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("_best"))
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return scored.join(added, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256"
    )


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Texts that are null, empty, or that either encoding does not give back byte by byte have no tokens:
    zeros and an empty digest. Repeated rows count each for itself; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    return score(stage_table(align(docs, path_a, path_b)), path_a, path_b)
