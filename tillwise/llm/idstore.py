"""Token-id files with Elias-Fano document boundaries.

A shard is two files: ``.ids``, the concatenated ids of its documents (two bytes
each while the vocabulary allows, else four), and ``.ef``, the header, the documents'
ids and the end positions, both as Elias-Fano sequences: low bits packed, high bits
in unary, and a sample of set-bit positions for select.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import new_folder, running_sum, stage_table
from tillwise.llm.tokens import encoder

SAMPLE = 256
MAGIC = b"TWEF"
CHUNK = 1 << 16
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
MANIFEST = "shard long, folder string, n_docs long, n_ids long"


@dataclass
class EliasFano:
    """A non-decreasing sequence of n whole numbers below 2^63."""

    n: int
    low_bits: int
    low: np.ndarray  # packed, uint8
    high: np.ndarray  # packed, uint8, least significant bit first
    samples: np.ndarray  # position of every SAMPLE-th set bit, uint64 only while it is needed

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        parts = []
        for i in range(0, n, CHUNK):  # chunks of a multiple of 8 rows end on whole bytes
            low = values[i : i + CHUNK, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            parts.append(np.packbits(low.astype(np.uint8).ravel(), bitorder="little"))
        marks = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(marks[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, marks // 8, (1 << (marks % 8)).astype(np.uint8))
        low = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        kind = np.uint32 if not n or marks[-1] < 1 << 32 else np.uint64
        return cls(n, bits, low, high, marks[::SAMPLE].astype(kind))

    def _low(self, start: int, stop: int) -> np.ndarray:
        first = start * self.low_bits
        last = stop * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        powers = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(stop - start, self.low_bits).astype(np.uint64) @ powers

    def select(self, i: int) -> int:
        """Value i, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        need = i % SAMPLE
        byte, first = at // 8, self.high[at // 8] >> (at % 8) << (at % 8) & 0xFF
        seen = 0
        while seen + (here := int(BIT_COUNT[first])) <= need:
            seen += here
            byte += 1
            first = self.high[byte]
        bits = np.flatnonzero(np.unpackbits(np.array([first], np.uint8), bitorder="little"))
        mark = 8 * byte + int(bits[need - seen])
        return (mark - i << self.low_bits) | int(self._low(i, i + 1)[0])

    def chunks(self):
        """All values in order, a bounded number at a time."""
        done, width = 0, 1 << 16
        for byte in range(0, len(self.high), width):
            marks = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little")) + 8 * byte
            for i in range(0, len(marks), CHUNK):
                part = marks[i : i + CHUNK]
                order = np.arange(done, done + len(part))
                yield ((part - order).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(done, done + len(part))
                done += len(part)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBBQQQ", self.n, self.low_bits, self.samples.itemsize, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, stream) -> EliasFano:
        head = struct.calcsize("<QBBQQQ")
        n, bits, width, n_low, n_high, n_samples = struct.unpack("<QBBQQQ", stream.read(head))
        low = np.frombuffer(stream.read(n_low), np.uint8)
        high = np.frombuffer(stream.read(n_high), np.uint8)
        return cls(n, bits, low, high, np.frombuffer(stream.read(width * n_samples), f"<u{width}"))


def _files(folder: str):
    """(filesystem, folder inside it) of a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _name(shard: int) -> str:
    return f"shard-{shard:06d}"


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode all documents in ascending doc_id order into shards; returns their manifest.

    Each task writes one shard under a name of its own and then renames it, so a
    task that runs again replaces its files with the same bytes. Rows with a null doc_id
    come first; null texts are empty; repeated rows are written each for itself; rows of
    one id are ordered by a hash of their text and may fill several shards.
    """
    folder = folder or new_folder(docs)
    _, inside = _files(folder)

    def shard(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        worker = encoder(vocabulary)
        kind = "<u2" if worker.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        files, _ = _files(folder)
        files.create_dir(inside, recursive=True)
        base, mine = f"{inside}/{_name(number)}", f".{context.taskAttemptId()}.tmp"
        ids, ends, total = [], [], 0
        with files.open_output_stream(f"{base}.ids{mine}") as out:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(worker.encode(text.as_py() or "") + end, "<u4")
                    total += len(part)
                    ids.append(doc)
                    ends.append(total)
                    out.write(part.astype(kind).tobytes())
        nulls = sum(i is None for i in ids)
        least = ids[nulls] if nulls < len(ids) else 0
        head = MAGIC + struct.pack("<BQq", np.dtype(kind).itemsize, nulls, least)
        offsets = np.array([i - least for i in ids[nulls:]], np.uint64)
        with files.open_output_stream(f"{base}.ef{mine}") as out:
            out.write(head + EliasFano.encode(np.array(ends, np.uint64)).to_bytes() + EliasFano.encode(offsets).to_bytes())
        for kind_of in (".ids", ".ef"):
            files.move(f"{base}{kind_of}{mine}", f"{base}{kind_of}")
        if ids:
            yield pa.RecordBatch.from_pydict({"shard": [number], "folder": [folder], "n_docs": [len(ids)], "n_ids": [total]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Rows of one id may lie in several shards: ranges cut them by a hash of the text, which needs no text in the sample.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return stage_table(ordered.mapInArrow(shard, MANIFEST))


class Shard:
    """Reads one shard: boundaries by select, ids by slices of the file."""

    def __init__(self, folder: str, number: int):
        self.files, inside = _files(folder)
        self.base = f"{inside}/{_name(number)}"
        with self.files.open_input_stream(f"{self.base}.ef") as stream:
            body = io.BytesIO(stream.read())
        if body.read(4) != MAGIC:
            raise ValueError(f"{self.base}.ef is not a boundary file")
        self.width, self.nulls, self.least = struct.unpack("<BQq", body.read(17))
        self.ends = EliasFano.read(body)
        self.names = EliasFano.read(body)

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, stop = self.bounds(i)
        with self.files.open_input_file(f"{self.base}.ids") as file:
            return np.frombuffer(file.read_at(self.width * (stop - start), self.width * start), f"<u{self.width}").astype("<u4")

    def documents(self):
        """(doc_id, start, ids) of all documents in order; the file is read forward once."""

        def names():
            yield from (None for _ in range(self.nulls))
            for part in self.names.chunks():
                yield from (self.least + int(x) for x in part)

        name, start = names(), 0
        with self.files.open_input_stream(f"{self.base}.ids", buffer_size=1 << 20) as stream:
            for part in self.ends.chunks():
                for stop in part.tolist():
                    ids = np.frombuffer(stream.read(self.width * (stop - start)), f"<u{self.width}").astype("<u4")
                    yield next(name), start, ids
                    start = stop


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 of every document, from the files."""

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for doc, start, ids in Shard(row["folder"], row["shard"]).documents():
                    rows.append((doc, row["before"] + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=columns)

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # A row per shard: their running sum is a window over as many rows as there are files.
    starts = running_sum(manifest.withColumn("all", F.lit(0)), ["all"], "shard", [F.col("shard")], "n_ids", "before")
    spread = starts.select("shard", "folder", "before").repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(digest, ", ".join(f"{c} long" for c in columns))
