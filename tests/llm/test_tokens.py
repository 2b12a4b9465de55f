"""Token encoding, packing and the id store against the library and plain loops."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import idstore, packing
from tillwise.llm.tokens import RARE_WHITE, Encoder, vocabulary

PATH = vocabulary()
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\nx", "it's we'll  don't", "tab\there", "é ñ ß 中文 字", "x  y",
    "\x1c y", "a\0b c", "<|endoftext|> end", "end <|endoftext|>", "A " * 5000, "q" * 30000, "1 22 333\n4444 55555", "🙂 🙂🙂 🙂",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i * 7 - 30, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (5, "same", "x"), (5, "same", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoder_matches_library(plain):
    encoder = Encoder(PATH)
    for _ in range(2):  # the second time from the cache
        for text in TEXTS:
            assert ids_of(encoder.encode(text or "")) == plain(text), repr(text)[:40]


ENCODER = Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sé.1 \n\t\r  中", max_size=30))
def test_encoder_any_white_space(text):
    assert ids_of(ENCODER.encode(text)) == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def test_rare_white_space_is_all_but_spaces_and_line_ends():
    white = {chr(i) for i in range(0x110000) if re.match(r"\s", chr(i))}
    assert {c for c in white if RARE_WHITE.match(c)} == white - {" ", "\n"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé ß \nжΩ中'.,!?;:-7", max_size=40))
def test_encoder_letters_and_punctuation(text):
    for _ in range(2):
        assert ids_of(ENCODER.encode(text)) == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 2047, 2048, 2049, 2080, 6500])
def test_cuts(n):
    parts = packing.cuts(n)
    assert [a for a, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
    assert sum(x for _, x in parts) == n and all(0 < x <= 2048 for _, x in parts)


def test_least_squares():
    rng = np.random.default_rng(0)
    a = rng.random((8, 20))
    x = packing.nonnegative_least_squares(a, y := rng.random(8) * 5)
    gradient = a.T @ (a @ x - y)
    assert (x >= 0).all() and (gradient > -1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    histogram = {n: rng.randrange(40) for n in [*range(1, 32), *range(32, 2049, 32)]}
    patterns = packing.plan(histogram)
    used = {}
    for p in patterns:
        assert sum(n * k for n, k in p.parts) <= 2048
        for n, k in p.parts:
            used[n] = used.get(n, 0) + k * p.times
    assert used == {n: c for n, c in histogram.items() if c}
    tokens = sum(n * c for n, c in histogram.items())
    assert sum(p.times for p in patterns) <= tokens / 2048 * 1.05 + 1


def check_packed(rows, expected):
    """rows: dicts of the query; expected: [(doc_id, ids with the end id)]."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    want = sorted(
        ((d is None, d or 0, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids)) for d, ids in expected for a, n in packing.cuts(len(ids)))
    )
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert got == want


def test_pack_round_trip(frame, plain):
    packed = packing.pack(frame, PATH).cache()
    check_packed([r.asDict() for r in packing.digest(packed).collect()], [(r["doc_id"], plain(r["text"]) + [1]) for r in frame.collect()])
    rebuilt = rebuild(packed)
    assert sorted(rebuilt, key=repr) == sorted(((r["doc_id"], plain(r["text"]) + [1]) for r in frame.collect()), key=repr)


def rebuild(packed):
    """(doc_id, ids) of every packed row, read from the sequences alone."""
    bodies = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.sequences(packed).collect()}
    out = {}
    for r in sorted(packed.collect(), key=lambda r: r["start"]):
        ids = out.setdefault((r["doc_id"], r["row_id"]), [])
        assert len(ids) == r["start"]
        ids += bodies[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert len(ids) <= r["doc_tokens"]
    return [(doc, ids) for (doc, _), ids in out.items()]


def test_pack_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in packing.digest(packing.pack(docs, PATH)).collect()]
    check_packed(rows, [(r["doc_id"], plain(r["text"]) + [1]) for r in docs.collect()])
    sequences = len({r["sequence_id"] for r in rows})
    assert sequences <= sum(r["length"] for r in rows) / 2048 * 1.02 + 2


def test_one_id_on_most_rows_fills_several_shards(spark, plain):
    rows = [(7, f"text number {i} " + "again " * (i % 50)) for i in range(600)] + [(3, "first"), (9, "last"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is far below a task's usual size
    manifest = idstore.write(docs, PATH)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.count() > 2 and manifest.agg({"n_docs": "max"}).first()[0] < 400
    found = idstore.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 3, *[7] * 600, 9]
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
    assert sorted(r["ids_crc32"] for r in found) == sorted(zlib.crc32(np.array(plain(t) + [0], "<u4").tobytes()) for _, t in rows)


def test_empty_tables(spark, frame):
    none = frame.limit(0)
    assert packing.pack(none, PATH).count() == 0
    assert idstore.read(idstore.write(none, PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.integers(0, 3))
def test_elias_fano(values, tight):
    values = sorted(v >> (10 * tight) for v in values)
    import io

    sequence = idstore.EliasFano.read(io.BytesIO(idstore.EliasFano.encode(np.array(values, np.uint64)).to_bytes()))
    assert [int(x) for part in sequence.chunks() for x in part] == values
    assert [sequence.select(i) for i in range(len(values))] == values


def test_elias_fano_long():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 33, 200_000)).astype(np.uint64)
    sequence = idstore.EliasFano.encode(values)
    assert np.array_equal(np.concatenate(list(sequence.chunks())), values)
    assert all(sequence.select(i) == values[i] for i in range(0, 200_000, 7919))
    assert len(sequence.to_bytes()) < 200_000 * (2 + sequence.low_bits + 0.5) / 8 + 1000


def test_store_round_trip(frame, plain):
    manifest = idstore.write(frame, PATH)
    rows = idstore.read(manifest).orderBy("start").collect()
    docs = sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    digest = lambda d: zlib.crc32(np.array(plain(d["text"]) + [0], "<u4").tobytes())
    of = {}
    for d in docs:
        of.setdefault((d["doc_id"], digest(d)), []).append(d)
    docs = [of[r["doc_id"], r["ids_crc32"]].pop() for r in rows]  # rows of one id stand in any order
    assert [r["doc_id"] for r in rows] == sorted([d["doc_id"] for d in docs], key=lambda i: (i is not None, i or 0))
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = plain(d["text"]) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d["doc_id"], at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    m = manifest.orderBy("shard").first()
    shard = idstore.Shard(m["folder"], m["shard"])
    assert shard.document(len(shard) - 1).tolist() == plain(docs[len(shard) - 1]["text"]) + [0]
    assert shard.doc_id(len(shard) - 1) == docs[len(shard) - 1]["doc_id"]
