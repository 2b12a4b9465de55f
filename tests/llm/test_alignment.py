"""Token alignment against the two libraries and plain counting over whole texts."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import alignment
from tillwise.llm.tokens import byte_alphabet, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " lead", "trail ", "a  b", "a \n b", "tab\there", "naïve señor über 中文字 naïve", "it's we'll don't", "x▁y",
    "<s> </s> <unk> <0x41>", "<|endoftext|> end", "a\0b c", "🙂 🙂🙂 🙂", "1234567 89", "word " * 3000 + "end", "q" * 20000, "é \xa0 　z",
]


@pytest.fixture(scope="module")
def worker():
    return alignment.Aligner(A, B)


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    back = byte_alphabet()
    names = {i: t for t, i in a.get_vocab().items()}

    def of_piece(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        ids_a = [(i, bytes(back[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ids_b = [(i, of_piece(i)) for i in b.encode(text)]
        wanted = (" " + text).encode()
        if b"".join(x for _, x in ids_a) != wanted or b"".join(x for _, x in ids_b) != wanted:
            return []
        ends = []
        for ids in (ids_a, ids_b):
            at, out = 0, {}
            for i, x in ids:
                at += len(x)
                out[at] = i
            ends.append(out)
        cuts, out, low = sorted(ends[0].keys() & ends[1].keys()), [], 0
        for cut in cuts:
            out.append(tuple([ids[e] for e in ids if low < e <= cut] if len(wanted) < 2000 else _between(ids, low, cut) for ids in ends))
            low = cut
        return out

    return groups


def _between(ids, low, cut):
    return [ids[e] for e in range(low + 1, cut + 1) if e in ids]


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected(texts, plain):
    """All columns, counted over all texts."""
    all_groups = [plain(t) for t in texts]
    count = Counter((a[-1], b[-1]) for groups in all_groups for a, b in groups)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for groups in all_groups:
        links = [(a[-1], b[-1]) for a, b in groups]
        out.append(
            (
                sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                hashlib.sha256(written(groups).encode()).hexdigest() if groups else "",
            )
        )
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, rows, schema, plain):
    found = alignment.alignment(spark.createDataFrame(rows, schema), A, B).collect()
    wanted = Counter((r[0], *x) for r, x in zip(rows, expected([r[1] for r in rows], plain)))
    assert Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in found) == wanted


def test_edge_texts(spark, plain):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (4, "again", 1), (4, "again", 1)]
    check(spark, rows, "doc_id long, text string, pair int", plain)


@pytest.mark.parametrize("hot", [1024, 3, 1])
def test_documents(spark, plain, hot, monkeypatch):
    """Few hot pairs send most links through the join; the result stays."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 5000]
    check(spark, rows, "doc_id long, text string", plain)


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abe sé.1 \n\t'中▁🙂", max_size=40))
def test_cut_pieces(worker, plain, text):
    for _ in range(3):  # fresh, seen once, cached
        (found,) = worker.align([text])
        assert ";".join(g.text.decode() for g in found if g.n_a) == written(plain(text))


def test_identity_map(worker):
    mapped = [(a, b) for a, b in enumerate(worker.identity) if b >= 0]
    assert len(mapped) > 10_000
    assert all(worker.bytes_a[a] == worker.bytes_b[b] for a, b in mapped)
