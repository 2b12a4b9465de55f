"""The corpus pipeline's stages on a small corpus, and its last table read back into texts."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tillwise.llm import packing
from tillwise.llm.shared import stage_table
from tillwise.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The written result of every stage, by name, from the documents on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF))
        out[name] = docs
    return out


def test_stages_keep_the_columns_and_only_lose_rows(stages):
    names = stages["documents"].columns
    before = None
    for name in ("documents", "toxicity", "line_dedup", "near_dedup"):
        rows = stages[name].collect()
        assert stages[name].columns == names
        ids = {r["doc_id"] for r in rows}
        assert before is None or ids <= before
        before = ids
    assert stages["source_mix"].columns == names
    assert {r["doc_id"] for r in stages["source_mix"].collect()} <= before


def test_line_dedup_only_drops_lines(stages):
    texts = {r["doc_id"]: r["text"] for r in stages["toxicity"].collect()}
    seen = []
    for r in stages["line_dedup"].orderBy("doc_id").collect():
        lines = (r["text"] or "").split("\n")
        rest = iter((texts[r["doc_id"]] or "").split("\n"))
        assert all(line in rest for line in lines if r["text"])  # the kept lines, in their order
        assert r["n_chars"] == len(r["text"] or "")
        seen += [line for line in lines if line.strip()]
    assert len(seen) == len(set(seen))  # no line stands twice


def test_packed_sequences_give_back_every_text(stages):
    """Every copy that the mix made can be read from the sequences of the last table alone."""
    packed = stages["packing"]
    bodies = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.sequences(packed).collect()}
    texts = {}
    for r in sorted(packed.collect(), key=lambda r: r["start"]):
        texts.setdefault((r["doc_id"], r["row_id"]), []).extend(bodies[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]])
    tokenizer = Tokenizer.from_file(vocabulary())
    wanted = sorted((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in stages["source_mix"].collect())
    assert sorted((doc, ids) for (doc, _), ids in texts.items()) == wanted
    assert all(len(b) <= 2048 for b in bodies.values())


def test_run_equals_its_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids"]
    found = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*columns).collect()))
    assert found == sorted(map(tuple, stages["packing"].select(*columns).collect()))
