"""The mix against its SQL twin, a plain water-filling loop and edge cases."""

import re

import duckdb
import pytest
import twins

from tillwise.llm import mixing
from tillwise.llm.oracle import ORACLE
from tillwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Shares by weight; what is above three times the size is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + size(d["text"])
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.03 * want[s] + 8, s
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted((d["doc_id"] or 0, size(d["text"])) for d in docs)


def test_twin(spark):
    assert twins.compare(QUERIES["op2_source_mix"](spark, SF), twins.connect(SF), ORACLE["op2_source_mix"]) == []


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(mixing.mix(docs)[2].collect(), docs.collect())


def test_edges(spark, tmp_path):
    rows = [(i, f"w{i} " * (i % 90), ["a", "b", "Z", None, "é"][i % 5], 1) for i in range(300)]
    rows += [(7, "same text here", "a", 1)] * 3 + [(None, "no id", "b", 1), (900, None, "empty", 1), (901, " \n\t", "empty", 1)]
    rows += [(902, "hot " * 50_000, "hot", 1), (903, "one", "tiny", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position long")
    slots, cut, taken = mixing.mix(docs)
    check(taken.collect(), docs.collect())
    # the schedule alternates: each prefix has about its share of each source
    order = [r["position"] for r in slots.orderBy("slot").collect()]
    for p in set(order):
        share = order.count(p) / len(order)
        for n in range(100, len(order), 97):
            assert abs(order[:n].count(p) - share * n) < 8
    assert mixing.mix(docs.limit(0))[2].count() == 0
    assert sorted(map(str, mixing.mix(docs.repartition(7))[2].collect())) == sorted(map(str, taken.collect()))


def test_repeated_passes_any_column_name(spark):
    rows = [(i, f"word{i} " * (5 + i), "ab"[i % 2], f"r{i}", i, -i) for i in range(40)] + [(99, None, None, "r", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, _copies int, _copy int")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(rows) and out.where("doc_id = 99").count() == 1
