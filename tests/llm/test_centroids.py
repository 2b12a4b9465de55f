"""Integer centroid clustering against plain Python, edge vectors included."""

import hashlib
import math

from tillwise.llm import centroids


def plain(rows, clusters=8, rounds=10):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in kept[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, vs in groups.items():
            middle[k] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(
        ((i, k, d, sum(e for _, e, j in found if j == k), total, digest[k]) for i, d, k in found), key=repr
    )


def check(spark, rows, schema="vec_id long, embedding array<double>"):
    found = centroids.summed_up(*centroids.cluster(spark.createDataFrame(rows, schema)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([r[:2] for r in rows])


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(spark, rows)


def test_edge_vectors(spark):
    one, zero = [0.5] * 64, [0.0] * 64
    rows = [
        (1, one, 7), (1, one, 7), (2, zero, 7), (3, None, 7), (4, [1.0] * 63, 7), (5, [1.0] * 65, 7), (6, [], 7), (7, [None] + one[1:], 7),
        (8, [math.nan] + one[1:], 7), (9, [math.inf] + one[1:], 7), (10, [-x for x in one], 7), (11, [-0.0] * 64, 7), (None, [0.25] * 64, 7),
        (12, [-0.0001] * 64, 7), (13, [3.0] + one[1:], 7), (14, one, 7), (15, [i / 7 for i in range(64)], 7), (16, [i / 3 for i in range(64)], 7),
    ]
    check(spark, rows, "vec_id long, embedding array<double>, cluster int")


def test_fewer_vectors_than_clusters(spark):
    check(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])


def test_empty_and_useless_tables(spark):
    for rows in ([], [(1, None)]):
        assert centroids.summed_up(*centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).count() == 0


def test_ties_go_to_the_smaller_number(spark):
    rows = [(1, [0] * 64)]
    near = spark.createDataFrame(rows, "vec_id long, v array<long>").select(centroids.nearest([[1] * 64, [-1] * 64, [1] * 64]).alias("n")).first()["n"]
    assert (near["distance"], near["cluster"]) == (64, 0)


def test_huge_components_saturate(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    found = centroids.summed_up(*centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=1)).collect()
    assert {r["vec_id"]: r["distance"] for r in found} == {1: 64 << 52, 2: 64 << 52, 3: 0}
