import math

import numpy as np
from pyspark.sql import functions as F

from prosemill.llm import topk_search


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(good, key=lambda r: tuple(-r[1])) if i % 50 == 0}.items():
        best = sorted(((-int(np.dot(a[: len(b)], b[: len(a)])), i) for i, b in good if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=40) / 3], 0) for i in range(230)]
    rows += [(300 + i, rows[7][1], 1) for i in range(9)] + [(400, None, 0), (401, [0.1, None], 0), (402, [float("nan")] * 40, 0), (403, [float("inf")] * 40, 0), (None, [0.5] * 40, 0)]
    got = {tuple(r) for r in topk_search.op3_topk(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_small_blocks_and_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 25, [float(x) for x in rng.normal(size=20)], 0) for i in range(60)]
    vectors = table(spark, rows).select("vec_id", topk_search.integers("embedding").alias("v"))
    got = {tuple(r) for r in topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, query_block=7, candidate_block=11).collect()}
    assert got == brute(rows)
    few = [(0, [1.0, 2.0], 0), (1, [0.5, 0.25], 0)]
    assert {tuple(r) for r in topk_search.op3_topk(table(spark, few)).collect()} == brute(few)
    assert topk_search.op3_topk(table(spark, few).limit(0)).collect() == []


def test_repeated_and_other_lengths(spark):
    rows = [(50, [1.0, 1.0], 0), (1, [0.5], 0), (1, [0.5], 0), (2, [0.25, 0.25, 9.0], 0), (3, [], 0)]
    assert [(r.rank, r.vec_id, r.score) for r in topk_search.op3_topk(table(spark, rows)).orderBy("rank").collect()] == [(1, 1, 32768), (2, 1, 32768), (3, 2, 32768), (4, 3, 0)]


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 10.0 ** rng.integers(0, 8)], 0) for i in range(120)]
    rows += [(200, [1048577.0 / 256] * 3, 0), (201, [2.0**22 + 0.5] + [0.0] * 5, 0), (250, [2.0**22, 1.0 / 256, 0.0, 0.0, 0.0, 0.0], 0)]

    def exact(rows, k=5):
        ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
        out = set()
        for q in (i for i in ints if i % 50 == 0):
            best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            out |= {(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)}
        return out

    assert {tuple(r) for r in topk_search.op3_topk(table(spark, rows)).collect()} == exact(rows)
    wild = [(i, [float(np.float32(x * 10.0 ** rng.integers(10, 38))) for x in rng.normal(size=3)], 0) for i in range(60)] + [(100, [3e17, 3e17, 0.0], 0), (101, [-3e17, -3e17, 1.0], 0)]
    vectors = table(spark, wild).select("vec_id", topk_search.integers("embedding").alias("v"))
    got = {tuple(r) for r in topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, query_block=1, candidate_block=9).collect()}
    assert got == exact(wild)


def test_clashing_columns_and_ties(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(120)]
    frame = table(spark, rows).selectExpr("*", "1 AS v", "2 AS length", "3 AS qb", "4 AS rank", "5 AS least")
    assert {tuple(r) for r in topk_search.op3_topk(frame).collect()} == brute(rows)


def test_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=20_000)], 0) for i in range(60)]
    assert {tuple(r) for r in topk_search.op3_topk(table(spark, rows)).collect()} == brute(rows)
