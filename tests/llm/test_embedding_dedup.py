import math

import numpy as np
import pytest

from prosemill.llm import embedding_dedup


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(partitions)


def unit(v):
    v = np.array(v, float)
    v = v / 2.0 ** math.frexp(np.abs(v).max())[1]
    return v / np.sqrt(v @ v)


def brute(rows, threshold=0.98):
    able = {k: unit(v) for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in able.items():
        for b, y in able.items():
            n = min(len(x), len(y))
            if a < b and rows[a][2] == rows[b][2] and x[:n] @ y[:n] >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, links[k], least.get(find(k)), i is not None and i == least.get(find(k)))) for k, (i, _, _) in enumerate(rows))


def result(frame):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    rows, far = [], list(rng.normal(size=(12, 24)))
    for i in range(500):
        v = far[i % 12] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.14, 0.2, 1.0])
        rows.append((i, [float(x) for x in v], int(i % 3) if i % 40 else None))
    rows += [(600 + i, rows[5][1], 2) for i in range(80)]  # copies
    rows += [(700 + i, [x * 4.0 for x in rows[5][1]], 2) for i in range(3)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 24, 1), (803, [1.0] * 23 + [None], 1), (804, [math.nan] * 24, 1), (805, [math.inf] * 24, 1)]
    rows += [(None, rows[8][1], 2), (None, rows[9][1], None), (9, rows[9][1], 0), (9, rows[10][1], 0), (9, rows[10][1], 0)]
    rows += [(810, [x * 1e300 for x in rows[4][1]], 1), (811, [x * 1e-300 for x in rows[4][1]], 1), (812, rows[4][1] + [0.0, 0.001], 1)]
    return rows


@pytest.mark.parametrize("block", [2048, 9])
def test_against_brute_force(spark, rows, block):
    assert result(embedding_dedup.near_vectors(table(spark, rows), block=block)) == brute(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.999])
def test_other_thresholds(spark, rows, threshold):
    assert result(embedding_dedup.near_vectors(table(spark, rows), threshold, 41)) == brute(rows, threshold)


def test_bounds_hold():
    """A pair told for certain is on that side; pairs near the threshold are left open."""
    rng = np.random.default_rng(8)
    for dims in (1, 3, 64, 2500):
        x = rng.normal(size=(200, dims)) * 10.0 ** rng.integers(-3, 3, size=(200, dims))
        y = x + rng.normal(size=x.shape) * 0.15 * np.abs(x)
        x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
        true = x @ y.T
        a, b = embedding_dedup.quantised(x), embedding_dedup.quantised(y)
        assert (embedding_dedup.products(a[0], b[0]) == a[0].astype(int) @ b[0].astype(int).T).all()
        for threshold in (0.5, 0.9, 0.98, float(np.median(true.diagonal()))):
            sure, open_ = embedding_dedup.bounds(a, b, threshold)
            assert (true[sure] >= threshold).all() and (true[~sure & ~open_] < threshold).all()


def test_pairs_near_the_threshold(spark):
    """Angles a hair above and below: rounding to int8 cannot tell them."""
    rows = []
    for i, step in enumerate((-1e-3, -1e-6, -1e-11, 1e-11, 1e-6, 1e-3)):
        angle = math.acos(0.98) + step
        rows += [(10 * i, [1.0, 0.0, 0.3], i), (10 * i + 1, [math.cos(angle) * math.sqrt(1.09), math.sin(angle) * math.sqrt(1.09), 0.0], i)]
        u = unit([1.0, 0.0, 0.3])
        w = unit([-0.3, 0.0, 1.0])
        rows[-1] = (10 * i + 1, [float(x) for x in math.cos(angle) * u + math.sin(angle) * w], i)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(table(spark, rows)).collect()}
    assert [got[10 * i] for i in range(6)] == [1, 1, 1, 0, 0, 0]


def test_group_of_near_copies_sends_no_pairs(spark):
    """400 near copies of each other: their tile sends a row for each."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    rows = [(i, [float(x) for x in base + rng.normal(size=32) * 0.03], 1) for i in range(400)]
    got = embedding_dedup.near_vectors(table(spark, rows), block=64).collect()
    assert {r.component_id for r in got} == {0} and min(r.n_links for r in got) == 399
    ids, ones = np.arange(400), np.ones(400)
    a, b = np.triu_indices(400, 1)
    assert embedding_dedup._linked(ids, ones, a, b).num_rows == 400


def test_empty_tables_and_clashing_columns(spark, rows):
    assert embedding_dedup.op12_near_vectors(table(spark, rows).limit(0)).collect() == []
    assert result(embedding_dedup.op12_near_vectors(table(spark, [(1, None, 2), (2, [1.0], None)]))) == [str((1, 0, 1, True)), str((2, 0, 2, True))]
    few = rows[:60]
    odd = table(spark, few).selectExpr("*", "1 AS node", "2 AS digest", "3 AS v", "4 AS size", "5 AS n", "6 AS root", "7 AS least", "8 AS cell")
    assert result(embedding_dedup.op12_near_vectors(odd)) == brute(few)


def test_text_labels(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "a:")], "vec_id long, embedding array<float>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
