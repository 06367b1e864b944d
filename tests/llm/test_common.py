import random

import numpy as np
import pyarrow as pa

from prosemill.llm import common


def test_join_small_without_a_broadcast(spark, monkeypatch):
    """Beyond the bound both sides are salted: the same rows, null keys too."""
    left = spark.createDataFrame([(i, i % 4 if i % 5 else None) for i in range(200)], "i long, k long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, common.join_small(left, right, ["k"], how).collect()))
        monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
        assert sorted(map(str, common.join_small(left, right, ["k"], how).select("i", "k", "v").collect())) == want
        monkeypatch.undo()


def test_join_split(spark):
    left = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(300)], "i long, k long")
    counted = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    for rows in (300, 10**6):
        assert {(r.i, r.v) for r in common.join_split(left, counted, ["k"], rows).collect()} == {(i, 2 * (i % 7 if i % 3 else 0)) for i in range(300)}


def test_words_of_very_long_texts(monkeypatch):
    """Texts cut into stretches have the same words, also where one word is many stretches long."""
    rng = random.Random(1)
    for text in ("x" * 900, " " * 300 + "x" * 900 + " yy ", " ".join("z" * rng.choice([1, 3, 70, 400]) for _ in range(60)), " " * 700, "a" * 31 + " " + "b" * 500):
        data, offs = common.text_bytes(pa.array([text]))
        want = common.word_spans(data, offs)
        monkeypatch.setattr(common, "SLICE_BYTES", 32)
        got = common.word_spans(data, offs)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(got, want)) and len(want[0]) == len(text.split())


def test_hashes_of_long_spans(monkeypatch):
    """Longer than a slice, a span's hash still depends on its bytes alone."""
    monkeypatch.setattr(common, "SLICE_BYTES", 16)
    data, _ = common.text_bytes(pa.array(["0123456789" * 9 + "-" + "0123456789" * 9 + "0123456789" * 8 + "012345678x"]))
    s, e = np.array([0, 91, 181]), np.array([90, 181, 271])
    a, b, c = common.hash_spans(data, s, e)
    assert a == b != c


def test_a_worker_gives_memory_back(monkeypatch):
    """After the last batch of a task, and after large groups, by key or not; results as they are."""
    said = []
    monkeypatch.setattr(common, "release", lambda: said.append("released"))

    def run(batches):
        for batch in batches:
            said.append(batch)
            yield batch + 1

    assert list(common.released(run)(iter([1, 2]))) == [2, 3] and said == [1, 2, "released"]
    for n, times in ((10, 0), (common.RELEASE_BYTES // 8, 1)):
        said.clear()
        table = pa.table({"x": np.zeros(n)})
        assert common.released(lambda table: table.num_rows)(table) == n and len(said) == times
        assert common.released(lambda key, table: (key, table.num_rows))((1,), table) == ((1,), n) and len(said) == 2 * times


def test_release(monkeypatch):
    """Also where the C library cannot trim."""
    common.release()
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: object())
    common.release()
