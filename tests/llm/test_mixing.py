import random

import pytest
from helpers import docs_table, empty_table, prose, words

from prosemill.llm import mixing


def corpus(n=300):
    rng = random.Random(1)
    return [(i, prose(rng, rng.randrange(1, 80)), ["b", "a", None, "c"][rng.randrange(4)]) for i in range(n)]


def targets(sizes, percent=150, weights=(3, 1, 2), cap=2):
    """Share by weight, cap, and share the excess again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), sum(sizes.values()) * percent / 100, set(order)
    while left > 1e-9 and open_:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in sorted(open_, key=str):
            out[s] += share * weight[s] / total
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_.discard(s)
    return out


def test_digest(spark):
    rows = corpus()
    got = mixing.op1_mix(docs_table(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    text = {r[0]: (len(words(r[1])), r[2]) for r in rows}
    sizes = {}
    for n, s in text.values():
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    for r in got:
        n, s = text[r.doc_id]
        assert (r["size"], r.source_size, r.source) == (n, sizes[s], s)
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, n, 2 * n)
    for s in sizes:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(want[s], abs=80)


def test_reruns_and_partitions_agree(spark):
    rows = corpus()
    runs = [sorted((r.doc_id, r.taken) for r in mixing.op1_mix(docs_table(spark, rows, p)).collect()) for p in (1, 7)]
    assert runs[0] == runs[1]


def test_tree_of_many_groups(spark):
    got = mixing.copies(docs_table(spark, corpus()), group_units=3).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] * (r.m * r.copies + r.more) for r in mine) == pytest.approx(mine[0].target, abs=80)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y", "a"), (3, "x y", "a"), (None, "p q r", None), (4, " \t\n", "b")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in mixing.op1_mix(docs_table(spark, rows)).collect()))
    assert [g[2] for g in got] == [0, 0, 2, 2, 0, 3]
    assert abs(got[2][3] - got[3][3]) <= 2
    assert all(g[3] <= 2 * g[2] for g in got)
    assert mixing.op1_mix(empty_table(spark)).collect() == []


def test_stage_repeats_rows(spark):
    rows = corpus(60)
    docs = docs_table(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.op1_mix(docs).collect()}
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {d: t for d, t in taken.items() if t}


def test_pivot_keeps_words():
    rng = mixing._draws("t")
    p, size = [0.3] * 50, list(range(60, 10, -1))
    out = mixing.pivot(p, size, rng, False)
    assert sum(0 < x < 1 for x in out) <= 1
    assert sum(a * b for a, b in zip(out, size)) == pytest.approx(0.3 * sum(size))
    assert set(mixing.pivot(p, size, rng, True)) <= {0.0, 1.0}


def test_expected_copies_are_the_rate(spark):
    """Over many seeds, a document's mean copies are its source's target over its size."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(24)]
    docs, total, runs = docs_table(spark, rows, 1), {}, 40
    for seed in range(runs):
        got = mixing.copies(docs, seed=seed, group_units=5).collect()
        rate = {r.doc_id: r.target / r.source_size for r in got}
        for r in got:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies + r.more
    off = [total[d] / runs - rate[d] for d in rate]
    assert max(map(abs, off)) < 0.33 and abs(sum(off) / len(off)) < 0.05


def test_a_row_that_repeats_often_does_not_move_its_source(spark):
    rows = corpus(200) + [(1000, "a b c d e f g h", "a")] * 300
    got = mixing.op1_mix(docs_table(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=90)
        assert all(r.taken <= 2 * r["size"] for r in mine)
    docs = docs_table(spark, rows)
    assert sum(len(words(r.text)) for r in mixing.mix_stage(docs).collect()) == sum(r.taken for r in got)


def test_clashing_columns_and_long_text(spark):
    rows = corpus(40) + [(900, "long " * 700_000, "b")]
    docs = docs_table(spark, rows).selectExpr("*", "7 AS _size", "8 AS _each", "9 AS _d", "10 AS size", "11 AS copies", "12 AS m", "13 AS place", "14 AS d")
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select("_size", "_each", "_d", "size", "copies", "m", "place", "d").collect()} == {(7, 8, 9, 10, 11, 12, 13, 14)}
    assert mixing.mix_stage(empty_table(spark)).collect() == []


def test_sources_come_near_their_targets(spark, sf_dir):
    """Sources of fifty documents: none is off by a fiftieth of its target, and most by far less."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "source")
    for seed in (mixing.SEED, 1):
        off, got = [], mixing.copies(docs, seed=seed).collect()
        for s in {r.source for r in got}:
            mine = [r for r in got if r.source == s]
            off.append(abs(sum(r["size"] * (r.m * r.copies + r.more) for r in mine) / mine[0].target - 1))
        assert max(off) < 0.02 and sum(off) / len(off) < 0.003


def test_parameters(spark):
    rows = corpus(200)
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(text))
    for percent, weights, cap in ((50, (3, 1, 2), 2), (250, (1, 1, 1), 3), (20, (5, 1), 1)):
        got = mixing.copies(docs_table(spark, rows), percent, weights, cap).collect()
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
        level = None
        low, high = 0.0, 1e9
        for _ in range(200):  # the level at which the capped shares make up the budget
            level = (low + high) / 2
            if sum(min(cap * sizes[s], share[s] * level) for s in order) < sum(sizes.values()) * percent / 100:
                low = level
            else:
                high = level
        for r in got:
            assert r.target == pytest.approx(min(cap * sizes[r.source], share[r.source] * level), rel=1e-6)
            assert r.m * r.copies + r.more <= cap * r.m
        for s in order:
            mine = [r for r in got if r.source == s]
            assert sum(r["size"] * (r.m * r.copies + r.more) for r in mine) == pytest.approx(mine[0].target, abs=10)
