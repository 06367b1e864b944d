import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_table, empty_table, prose, shared_texts, words

from prosemill.llm import ngram_join


def grams(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=3, percent=90):
    sets = [(i, grams(x, n)) for i, x in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] == sets[b][0] or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def near(seed, n, size):
    rng = random.Random(seed)
    base = prose(rng, size).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(size)] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [shared_texts(), near(1, 40, 60), near(2, 30, 120), [(i, prose(random.Random(i % 9), 2 + i % 4, 3)) for i in range(40)]])
def test_against_brute_force(spark, rows):
    assert got(ngram_join.op9_components(docs_table(spark, rows))) == brute(rows)


def test_tiles_and_other_bounds(spark):
    rows = near(3, 60, 70)
    for tile_rows in (7, 25):
        out = ngram_join.join_components(docs_table(spark, rows), 5, 80, tile_rows=tile_rows).select("d", "n", "root")
        assert got(out) == brute(rows, 5, 80)


def test_chain_of_links_over_tiles(spark):
    """Each text is linked with the next only, so the first row of the component reaches few."""
    rng = random.Random(8)
    words_ = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    rows = [(i, " ".join(words_[i : i + 60])) for i in range(120)] + [(500 + i, " ".join(words_[300 + i // 30 :])) for i in range(60)]
    rng.shuffle(rows)
    out = ngram_join.join_components(docs_table(spark, rows), 3, 80, tile_rows=9).select("d", "n", "root")
    assert got(out) == brute(rows, 3, 80)


def test_copies_beyond_a_tile_send_each_row_once(spark):
    rows = [(i, f"{prose(random.Random(5), 60)} x{i}") for i in range(300)]
    texts = docs_table(spark, rows)
    assert {r.root for r in ngram_join.join_components(texts, tile_rows=20).collect()} == {0}


BIG = 1 << 62


def test_any_long_id(spark):
    rows = [(BIG + 7, "a b c d e"), (BIG + 8, "a b c d e"), (-5, "p q r s"), (2 * BIG - 1, "p q r s"), (-2 * BIG, "z y x"), (BIG - 1, "own words here")]
    assert got(ngram_join.op9_components(docs_table(spark, rows))) == brute(rows)
    kept = ngram_join.join_stage(docs_table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r[2] for r in brute(rows, 5, 80)})


def test_repeated_id_is_one_node_and_keeps_its_rows(spark):
    a, b, c, e = "a b c d e f", "m n o p q r", "s t u v w x", "k l j h g f"
    for rows in ([(1, a), (2, b), (5, a), (5, b)], [(5, a), (5, b), (7, b), (9, c), (9, a), (3, e), (9, e)], [(2, a), (2, a.upper()), (2, b), (8, b), (8, "")]):
        assert got(ngram_join.op9_components(docs_table(spark, rows))) == brute(rows)
    rng = random.Random(3)
    rows = [(rng.randrange(40), x) for _, x in near(6, 50, 60) + shared_texts(9, 30)]
    assert got(ngram_join.op9_components(docs_table(spark, rows))) == brute(rows)


def test_stage_with_clashing_columns(spark):
    docs = docs_table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q"), (None, None), (4, "")]).selectExpr("*", "7 AS keep", "8 AS place", "9 AS d", "10 AS _keep", "map('a', 1) AS m")
    out = ngram_join.join_stage(docs).collect()
    assert sorted(((r.doc_id, r.text, r.keep, r.place, r.d, r["_keep"]) for r in out), key=repr) == sorted([(1, "a b c d e f", 7, 8, 9, 10), (4, "", 7, 8, 9, 10), (None, None, 7, 8, 9, 10)], key=repr)
    assert ngram_join.join_stage(empty_table(spark)).collect() == []


def test_long_text(spark):
    long = " ".join(f"w{i % 5003}" for i in range(900_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "x" * 3_000_000)]
    assert [(r[0], r[2]) for r in got(ngram_join.op9_components(docs_table(spark, rows)))] == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_odd_rows(spark):
    rows = [(4, "A b C d"), (2, "a B c D"), (7, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (2, "a B c D"), (12, "two words"), (13, "two  words")]
    out = ngram_join.op9_components(docs_table(spark, rows).selectExpr("*", "1 AS d", "2 AS key"))
    assert got(out) == brute(rows)
    assert ngram_join.op9_components(empty_table(spark)).collect() == []


def test_rows_without_id(spark):
    out = ngram_join.op9_components(docs_table(spark, [(None, "x y z v"), (3, "x y z v"), (None, "p q r s"), (None, "p q r s")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == [(3, 3), (None, 3), (None, None), (None, None)]


def test_stage_keeps_one(spark):
    rows = near(4, 12, 60) + [(100 + i, prose(random.Random(i + 50), 40)) for i in range(5)]
    docs = docs_table(spark, rows)
    out = ngram_join.join_stage(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({r[2] for r in brute(rows, 5, 80)})


@pytest.mark.parametrize(("percent", "hot_share"), [(50, 100), (80, 100), (80, 3), (90, 2)])
def test_every_pair_in_reach_shares_a_first_column(spark, monkeypatch, percent, hot_share):
    """Sets that share passages and are near to each other; documents of mostly own words have no key at all."""
    monkeypatch.setattr(ngram_join, "HOT_SHARE", hot_share)
    rng = random.Random(percent)
    passages = [prose(rng, 40, 10**6) for _ in range(6)]
    rows = [(i, f"{passages[i % 6]} {passages[i % 5]} {prose(rng, rng.randrange(60), 10**6)}") for i in range(60)] + near(percent, 60, 90)
    texts = docs_table(spark, rows).select(ngram_join.node_id().alias("d"), "text")
    sets = {ngram_join.gram_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 3)[0].tobytes() for _, t in rows}
    sets = [np.frombuffer(b, np.uint64) for b in sets]
    names = {int(ngram_join._sums(ngram_join.mix64(g), np.array([0, len(g)]))[0]): set(g.tolist()) for g in sets}
    column, count = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
    hot = column[count * hot_share >= len(rows)]
    keys = {}
    for r in ngram_join.first_columns(texts, 3, percent, 10_000, hot).collect():
        keys.setdefault(r.x, set()).add(r.key)
    for a in names:
        for b in names:
            if a < b and 100 * len(names[a] & names[b]) >= percent * len(names[a] | names[b]):
                assert keys[a] & keys[b]
    assert len(keys) < len(names) or percent == 50


def test_common_passages_make_no_large_component(spark):
    """A third of each text is shared with many others, but none is near to another: no row is multiplied."""
    rng = random.Random(12)
    passages = [prose(rng, 60, 10**6) for _ in range(8)]
    rows = [(i, f"{rng.choice(passages)} {prose(rng, 100, 10**6)} {rng.choice(passages)}") for i in range(200)]
    texts = docs_table(spark, rows).select(ngram_join.node_id().alias("d"), "text")
    assert ngram_join.first_columns(texts, 5, 80, 50_000, np.empty(0, np.uint64)).count() == 0
    assert got(ngram_join.join_components(docs_table(spark, rows), 5, 80).select("d", "n", "root")) == brute(rows, 5, 80)


def test_low_bound_against_brute_force(spark):
    rng = random.Random(6)
    text = [prose(rng, 15, 9000) for _ in range(40)]
    rows = [(2 * i + k, " ".join(t.split()[: 15 if k else 10])) for i, t in enumerate(text) for k in (0, 1)]
    assert got(ngram_join.join_components(docs_table(spark, rows), 3, 60).select("d", "n", "root")) == brute(rows, 3, 60)


def test_memory_of_a_tile_and_of_a_block():
    """A product holds two squares of 4 bytes a pair and a block's cells few copies of themselves: in MB, where 8 bytes a pair took 157 and 85."""
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(900, 1100, 1700))
    gram = np.concatenate([np.sort(rng.choice(1500, k, replace=False)) for k in sizes]).astype(np.uint64)
    cells = np.sort(rng.integers(0, 1 << 62, 1_600_000).astype(np.uint64))
    none = pa.nulls(40, pa.binary())
    block = pa.table({"slice": pa.array(range(40), pa.int64()), "body": pa.array([x.tobytes() for x in np.split(cells, 40)], pa.binary()), "extra": none, "hot": none})
    peaks = []
    for run in (lambda: ngram_join.links(sizes, gram, np.append(0, np.cumsum(sizes)), 80), lambda: ngram_join._counted((pa.scalar(1),), block)):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] / (1 << 20))
        tracemalloc.stop()
    assert peaks[0] < 110 and peaks[1] < 60


def test_links_some_rows_at_a_time(monkeypatch):
    """Rows that leave the product, and any cut of it, change no link."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        sizes = np.sort(rng.integers(15, 25, n))
        sets = [set(rng.choice(26, k, replace=False).tolist()) for k in sizes]
        gram = np.concatenate([np.sort(np.array([*s], np.uint64)) for s in sets])
        root = list(range(n))
        for _ in range(n):
            root = [min(root[b] for b in range(n) if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])) for a in range(n)]
        for rows in (1, 3, 128):
            monkeypatch.setattr(ngram_join, "PRODUCT_ROWS", rows)
            assert ngram_join.links(sizes, gram, np.append(0, np.cumsum(sizes)), 70, 8).tolist() == root
