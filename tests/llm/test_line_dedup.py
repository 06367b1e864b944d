import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import docs_table, empty_table, prose, words

from prosemill.llm import common, line_dedup

BLANK = " \t\r\x0b\x0c"


def brute(rows, t=3, words_=25):
    """Every run of lines of weight ``t``, of any length up to ``t``, against all earlier ones."""
    texts = sorted({(i is None, i or 0, x or "") for i, x in rows})
    solid = [[k for k, line in enumerate(x.split("\n")) if line.strip(BLANK)] for *_, x in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, (*_, x) in enumerate(texts):
        lines = x.split("\n")
        weight = [1 + len(words(lines[k])) // words_ for k in solid[d]]
        for s in range(len(solid[d])):
            for n in range(1, t + 1):
                if s + n > len(solid[d]) or sum(weight[s : s + n]) < t:
                    continue
                run = tuple(lines[k].strip(BLANK) for k in solid[d][s : s + n])
                if run in seen:
                    gone[d] |= set(range(s, s + n))
                seen.add(run)
    out = []
    for d, (none, i, x) in enumerate(texts):
        lines, drop = x.split("\n"), {solid[d][s] for s in gone[d]}
        for s in gone[d]:
            if s + 1 in gone[d]:
                drop |= set(range(solid[d][s], solid[d][s + 1]))
        kept = "\n".join(line for k, line in enumerate(lines) if k not in drop)
        row = (None if none else i, len(solid[d]), len(gone[d]), sum(s - 1 not in gone[d] for s in gone[d]), len(kept), hashlib.md5(kept.encode()).hexdigest())
        out += [row] * sum((j, y or "") == (None if none else i, x) for j, y in rows)
    return sorted(out, key=repr)


def check(spark, rows):
    assert sorted((tuple(r) for r in line_dedup.op4_lines(docs_table(spark, rows)).collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    rng = random.Random(2)
    lines = [f"line {i} é" for i in range(25)] + ["", "  ", "\t"]
    check(spark, [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 30)))) for i in range(60)])


def test_odd_rows(spark):
    run = "a\nb\r\n  c  "
    check(spark, [(5, f"x\n{run}\ny"), (2, "a\nb\nc"), (9, f"{run}\n\n{run}"), (3, None), (4, ""), (7, "\n\n"), (None, f"q\n{run}"), (2, "a\nb\nc"), (11, "one")])
    assert line_dedup.op4_lines(empty_table(spark)).collect() == []


def test_stage(spark):
    docs = docs_table(spark, [(1, "a\nb\nc\nd"), (2, "a\nb\nc"), (3, "z\na\nb\nc\nd"), (4, "keep me")])
    out = line_dedup.line_stage(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "a\nb\nc\nd", 7), (3, "z", 1), (4, "keep me", 7)]


def test_long_lines_against_brute_force(spark):
    rng = random.Random(4)
    lines = [prose(rng, n, 10**6) for n in (1, 2, 5, 24, 25, 26, 40, 49, 50, 51, 74, 75, 90)] + [f"s{i}" for i in range(12)] + [""]
    check(spark, [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(150)])
    long = prose(rng, 60)
    check(spark, [(1, long), (2, long), (3, f"a\n{long}\nb"), (4, f"{long}\nc"), (5, "a"), (6, "a")])


def test_equal_windows_share_a_fingerprint_and_runs_are_unions_of_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        weight = rng.choice([1, 1, 1, 2, 3, 5], 12)
        first, size = line_dedup.windows(np.zeros(12, np.int64), weight, 3)
        found = set(zip(first.tolist(), size.tolist()))
        for a in range(12):
            for b in range(a + 1, 13):
                if weight[a:b].sum() >= 3:
                    assert {k for s, n in found if a <= s and s + n <= b for k in range(s, s + n)} == set(range(a, b))


def test_long_text(spark):
    body = "\n".join(f"line {i % 70_000} of many" for i in range(140_000))
    out = {r.doc_id: r for r in line_dedup.op4_lines(docs_table(spark, [(1, body), (2, "y" * 3_000_000), (3, "y" * 3_000_000)])).collect()}
    assert out[1].n_lines == 140_000 and out[1].n_removed == 70_000 and out[1].n_runs == 1
    assert out[3].n_removed == 0


def test_clashing_columns(spark):
    docs = docs_table(spark, [(1, "a\nb\nc"), (2, "a\nb\nc\nx")]).selectExpr("*", "7L AS n_lines", "'t' AS fp", "1 AS at", "2 AS d", "3 AS th", "'q' AS marks", "4 AS _d", "5 AS starts")
    got = {(r.doc_id, r.n_lines, r.fp, r["at"], r.d, r.th, r.marks, r["_d"], r.starts) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(k, n, "t", 1, 2, 3, "q", 4, 5) for k, n in ((1, 3), (2, 4))}
    assert line_dedup.line_stage(docs).columns == docs.columns


def test_positions_are_thinned_and_bounded(monkeypatch):
    """Half of short lines are selected, once each; a text read in stretches gives the same."""
    rng = random.Random(5)
    text = "\n".join(" ".join(f"w{rng.randrange(9**6)}" for _ in range(rng.randrange(1, 9))) for _ in range(4000))
    data, offs = common.text_bytes(pa.array([text]))
    doc, at, fp, near, held = line_dedup.positions(data, offs, 3, 25)
    assert len(set(at.tolist())) == len(at) < 0.55 * 4000
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 500)
    assert all((x == y).all() for x, y in zip(line_dedup.positions(data, offs, 3, 25), (doc, at, fp, near, held)))
    rows = sorted((int(at[r]) - place, size) for rows, place, size, _ in line_dedup.extended(fp, near, held, 3) for r in rows)
    first, size = line_dedup.windows(np.zeros(4000, np.int64), np.ones(4000, np.int64), 3)
    assert rows == sorted(zip(first.tolist(), size.tolist()))


def test_memory_of_a_long_text():
    for text in ("some words in a line here\n" * 300_000, "some words " * 800_000, "x" * 9_000_000):
        data, offs = common.text_bytes(pa.array([text]))
        tracemalloc.start()
        line_dedup.positions(data, offs, 3, 25)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 8 * len(data) + (40 << 20)
