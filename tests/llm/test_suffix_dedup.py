import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_table, empty_table, shared_texts

from prosemill.llm import common, suffix_dedup


def brute(rows, length):
    distinct = sorted({(i is None, i or 0, (x or "").encode()) for i, x in rows})
    seen, out = set(), {}
    for none, i, raw in distinct:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[none, i, raw] = (None if none else i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted((out[i is None, i or 0, (x or "").encode()] for i, x in rows), key=repr)


@pytest.mark.parametrize(("length", "gram", "bucket"), [(100, 24, 400), (20, 6, 40), (12, 12, 25), (30, 8, 100_000)])
def test_against_brute_force(spark, length, gram, bucket):
    rows = shared_texts()
    got = suffix_dedup.dedup_bytes(docs_table(spark, rows), length, gram, bucket)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, length)


def test_runs_of_one_letter_and_many_bytes(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for i in range(30)] + [(40, "a" * 300), (41, "a" * 200 + "b" * 50), (42, "é" * 80)]
    got = suffix_dedup.dedup_bytes(docs_table(spark, rows), 10, 4, 30)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 10)


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    rows = [(3, text), (1, None), (2, ""), (None, text), (5, text[7:]), (5, text[7:]), (6, text + "x")]
    got = suffix_dedup.op5_bytes(docs_table(spark, rows).selectExpr("*", "1 AS gram", "2 AS d"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 100)
    assert suffix_dedup.op5_bytes(empty_table(spark)).collect() == []


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(1, "abcdefghijklmnop" * 3), (1, "ponmlkjihgfedcba" * 3), (2, "abcdefghijklmnop")]
    got = suffix_dedup.dedup_bytes(docs_table(spark, rows), 16, 4).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 48, 32), (1, 48, 32), (2, 16, 16)]


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (200, 5)).astype(np.uint64)
    assert (words[suffix_dedup.multikey_order(words)] == words[np.lexsort(words.T[::-1])]).all()


def test_a_common_gram_over_many_buckets(spark):
    """One passage after and before different texts in all documents: its first and last grams stand in every bucket."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(10, 60))) + passage + "".join(rng.choice("uvw") for _ in range(rng.randrange(10, 60)))) for i in range(150)]
    got = suffix_dedup.dedup_bytes(docs_table(spark, rows), 30, 8, 20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 30)


def test_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    got = {r.doc_id: r for r in suffix_dedup.op5_bytes(docs_table(spark, [(1, long), (2, "head " + long[400_000:]), (3, "z" * 1_200_000)])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 1_100_000 and got[3].n_removed == 1_200_000 - 1


def test_a_long_text_is_read_in_stretches(monkeypatch):
    """The same positions as at once, in texts with and without repeats, and little memory."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd ") for _ in range(9000)), "ab" * 4000, "".join(rng.choice("ab") for _ in range(300)) * 30, "x" * 7000]
    for text in texts:
        data, offs = common.text_bytes(pa.array([text]))
        whole = suffix_dedup.suffixes(data, offs, 100, 24)
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
        cut = suffix_dedup.suffixes(data, offs, 100, 24)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(whole, cut)) and len(whole[0]) == len(cut[0])
    data, offs = common.text_bytes(pa.array(["some words of it " * 600_000]))
    tracemalloc.start()
    suffix_dedup.suffixes(data, offs, 100, 24)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(data) + (120 << 20)
