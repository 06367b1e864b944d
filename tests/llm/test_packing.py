import random
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from helpers import docs_table, empty_table, prose
from tokenizers import Tokenizer

from prosemill.llm import packing
from prosemill.llm.common import text_bytes


def ids_of(text):
    t = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 700)), "abca"[i % 4]) for i in range(40)]
    return [*rows, (50, None, None), (51, "", "b"), (52, "Ünï Don't STOP!! e=mc² 中文 <|endoftext|> x\x1cy\xa0z ΣΑΣ", "c"), (53, "don't, it's (well)... [ok] \"q\" ño éte", None)]


def check(rows, pieces, window):
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, ids_of(t))
    at = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        x = texts[p.doc_id]
        assert p.doc_tokens == len(x) and p.start == at.get(p.doc_id, 0)
        assert p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
        at[p.doc_id] = p.start + p.length
    assert at == {d: len(x) for d, x in texts.items()}
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0) and p.length > 0
        fill[p.sequence_id] = p.offset + p.length
    assert sorted(fill) == list(range(len(fill)))
    assert all(fill[s] == window for s in range(len(fill) - 1)) and 0 < fill[len(fill) - 1] <= window


def test_round_trip(spark):
    rows = corpus()
    pieces = packing.op7_packing(docs_table(spark, rows, 5)).collect()
    check(rows, pieces, 4096)


def test_small_windows_and_ids(spark):
    rows = corpus()
    frame = packing.pack(docs_table(spark, rows, 3), packing.tokenizer_path(), window=64, turn=16, with_ids=True)
    check(rows, frame.collect(), 64)
    joined = {r.sequence_id: r.ids for r in packing.sequences(frame).collect()}
    assert sum(map(len, joined.values())) == sum(len(ids_of(r[1])) for r in rows)
    assert all(len(v) == 64 for k, v in joined.items() if k < len(joined) - 1)


def test_repeated_rows_and_empty_table(spark):
    pieces = packing.op7_packing(docs_table(spark, [(1, "a b c", "x"), (1, "a b c", "x")], 2)).collect()
    assert sorted((p.doc_id, p.start, p.length, p.offset) for p in pieces) == [(1, 0, 4, 0), (1, 0, 4, 4)]
    assert packing.op7_packing(empty_table(spark)).collect() == []


def played(totals, weights, turn, window, block_windows, seed=1):
    """The queue of each rank, from the pieces of randomly cut queues; every rank is filled once."""
    rng, plan = random.Random(seed), packing.Plan(totals, weights, window, turn, block_windows)
    owner = np.full(sum(totals), -1)
    for q, t in enumerate(totals):
        if not t:
            continue
        cuts = sorted({0, t, *(rng.randrange(t) for _ in range(min(t, 20)))})
        row, at, size, seq, offset = plan.pieces(np.full(len(cuts) - 1, q), np.array(cuts[:-1]), np.diff(cuts))
        assert [sum(size[row == r]) for r in range(len(cuts) - 1)] == np.diff(cuts).tolist()
        for n, w, o in zip(size, seq, offset):
            assert 0 < n and o + n <= window and (owner[w * window + o : w * window + o + n] == -1).all()
            owner[w * window + o : w * window + o + n] = q
    assert (owner >= 0).all()
    return owner, plan


def one_by_one(totals, weights, turn, window):
    """The queue of each rank by deficit round-robin over all windows, one visit after the other."""
    left, counter, out = list(totals), [Fraction(0)] * len(totals), []
    while any(left):
        whole = sum(w for w, n in zip(weights, left) if n)
        for i, w in enumerate(weights):
            if not left[i]:
                continue
            counter[i] += Fraction(window * w, whole)
            if counter[i] >= min(turn, left[i]):
                n = min(int(counter[i]), left[i])
                counter[i] -= n
                left[i] -= n
                out += [i] * n
    return np.array(out)


def test_plan_fills_every_rank_once():
    rng = random.Random(3)
    for seed in range(40):
        totals = [rng.choice([0, 1, 3, 50, 700, 5000]) for _ in range(rng.randrange(1, 8))]
        weights = rng.choice([None, [rng.choice([0, 1, 2, 3.5]) for _ in totals]])
        played(totals, weights, rng.choice([1, 8, 32]), rng.choice([64, 256]), rng.choice([1, 2, 4]), seed)


def test_plan_against_one_queue_after_the_other():
    """Blocks start where a single run over all windows stands, up to a turn a queue."""
    totals, weights, turn, window = [30_000, 9_000, 12_000], [3, 1, 2], 32, 256
    owner, _ = played(totals, weights, turn, window, 4)
    want = one_by_one(totals, weights, turn, window)
    for w in range(0, 9_000 * 6 // window):
        got, brute = (np.bincount(x[: w * window], minlength=3) for x in (owner, want))
        assert np.abs(got - brute).max() <= 2 * turn + window // 6


def test_target_proportions_hold_in_every_window_until_a_queue_is_dry():
    totals, weights, window = [40_000, 8_000, 16_000], [3, 1, 2], 256
    owner, _ = played(totals, weights, 32, window, 4)
    for w in range(8_000 * 6 // window - 4):
        share = np.bincount(owner[w * window : (w + 1) * window], minlength=3)
        assert np.abs(share - np.array([128, 256 / 6, 256 / 3])).max() <= 64
    tail = np.bincount(owner[-4096:], minlength=3)
    assert tail[1] == 0


def test_deficits_are_carried_over_windows_and_blocks():
    """A queue with a share of a quarter turn a window sends in one window of four, in any block, and never drifts."""
    totals, window, turn = [120_000, 120_000 // 31], 256, 32
    owner, plan = played(totals, None, turn, window, 16)
    small = np.array([(owner[a : a + window] == 1).sum() for a in range(0, len(owner) - window, window)])
    assert (small == 0).sum() > len(small) // 2 and small.max() >= turn
    due = np.arange(1, len(small) + 1) * window * totals[1] / sum(totals)
    assert np.abs(np.cumsum(small) - due).max() <= 2 * turn
    assert any(a for b in range(1, plan.blocks - 1) for a, _ in plan.carried(b))
    for b in range(plan.blocks - 1):
        credit = [b * plan.size * n / sum(totals) for n in totals]
        assert all(abs(c - s - a / n) < 1e-6 for c, s, (a, n) in zip(credit, plan.served(b), plan.carried(b)))


def test_query_has_target_weights(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 300), "ab"[i % 2]) for i in range(60)]
    pieces = packing.op7_packing(docs_table(spark, rows, 4)).collect()
    check(rows, pieces, 4096)
    first = [p for p in pieces if p.sequence_id == 1]
    assert abs(sum(p.length for p in first if p.source == "a") - 3072) <= 512


def test_clashing_columns_and_long_text(spark):
    rows = [(1, "ab, cd " * 600_000, "x"), (2, "y" * 70_000, None)]
    docs = docs_table(spark, rows, 2).selectExpr("*", "1 AS part", "2 AS `at`", "'q' AS ids", "3 AS n", "4 AS base")
    check(rows, packing.op7_packing(docs).collect(), 4096)


def test_every_letter_lowers_alike():
    enc = packing.Encoder(packing.tokenizer_path())
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    texts = [f"a{c}b, {c}." for c in odd]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert list(enc.encode(*text_bytes(pa.array(texts)))) == [np.array(e.ids, enc.dtype).tobytes() for e in whole]


def test_words_side_by_side():
    enc, rng = packing.Encoder(packing.tokenizer_path()), random.Random(2)
    letters = [*"etaoinshrdlu", "é", "ß", "ñ", "ж", "中", "\u0301"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 20))) + rng.choice(["", ".", ",!", "'s", "-x"]) for _ in range(50)) for _ in range(60)]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert list(enc.encode(*text_bytes(pa.array(texts)))) == [np.array(e.ids, enc.dtype).tobytes() for e in whole]


def test_words_of_every_script():
    """100,000 words of neighbouring characters of all planes, with marks after some."""
    enc, rng = packing.Encoder(packing.tokenizer_path()), random.Random(6)
    letters = [c for c in map(chr, range(0x21, 0x30000)) if unicodedata.category(c)[0] in "LMNPS"]

    def word():
        at = rng.randrange(len(letters) - 40)
        return "".join(rng.choice(letters[at : at + 40]) for _ in range(rng.randrange(1, 8))) + "".join(rng.choice("!,.-'s") for _ in range(rng.randrange(3)))

    texts = ["\u092c\u095d! \u0932\u0915\u095c, \u0a36- \u0f69."] + [" ".join(word() for _ in range(100)) for _ in range(1000)]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert list(enc.encode(*text_bytes(pa.array(texts)))) == [np.array(e.ids, enc.dtype).tobytes() for e in whole]


def test_memory_of_words_is_bounded():
    enc = packing.Encoder(packing.tokenizer_path())
    taken = lambda words: sum(len(w) + len(x) + packing._ENTRY for w, x in words.items())
    swapped, most = False, 0
    for k in range(7):
        list(enc.encode(*text_bytes(pa.array([" ".join(f"{i:x}q{k}" for i in range(60_000))]))))
        assert enc.held == taken(enc.memo) <= packing.MEMO_BYTES // 2
        swapped, most = swapped or bool(enc.older), max(most, taken(enc.memo) + taken(enc.older))
    # Each generation ends with the batch that fills its half.
    assert swapped and most <= packing.MEMO_BYTES + 2 * 60_000 * (packing._ENTRY + 16)


def test_encoders_are_forgotten():
    """What the second pass does first in each worker."""
    packing.encoder(packing.tokenizer_path())
    packing.forget_encoders()
    assert not packing._ENCODERS
