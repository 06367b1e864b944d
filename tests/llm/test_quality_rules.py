import functools
import operator
import random
import unicodedata

from helpers import docs_table, empty_table, prose, words

from prosemill.llm import quality_rules as q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(doc_id, text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n, chars, dup = len(w), sum(map(len, w)), len(lines) - len(set(lines))
    solid = "".join(w)
    upper, letters = (sum(unicodedata.category(c).startswith(k) for c in solid) for k in ("Lu", "L"))
    symbols = sum(c in "#*$%&|<>" for c in t)
    base = n < 50 or 100 * len(covered) > 50 * n
    rest = 100 * symbols > 20 * n or 100 * dup > 30 * len(lines) or 100 * upper > 70 * chars or chars > 20 * n or 100 * letters < 40 * chars
    return (doc_id, n, chars, symbols, dup, len(covered), base, not base and not rest)


def fixture():
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 120), 30)) for i in range(30)]
    rows += [(100, "ab " * 80), (101, "SHOUT " * 3 + prose(rng, 60).upper()), (102, "\n".join(["same line of words"] * 9 + [prose(rng, 60)])), (103, "#% " * 60), (104, None), (105, ""), (106, "é ß 中文\x0b\x0cok\r\n" * 20), (None, prose(rng, 80)), (107, "\U0001f600 " * 55), (108, " a b a b a ")]
    return [*rows, rows[3]]


def test_against_brute_force(spark):
    rows = fixture()
    got = q.op10_quality(docs_table(spark, rows).selectExpr("*", "1 AS n_words", "2 AS failed_bits")).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert q.op10_quality(empty_table(spark)).collect() == []


def test_ledger_policies_and_ablations(spark):
    entries = q.ledger(docs_table(spark, fixture())).cache()
    bits = [r.failed_bits for r in entries.collect()]
    policy = q.POLICIES["v1"]
    assert q.apply_policy(entries, policy).filter("kept").count() == sum(b & policy.mask == 0 for b in bits)
    for r in q.ablations(entries, policy).collect():
        bit = q.BIT[r.rule]
        others = [b & policy.mask & ~bit for b in bits if b & bit]
        assert (r.shared_bits, r.other_bits) == (functools.reduce(operator.and_, others, -1 if others else 0), functools.reduce(operator.or_, others, 0))
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(b & bit != 0 for b in bits), sum(b & policy.mask == bit for b in bits), sum(b & policy.mask & ~bit == 0 for b in bits))
    assert q.rule_profile(entries).agg({"n_docs": "sum"}).first()[0] == len(bits)


def test_no_python_in_the_plan(spark):
    plan = q.op10_quality(docs_table(spark, fixture()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_long_text(spark):
    docs = docs_table(spark, [(1, "word " * 600_000), (2, "a b")]).selectExpr("*", "1 AS _words", "2 AS words", "3 AS t", "4 AS solid", "5 AS windows", "6 AS n_lines")
    got = {r.doc_id: r for r in q.ledger(docs).collect()}
    assert got[1].n_words == 600_000 and got[1].n_repeat_words == 600_000 and got[2].n_lines == 1
    assert all((r["_words"], r.words, r.t, r.solid, r.windows) == (1, 2, 3, 4, 5) for r in got.values())
    assert q.rule_ablations(empty_table(spark)).collect() == []
