import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from helpers import docs_table, empty_table, prose
from pyspark.sql import functions as F

from prosemill.llm import importance_resampling as resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [zlib.crc32(w.encode()) % 10_000 for w in WORDS.findall(lower)]


def brute(rows, target, percent=10, least=20):
    raw = Counter(b for _, text in rows for b in features(text))
    wanted = Counter(b for text in target for b in features(text))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    scored = []
    for doc_id, text in rows:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 10_000) / ((raw[b] + 1.0) * (t_all + 10_000)))) for b in f)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    out = [(*x, n + 1) for n, x in enumerate(eligible[: len(eligible) * percent // 100])]
    return sorted(map(str, out + [(*x, None) for x in eligible[len(eligible) * percent // 100 :]] + [(*x, None) for x in scored if x[1] < least]))


def target_table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def result(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(0, 90))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "!!! \n"), (403, "ÀÉ ñandú Straße " * 9), (404, "x" * 70_000 + " tail " * 30), (None, prose(rng, 40)), (None, prose(rng, 60))]
    return rows + [(405, "A-B's 12:30 c3po_r2d2\x00z " * 8)] + [rows[7]] * 60


def test_against_brute_force(spark, rows):
    target = [prose(random.Random(2), 300), None, "", "Straße w1 w2 w3"]
    assert result(resampling.op13_resample(docs_table(spark, rows), target_table(spark, target))) == brute(rows, target)


def test_many_runs_and_ranges(spark, rows):
    """Rows of one id and score, more than a range has, are cut into ranges too."""
    docs = docs_table(spark, rows, 23)
    gain = resampling.gains(resampling.bucket_counts(docs), np.zeros(10_000, np.int64))
    for percent in (1, 37, 100):
        for size in (1, 16, 1000):
            assert result(resampling.drawn(resampling.scored(docs, gain), percent, range_rows=size)) == brute(rows, [], percent)
    ranked = resampling.drawn(resampling.scored(docs, gain), 100, range_rows=16).filter("rank is not null")
    n = ranked.count()
    assert ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (n, 1, n)


def test_empty_tables_and_clashing_columns(spark, rows):
    assert resampling.op13_resample(empty_table(spark), target_table(spark, ["a b"])).collect() == []
    few = rows[:40]
    docs = docs_table(spark, few).selectExpr("*", "1 AS rank", "2 AS score", "3 AS place", "4 AS range", "5 AS before", "6 AS n_features")
    assert result(resampling.op13_resample(docs, target_table(spark, []))) == brute(few, [])
    assert result(resampling.op13_resample(docs_table(spark, [(1, "one two")]), target_table(spark, []))) == brute([(1, "one two")], [])


def test_very_long_text(spark):
    text = "word1 " * 600_000 + "y" * 3_000_000 + "ü" * 10
    rows = [(1, text), (2, prose(random.Random(3), 30))]
    assert result(resampling.op13_resample(docs_table(spark, rows), target_table(spark, ["word1"]))) == brute(rows, ["word1"])


def test_tournament():
    rng = random.Random(4)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert [x for (x,) in resampling.Tournament([((x,) for x in r) for r in runs])] == sorted(x for r in runs for x in r)


def test_draw_follows_target(spark):
    """Texts that speak like the target make up a tenth of all and most of the draw."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'t' if i % 10 == 0 else 'u'}{rng.randrange(80)}" for _ in range(40))) for i in range(500)]
    drawn = resampling.op13_resample(docs_table(spark, rows), target_table(spark, [" ".join(f"t{k}" for k in range(80))])).filter("rank is not null").collect()
    assert len(drawn) == 50 and sum(r.doc_id % 10 == 0 for r in drawn) == 50
