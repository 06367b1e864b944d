import random

import corpus_pipeline
import test_line_dedup
import test_ngram_join
import test_packing
from helpers import docs_table, words

from prosemill.llm import mixing
from prosemill.llm.common import read_table


def test_stages_against_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    one = corpus_pipeline.language(spark, docs, sf_dir).cache()
    kept = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns
    assert {d for d, r in rows.items() if r.text and len(words(r.text)) >= 20} <= set(kept)
    assert not [d for d in kept if not any(c.isalpha() for c in rows[d].text or "")]

    two = corpus_pipeline.lines(spark, one, sf_dir).cache()
    want = {r[0]: r for r in test_line_dedup.brute([(r.doc_id, r.text) for r in kept.values()])}
    got = {r.doc_id: r for r in two.collect()}
    assert set(got) == {d for d, r in want.items() if r[2] == 0 or r[2] < r[1]}
    assert all(len(r.text) == want[d][4] == r.n_chars for d, r in got.items())

    three = corpus_pipeline.near_duplicates(spark, two, sf_dir).cache()
    alive = {r[2] for r in test_ngram_join.brute([(r.doc_id, r.text) for r in got.values()], 5, 80)}
    assert {r.doc_id for r in three.collect()} == alive and three.columns == docs.columns

    four = corpus_pipeline.mix(spark, three, sf_dir).cache()
    taken = {r.doc_id: r.copies for r in mixing.op1_mix(three).collect()}
    times = {}
    for r in four.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {d: c for d, c in taken.items() if c}

    pieces = corpus_pipeline.pack(spark, four.dropDuplicates(["doc_id"]), sf_dir).collect()
    test_packing.check([(r.doc_id, r.text) for r in four.dropDuplicates(["doc_id"]).collect()], pieces, 4096)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    fill = {r.sequence_id: r.n for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert out.count() > 0 and all(n == 4096 for s, n in fill.items() if s < max(fill))


def test_odd_rows_and_clashing_columns_in_every_stage(spark):
    rng = random.Random(2)
    text = {i: " ".join(rng.choice("the of and ing tion was with for is".split()) + rng.choice("abcdefgh") for _ in range(40 + i)) for i in range(40)}
    rows = [(i, t, "ab"[i % 2]) for i, t in text.items()] + [(3, text[3], "b"), (3, text[4], "b"), (None, text[5], None), (100, None, "a"), (101, "", "a"), (102, "12 34", None), (103, text[7] + " more", "a"), (104, "the of and ing " * 60_000, "a")]
    names = ["d", "th", "at", "marks", "size", "copies", "place", "keep", "n_lines", "n_removed", "lang_pred", "score", "lettered", "_d", "_size", "_each", "_keep", "source_", "m", "key", "x"]
    docs = docs_table(spark, rows).selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(names)])
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, None).cache()
        assert seen.columns == docs.columns and seen.count() > 0, name
        assert {tuple(r) for r in seen.select(*[f"`{c}`" for c in names]).collect()} == {tuple(range(len(names)))}, name
        if name == "language_id":
            assert {r.doc_id for r in seen.collect()} >= {*text, None, 103, 104} and not {100, 101, 102} & {r.doc_id for r in seen.collect()}
        if name == "ngram_join":
            assert [r.doc_id for r in seen.collect()].count(3) == 1 and 103 not in {r.doc_id for r in seen.collect()}
    pieces = corpus_pipeline.pack(spark, seen, None)
    assert pieces.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, None).count() == 0
