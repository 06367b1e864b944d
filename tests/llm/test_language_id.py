import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from helpers import docs_table, empty_table, words

from prosemill.llm import common, language_id
from prosemill.llm.common import read_table

SYLLABLES = {
    "en": "the ing tion and of was th er on is with for".split(),
    "de": "der ung sch und ein ich keit zu auf ver ß ü".split(),
    "fr": "le eau que eux ment des é è oui dans ç la".split(),
    "es": "ción os que ado mente el ñ rr ll los por ez".split(),
}


def corpus(n=600):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))), "s", lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in language_id.op8_language(docs_table(spark, rows)).collect()}
    held = [(got[i], lang) for i, _, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert sum(r.lang_pred == lang for r, lang in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = corpus(200)
    other = [(i, t, "other", "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, _, lang in rows]
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.op8_language(docs_table(spark, x)).collect()} for x in (rows, other))
    assert one == two


def test_odd_rows(spark):
    rows = [*corpus(120), (1000, None, "s", "en"), (1001, "", "s", None), (1002, "123 --- 456", "s", "de"), (None, "der und ein ich zu auf ver keit ung", None, "de"), (1003, "x" * 200_000, "s", "en")]
    frame = docs_table(spark, rows).selectExpr("*", "'z' AS lang_pred", "1 AS score")
    got = {r.doc_id: r for r in language_id.op8_language(frame).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "de" and got[None].held_out is False
    assert language_id.op8_language(empty_table(spark)).collect() == []
    assert {r.lang_pred for r in language_id.op8_language(docs_table(spark, [(0, "text", "s", None)])).collect()} == {"und"}


def test_stage_drops_what_has_no_language(spark):
    docs = docs_table(spark, [*corpus(150), (999, "12 34 !!", "s", "en")])
    out = language_id.language_stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(150))


def test_held_out_accuracy_on_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = language_id.op8_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    long = [r for r in got if len(words(r.text)) >= 20]
    right = sum(r.lang_pred == r.lang for r in long)
    print(len(got), len(long), right)
    assert len(long) > 30 and right >= 0.97 * len(long)


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    fit_duels = language_id.fit_duels
    monkeypatch.setattr(language_id, "fit_duels", lambda x, labels: (seen.append(len(x)), fit_duels(x, labels))[1])
    rows = corpus(300) + [(7, f"the ing tion and {i} of was", "s", "en") for i in range(500)] + [(0, "der und ein ich", "s", "de")] * 500
    assert language_id.fit(docs_table(spark, rows), per_lang=20, most_rows=60) is not None
    assert 30 <= seen[0] <= 60
    seen.clear()
    many = [(i, f"the word{i} of it", "s", f"l{i % 90}") for i in range(900)]
    assert language_id.fit(docs_table(spark, many), most_rows=50).within
    assert seen[0] <= 50


def test_clashing_columns(spark):
    docs = docs_table(spark, corpus(60)).selectExpr("*", "1 AS _lettered", "2 AS lettered", "3 AS `order`", "4 AS place")
    out = language_id.language_stage(docs)
    assert out.columns == docs.columns and {(r["_lettered"], r.lettered, r.order, r.place) for r in out.collect()} == {(1, 2, 3, 4)}
    assert language_id.language_stage(empty_table(spark)).collect() == []


def test_a_long_text_is_counted_in_stretches(monkeypatch):
    data, offs = common.text_bytes(pa.array(["Ein Satz, und noch ein Satz. " * 4000]))
    whole = language_id.features(data, offs)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 1000)
    assert np.allclose(language_id.features(data, offs), whole)
    monkeypatch.undo()
    data, offs = common.text_bytes(pa.array(["some words " * 900_000]))
    tracemalloc.start()
    language_id.features(data, offs)
    assert tracemalloc.get_traced_memory()[1] < 70 << 20
    tracemalloc.stop()
