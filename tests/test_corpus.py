import random

import pytest
from pyspark.sql import functions as F

from prosemill.operators import corpus, model, splits
from prosemill.operators.corpus import CorpusError
from prosemill.plans import pipelines
from prosemill.sources import reports, tables


def test_columns_and_admission(spark):
    assert corpus.resolve_column(["Essay", "Generated"], corpus.TEXT_COLUMN_CANDIDATES) == "Essay"
    assert corpus.resolve_column(["a", "LABEL"], corpus.LABEL_COLUMN_CANDIDATES, "label") == "LABEL"
    with pytest.raises(CorpusError):
        corpus.resolve_column(["a"], (), "b")
    frame = lambda names: spark.createDataFrame([("x", "1")], names)
    assert corpus.admit(frame(["p", "q"]), "f") is None and corpus.admit(frame(["text", "q"]), "f") is None
    assert corpus.admit(frame(["text", "generated"]), "f").columns == ["text", "label", "_source"]
    with pytest.raises(CorpusError):
        corpus.admit(frame(["p", "label"]), "f")
    with pytest.raises(CorpusError):
        corpus.require_columns(frame(["p", "q"]), ["p", "z"], "f")


def test_labels(spark):
    text = spark.createDataFrame([(v,) for v in ("1", " AI ", "Yes", "human", "0", "1.0", "2", None, "no")], "label string")
    assert [r.x for r in text.select(corpus.coerce_label(F.col("label")).alias("x")).collect()] == [1, 1, 1, 0, 0, None, None, None, 0]
    number = spark.createDataFrame([(v,) for v in (1.0, 0.0, 0.5, float("nan"), None)], "label double")
    assert [r.x for r in number.select(corpus.coerce_label(F.col("label"), "double").alias("x")).collect()] == [1, 0, None, None, None]
    assert [(r.label, r["count"]) for r in corpus.bad_labels(text.filter("label IS NOT NULL")).collect()] == [("1.0", 1), ("2", 1)]


def test_clean_and_funnel(spark):
    long = "w " * 50
    rows = [(1, long, 1), (2, f"  {long}\n", 0), (3, "short", 1), (4, None, 0), (5, long + "x", None), (6, long + "y", 0), (7, " ", 1)]
    frame = spark.createDataFrame(rows, "n long, text string, label int")
    assert [r.n for r in corpus.clean(frame, ["n"]).orderBy("n").collect()] == [1, 6]
    assert tuple(corpus.funnel(frame).first()) == (7, 6, 4, 3, 2)


def test_balance(spark):
    frame = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    r = corpus.class_balance(frame).first()
    assert (r.n_human, r.n_ai, r.imbalance_ratio, r.majority_baseline, r.majority_class, r.is_skewed) == (3, 1, 3.0, 75.0, "human", True)
    assert corpus.class_balance(frame.limit(0)).first().pct_ai == 0.0


def test_joins(spark):
    a = spark.createDataFrame([(1, " x "), (2, "y"), (3, "x")], "i int, text string")
    b = spark.createDataFrame([("x",), ("x",)], "t string")
    assert sorted(r.i for r in corpus.present_in(a, "text", b, "t").collect()) == [1, 3]
    assert [r.i for r in corpus.pending(a, a.filter("i < 3"), "i").collect()] == [3]
    cache = spark.createDataFrame([("the  start",)], "excerpt string")
    essays = spark.createDataFrame([(2, "the start"), (1, "the\nstart")], "n int, text string")
    assert corpus.excerpt_source(cache, essays, ["n"]).first().essay.n == 1


def test_splits(spark):
    frame = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "i long, label int")
    split = splits.stratified_split(frame, "i", "label")
    assert {(r.label, r["count"]) for r in split.filter("is_test").groupBy("label").count().collect()} == {(0, 15), (1, 5)}
    folds = splits.stratified_folds(frame, "i", "label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {15, 5}
    few = frame.filter("label = 0 OR i < 10")
    assert splits.fold_count(few, "label") == 3
    one = frame.filter("label = 0 OR i = 0")
    assert splits.stratified_split(one, "i", "label").filter("is_test").count() == 15
    twins = splits.stratified_folds(frame.withColumn("g", F.col("i") % 10), "i", "label", group="g").groupBy("g").agg(F.countDistinct("fold").alias("n"))
    assert twins.agg(F.max("n")).first()[0] == 1
    sample = splits.rotate_variants(splits.seeded_sample(frame, "i", 7)).orderBy("position").collect()
    assert [r.prompt_variant for r in sample] == [splits.VARIANTS[k % 3] for k in range(7)]
    assert splits.hashed_split(frame, "i").filter("is_test").count() in range(8, 35)
    held = split.withColumn("source", F.when(F.col("i") % 2 == 0, "a").otherwise("b"))
    assert splits.first_held_out(held, ["b", "a"], "source", "i").first().source == "b"


def test_files(spark, tmp_path):
    (tmp_path / "one_essays.csv").write_text('text,generated\n"a, ""q""\nb",1\nc,0\n')
    (tmp_path / "prompts.csv").write_text("prompt_id,name\n1,x\n")
    (tmp_path / "features_cache.csv").write_text("x\n")
    paths = tables.list_files(spark, str(tmp_path), without=["features_cache.csv"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["one_essays.csv", "prompts.csv"]
    read = tables.read_corpus(spark, paths)
    assert {(r.text, r.label) for r in read.collect()} == {('a, "q"\nb', "1"), ("c", "0")}
    assert pipelines.prepare([read], ["_file", "_row"], 1).count() == 2
    assert tables.source_of("x/daigt_essays.csv") == "daigt" and tables.read_columns(spark, paths[0], ["nope"]) is None
    with pytest.raises(CorpusError):
        tables.list_files(spark, str(tmp_path), ".tsv")
    (tmp_path / "cache.jsonl").write_text('{"index": 1, "text": "old"}\n\n{bad\n{"index": 1, "text": "new"}\n{"index": 2, "text": "z"}\n')
    last, seen = tables.read_jsonl(spark, str(tmp_path / "cache.jsonl"))
    assert {(r["index"], r.text) for r in last.collect()} == {(1, "new"), (2, "z")} and seen.get == {"n_lines": 4, "n_skipped": 1}
    tables.append_jsonl(last, str(tmp_path / "out"))
    tables.append_jsonl(last, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    tables.write_csv(read.select("text", "label"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2
    tables.append_failures(spark, [("t", 1, "v", "why")], str(tmp_path / "fail"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "fail")).first()[3] == "why"


def test_reports(spark):
    old = "x <!-- MANUAL:notes -->kept<!-- /MANUAL:notes -->"
    frame = spark.createDataFrame([("a", 0.5)], "name string, v double")
    out = reports.evaluation_report(frame, frame, frame, frame, frame, old)
    assert "| a | 0.5000 |" in out and "-->kept<!--" in out
    assert "## Balance" in reports.dataset_report(frame, frame, frame)


def test_grouped_folds(spark):
    """Whole groups, and each fold's part of a class within one group of a k-th, whatever the sizes."""
    rng = random.Random(8)
    groups = {g: [rng.choice([0, 0, 1]) for _ in range(rng.choice([1, 1, 2, 3, 9]) if g < 300 else 40)] for g in range(306)}
    rows = [(g, y) for g, ys in groups.items() for y in ys] + [(None, 0), (None, 1)]
    frame = spark.createDataFrame([(i, g, y) for i, (g, y) in enumerate(rows)], "i long, g long, y int").repartition(5)
    for k in (2, 5):
        folds = {r.g: r.fold for r in splits.grouped_folds(frame, "y", "g", k).collect()}
        assert set(folds) == {*groups, None} and set(folds.values()) == set(range(k))
        for y in (0, 1):
            held = [sum(c == y and folds[g] == f for g, c in rows) for f in range(k)]
            largest = max(ys.count(y) for ys in groups.values())
            assert max(abs(n - sum(held) / k) for n in held) <= largest
        dealt = splits.stratified_folds(frame, "i", "y", k, group="g")
        assert {(r.g, r.fold) for r in dealt.select("g", "fold").distinct().collect()} == set(folds.items()) and dealt.count() == len(rows)
    # Groups of one kind alone are dealt out evenly.
    same = spark.createDataFrame([(i // 2, i % 2) for i in range(2000)], "g long, y int")
    assert {r["count"] for r in splits.grouped_folds(same, "y", "g").groupBy("fold").count().collect()} == {200}
    assert splits.grouped_folds(frame.limit(0), "y", "g").collect() == []


def test_greedy_dealer():
    deal = splits.dealt_greedily(3, {"0": 1, "1": 4})
    assert [deal(g) for g in ({"0": 8, "1": 1}, {"0": 8}, {"0": 6, "1": 1}, {"1": 2}, {"0": 1})] == [0, 1, 2, 1, 2]


def test_lines_are_committed_once(spark, tmp_path):
    """A writer lost between lines and commit, and replays of what is committed."""
    lines = tables.CommittedLines(str(tmp_path / "lines"))
    rows = spark.range(10).selectExpr("id", "'x' AS v")
    assert lines.read(spark, "id long, v string").collect() == []
    assert lines.write(rows, 0) == 10  # lost here
    assert lines.read(spark, "id long, v string").collect() == []
    for _ in range(3):
        lines.append(rows, 0)
    lines.append(rows.limit(0), 1)
    lines.append(rows.selectExpr("id + 10 AS id", "v"), 2)
    lines.append(rows.selectExpr("id + 99 AS id", "v"), 2)  # committed before: a replay adds nothing
    assert sorted((r.id, r.batch) for r in lines.read(spark, "id long, v string").collect()) == [(i, 0 if i < 10 else 2) for i in range(20)]
    assert {(r.batch, r.n_lines) for r in lines.committed(spark).collect()} == {(0, 10), (1, 0), (2, 10)}


def test_model_files_of_any_layout(spark):
    names = ["a", "b"]
    bodies = ['{"feature_weights": {"b": 2, "x": 5}, "weights": [7, 7], "intercept": 1}', '{"feature_names": ["b", "a"], "weights": [1, "3.5"]}', '{"weights": [4, 5]}', '{"weights": [4]}', '{"model": {"coef": [[1, 2]], "intercept": [0.5]}}', '{"model": {"coef": [3, 4], "intercept": 2}}', "{}", "[1, 2]", "nope", None]
    got = {}
    for r in model.model_weights(spark.createDataFrame(list(enumerate(bodies)), "model_id long, body string"), names).orderBy("model_id", "position").collect():
        got.setdefault(r.model_id, [r.layout, r.intercept]).append(r.weight)
    assert got == {
        0: ["by name", 1, 0, 2], 1: ["in order", 0, 3.5, 1], 2: ["in order", 0, 4, 5], 3: ["none", 0, 0, 0], 4: ["in order", 0.5, 1, 2], 5: ["in order", 2, 3, 4],
        6: ["none", 0, 0, 0], 7: ["none", 0, 0, 0], 8: ["unreadable", 0, 0, 0], 9: ["unreadable", 0, 0, 0],
    }
    features = spark.createDataFrame([(1, 0.5, 2.0)], "doc_id long, a double, b double")
    scored = model.score_with(features, model.model_weights(spark.createDataFrame([(0, bodies[0])], "model_id long, body string"), names), "doc_id").first()
    assert abs(scored.probability - 1 / (1 + 2.718281828459045**-5)) < 1e-9
