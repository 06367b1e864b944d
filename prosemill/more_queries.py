"""More registered queries: a model of fixed weights, attribution by ranges, corpus files.

Where the driver's tables never reach an operator, the query makes input that
does from their rows, in the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import collapsed, discourse_markers_in, excerpt, excerpt_line, normalize_text
from .operators import corpus, metrics, model, splits
from .operators import language_model as lm
from .operators.sentences import split_with_offsets
from .operators.signals import sentence_perplexity_features, style_features, text_features
from .sources import tables

#: Any fixed numbers do.
FIXED_MODEL = model.ModelBundle(
    feature_names=["type_token_ratio", "hapax_ratio", "avg_word_length", "stopword_ratio", "punctuation_density", "comma_per_sentence", "uppercase_ratio"],
    means=[0.6, 0.4, 5.5, 0.2, 0.15, 0.5, 0.02],
    scales=[0.19, 0.23, 1.7, 0.1, 0.07, 0.37, 0.05],
    weights=[0.9, -0.7, 0.4, -1.1, 0.6, -0.3, 0.2],
    intercept=0.1,
)
#: Added to texts so that connectives and contractions occur.
VOICES = ("", " However, I don't know. Therefore it's so.", " Moreover we're late, and moreover they can't.", " Nothing here.")
#: Spellings of labels, in turn.
SPELLINGS = ("1", "1.0", " AI ", "yes", "TRUE", "human", "No", "0", "maybe")
TOKEN_CHARS = 9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def _turn(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def voiced(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.concat("text", _turn(VOICES)))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_features(_documents(spark, sf_dir)).select("doc_id", *[F.round(f, 6).alias(f) for f in FIXED_MODEL.feature_names])


def discourse_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voiced(_documents(spark, sf_dir, "lang"))
    return rows.select("lang", F.explode(discourse_markers_in(F.col("text"))).alias("marker")).groupBy("lang", "marker").agg(F.count("*").alias("n"))


def voice_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_features(voiced(_documents(spark, sf_dir))).select("doc_id", *[F.round(c, 6).alias(c) for c in ("discourse_marker_ratio", "contraction_ratio")])


def semi_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "benchmark")
    padded = known.filter("item_id % 2 = 0").select(F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"))
    return corpus.present_in(_documents(spark, sf_dir).select("text").unionByName(padded), "text", known, "text").agg(F.count("*").alias("n_present"))


def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.feature_moments(_features(spark, sf_dir), FIXED_MODEL.feature_names).select("position", "feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def fixed_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_prediction(model.predict(_features(spark, sf_dir), FIXED_MODEL)).select("doc_id", F.round("probability", 6).alias("probability"), F.col("predicted").cast("long").alias("predicted"))


def fixed_model_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select("doc_id", F.posexplode(model.top_contributions(FIXED_MODEL)).alias("place", "c"))
    return rows.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "c.name", "c.value", (F.col("c.contribution") + F.lit(0.0)).alias("contribution"))


def fixed_model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's weights by what they do to the documents' values."""
    rows = model.weighted_effects(_features(spark, sf_dir), FIXED_MODEL)
    return rows.select(F.col("place").cast("long").alias("place"), "name", "weight", F.round("effect", 6).alias("effect"))


def sentence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _sentence_scores

    names = ("sentence_perplexity_mean", "sentence_perplexity_std", "perplexity_burstiness")
    return sentence_perplexity_features(_sentence_scores(spark, sf_dir)).select("doc_id", *[F.round(c, 6).alias(c) for c in names])


def token_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence scores from tokens of ``TOKEN_CHARS`` characters, of which many lie in two sentences."""
    docs = _documents(spark, sf_dir)
    n = F.length(F.coalesce("text", F.lit("")))
    places = docs.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / TOKEN_CHARS).cast("int"))).alias("i"))
    start = F.col("i") * TOKEN_CHARS
    tokens = places.select("doc_id", F.col("i").alias("tok_idx"), start.alias("start_char"), F.least(start + TOKEN_CHARS, "n").alias("end_char"), (-0.25 * (1 + F.col("i") % 7)).alias("logprob"))
    scores = lm.attribute_tokens(split_with_offsets(docs).drop("text"), tokens)
    return scores.select("doc_id", F.col("sid").cast("long").alias("sid"), "token_count", F.round("mean_logprob", 6).alias("mean_logprob"), F.round("perplexity", 6).alias("perplexity"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ".\r\n"), F.lit("\r\ufb01ne \uff21 x\u00b2\u00a0\u2460"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(normalize_text(odd)).alias("text_md5"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", F.md5(excerpt(text)).alias("excerpt_md5"), excerpt_line(text).alias("line"))


def label_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", _turn(SPELLINGS).alias("spelled"), ((F.col("doc_id") % 4) / 2.0).alias("number"))
    return rows.select("doc_id", corpus.coerce_label(F.col("spelled")).cast("long").alias("from_text"), corpus.coerce_label(F.col("number"), "double").cast("long").alias("from_number"))


def dropped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(_turn(SPELLINGS).alias("label"))
    return corpus.bad_labels(rows).select("label", F.col("count").alias("n"))


def excerpt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    cache = docs.select(F.col("doc_id").alias("cache_id"), F.substring("text", 1, 400).alias("excerpt"))
    return corpus.excerpt_source(cache, docs, ["doc_id"]).select("cache_id", F.col("essay.doc_id").alias("doc_id"))


def _damaged() -> Column:
    """Some texts empty, some without a sentence, some without a word."""
    place = F.col("doc_id") % 11
    return F.when(place == 1, "").when(place == 2, " \n ").when(place.isin(3, 4), "12 34. 5!").otherwise(F.col("text"))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("text", _damaged())
    known = text_features(docs).withColumnRenamed("n_words", "word_count")
    rest = [f for f in model.FEATURE_NAMES if f not in known.columns]
    full = known.join(docs, "doc_id").withColumns({f: F.when(F.col("doc_id") % 17 == 0, F.lit(float("nan"))).otherwise(0.0) for f in rest})
    return model.failure_tally(model.row_failures(full)).select("fail_reason", F.col("count").alias("n"))


def held_out_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(_documents(spark, sf_dir, "source").drop("text"), "doc_id")
    return splits.first_held_out(splits.stratified_split(rows, "doc_id", "label"), ["src7", "src3"], "source", "doc_id").select("doc_id", "source")


def variant_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = splits.rotate_variants(splits.seeded_sample(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id"))
    return corpus.value_counts(sample, "prompt_variant")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, unlabelled and left-out CSV files, written, listed and read as one corpus."""
    folder = tables.scratch(spark)
    rows = _documents(spark, sf_dir).filter("text IS NOT NULL AND text <> ''").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    tables.write_csv(rows.filter("doc_id % 2 = 0").select(F.col("text").alias("essay"), _turn(SPELLINGS).alias("Generated")), f"{folder}/even_essays.csv")
    tables.write_csv(rows.filter("doc_id % 2 = 1").select("text", (F.col("doc_id") % 3).alias("label")), f"{folder}/odd.csv")
    tables.write_csv(rows.select("doc_id", "text"), f"{folder}/prompts.csv")
    tables.write_csv(rows.select("text", F.lit(1).alias("label")), f"{folder}/clean.csv")
    read = corpus.drop_unlabelled(tables.read_corpus(spark, tables.list_files(spark, folder, without=["clean.csv"])))
    return read.select(F.col("_source").alias("source"), F.col("label").cast("long").alias("label"), F.md5("text").alias("text_md5"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended JSON lines: the last line of a key wins, and done keys are not pending."""
    path = f"{tables.scratch(spark)}/cache.jsonl"
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("int").alias("index"), F.lit("light_grammar_flow").alias("prompt_variant"), F.lit("old").alias("text"), F.lit("m").alias("model"))
    tables.append_jsonl(rows, path)
    tables.append_jsonl(rows.filter("index % 3 = 0").withColumn("text", F.lit("new")), path)
    last, _ = tables.read_jsonl(spark, path)
    return last.select(F.col("index").cast("long").alias("doc_id"), "text", "original_text")


QUERIES = (
    discourse_usage, voice_ratios, semi_benchmark_overlap, feature_moments, fixed_model_scores, fixed_model_contributions, fixed_model_weights, sentence_spread, token_ranges,
    normalized_texts, excerpts, label_spellings, dropped_labels, excerpt_join, failure_reasons, held_out_row, variant_tally, corpus_files, json_lines,
)


def _quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle_sql(known: dict[str, str], style: str, sentences: str, sentence_scores: str, discourse: str) -> dict[str, str]:
    """``known`` has the SQL of the other queries; the others are their common parts."""
    m = FIXED_MODEL
    features = f"f AS (SELECT * FROM ({known['signals_style']}) JOIN ({known['signals_surface']}) USING (doc_id))"
    terms = [f"(({n} - {a!r}::DOUBLE) / {b!r}::DOUBLE * {w!r}::DOUBLE)" for n, a, b, w in zip(m.feature_names, m.means, m.scales, m.weights)]
    voice = f"voiced AS (SELECT doc_id, lang, text || {_quoted(VOICES)}[doc_id % {len(VOICES)} + 1] AS text FROM documents)"
    contractions = r"len(regexp_extract_all(t, '(?i)[\pL\pN_]+[''’](?:t|s|re|ve|ll|d|m)(?:[^\pL\pN_]|$)'))"
    spelled = f"{_quoted(SPELLINGS)}[doc_id % {len(SPELLINGS)} + 1]"
    coerced = lambda x: f"CASE WHEN lower(trim({x})) IN {_quoted(corpus.TRUTHY).replace('[', '(').replace(']', ')')} THEN 1 WHEN lower(trim({x})) IN {_quoted(corpus.FALSY).replace('[', '(').replace(']', ')')} THEN 0 END"
    collapse = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    return {
        "discourse_usage": f"WITH {voice} SELECT lang, marker, count(*) AS n FROM (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*'))) AS marker FROM voiced) WHERE marker IN ({discourse}) GROUP BY ALL",
        "voice_ratios": f"WITH {voice}, {style.replace('FROM documents', 'FROM voiced')} SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE marks / n END, 6) AS discourse_marker_ratio, round(CASE WHEN n = 0 THEN 0 ELSE {contractions} / n END, 6) AS contraction_ratio FROM style",
        "semi_benchmark_overlap": r"""WITH a AS (SELECT text FROM documents UNION ALL SELECT '  ' || text || chr(10) FROM benchmark WHERE item_id % 2 = 0)
SELECT count(*) AS n_present FROM a WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') IN (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') FROM benchmark)""",
        "feature_moments": f"WITH {features} " + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS feature, round(avg({n}), 6) AS mean, round(CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END, 6) AS scale FROM f" for i, n in enumerate(m.feature_names)),
        "fixed_model_scores": f"WITH {features}, p AS (SELECT doc_id, 1 / (1 + exp(-({m.intercept!r}::DOUBLE + {' + '.join(terms)}))) AS p FROM f) SELECT doc_id, round(p, 6) AS probability, (p >= 0.5)::BIGINT AS predicted FROM p",
        "fixed_model_contributions": f"""WITH {features}, c AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS i, '{n}' AS name, {n} AS value, {t} AS c FROM f" for i, (n, t) in enumerate(zip(m.feature_names, terms)))}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(c) DESC, i) AS place FROM c)
SELECT doc_id, place, name, round_even(value, 6) AS value, round_even(c, 6) + 0.0::DOUBLE AS contribution FROM r WHERE place <= 5""",
        "fixed_model_weights": f"WITH {features}, e AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, {w!r}::DOUBLE AS weight, {w!r}::DOUBLE * stddev_pop({n}) / {c!r}::DOUBLE AS effect FROM f" for n, w, c in zip(m.feature_names, m.weights, m.scales))}) SELECT row_number() OVER (ORDER BY abs(effect) DESC, name) AS place, name, weight, round(effect, 6) AS effect FROM e",
        "sentence_spread": f"""WITH {sentence_scores}, g AS (SELECT doc_id, avg(perplexity) AS m, coalesce(stddev_samp(perplexity), 0) AS s FROM ss WHERE token_count > 0 GROUP BY doc_id)
SELECT doc_id, round(m, 6) AS sentence_perplexity_mean, round(s, 6) AS sentence_perplexity_std, round(CASE WHEN m = 0 THEN 0 ELSE s / m END, 6) AS perplexity_burstiness FROM g""",
        "token_ranges": f"""WITH {sentences},
l AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
tk AS (SELECT doc_id, i, i * {TOKEN_CHARS} AS a, least(i * {TOKEN_CHARS} + {TOKEN_CHARS}, n) AS b, -0.25::DOUBLE * (1 + i % 7) AS logprob FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // {TOKEN_CHARS} + 1)) AS i FROM l)),
j AS (SELECT s.doc_id, s.sid, count(logprob) AS token_count, avg(logprob) AS m FROM sent s LEFT JOIN tk ON tk.doc_id = s.doc_id AND tk.b > s.start_char AND tk.a < s.start_char + length(s.t) GROUP BY s.doc_id, s.sid)
SELECT doc_id, sid, token_count, round(coalesce(m, 0), 6) AS mean_logprob, round(CASE WHEN m IS NULL THEN 0 ELSE exp(least(-m, 20)) END, 6) AS perplexity FROM j""",
        "normalized_texts": r"SELECT doc_id, md5(nfc_normalize(replace(coalesce(text, ''), '. ', '.' || chr(10))) || chr(10) || 'fine A x2 1') AS text_md5 FROM documents",
        "excerpts": f"SELECT doc_id, md5(substring(coalesce(text, ''), 1, 400)) AS excerpt_md5, substring({collapse}, 1, 150) AS line FROM documents",
        "label_spellings": f"SELECT doc_id, ({coerced(spelled)})::BIGINT AS from_text, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 END::BIGINT AS from_number FROM documents",
        "dropped_labels": f"SELECT label, count(*) AS n FROM (SELECT {spelled} AS label FROM documents) WHERE ({coerced('label')}) IS NULL GROUP BY label ORDER BY n DESC, label LIMIT 5",
        "excerpt_join": rf"""WITH h AS (SELECT doc_id, substring({collapse}, 1, 120) AS h, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id AS cache_id, substring({collapse.replace("coalesce(text, '')", "substring(text, 1, 400)")}, 1, 120) AS h FROM h),
f AS (SELECT h, min(doc_id) AS doc_id FROM h GROUP BY h)
SELECT cache_id, doc_id FROM k LEFT JOIN f USING (h)""",
        "failure_reasons": f"""WITH damaged AS (SELECT doc_id, CASE doc_id % 11 WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) || ' ' WHEN 3 THEN '12 34. 5!' WHEN 4 THEN '12 34. 5!' ELSE text END AS text FROM documents),
{style.replace("FROM documents", "FROM damaged")}, {sentences.replace("FROM documents", "FROM damaged")}, k AS (SELECT doc_id, count(*) AS sents FROM sent GROUP BY doc_id),
r AS (SELECT CASE WHEN length(t) = 0 THEN 'empty text' WHEN sents IS NULL THEN 'no scoreable sentences' WHEN n = 0 THEN 'no words' WHEN doc_id % 17 = 0 THEN 'non-finite feature' END AS fail_reason FROM style LEFT JOIN k USING (doc_id))
SELECT fail_reason, count(*) AS n FROM r WHERE fail_reason IS NOT NULL GROUP BY fail_reason""",
        "held_out_row": f"""WITH s AS ({known['md5_split']}) SELECT doc_id, source FROM s JOIN documents USING (doc_id) WHERE is_test
ORDER BY CASE source WHEN 'src7' THEN 0 WHEN 'src3' THEN 1 ELSE 2 END, doc_id LIMIT 1""",
        "variant_tally": f"SELECT prompt_variant, count(*) AS n FROM ({known['sample_and_rotate']}) GROUP BY prompt_variant",
        "corpus_files": rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text <> ''),
r AS (SELECT 'even_essays.csv' AS source, ({coerced(spelled)}) AS label, text FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'odd.csv', CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END, text FROM d WHERE doc_id % 2 = 1)
SELECT source, label::BIGINT AS label, md5(text) AS text_md5 FROM r WHERE label IS NOT NULL""",
        "json_lines": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS text, NULL::VARCHAR AS original_text FROM documents",
    }
