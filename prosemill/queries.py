"""Registered queries over the driver's tables, and the same in DuckDB SQL.

``labels.quality`` and ``documents.source`` stand in for a label and a source to
exercise the operators; accuracies from them mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model_queries, more_queries
from .functions.lexicon import ABBREVIATIONS, DISCOURSE_MARKERS, FEATURE_NAMES, STOPWORDS
from .functions.text import raw_word_count, word_count
from .operators import corpus, explain, limiter, metrics, model, splits
from .operators import language_model as lm
from .operators.block_scores import blocks, score_blocks, sentence_rows
from .operators.sentences import split_with_offsets
from .operators.signals import rhythm_features, scored_features, style_features
from .plans import pipelines
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]

#: Weights for the queries on deviations: any fixed numbers do.
FIXED_WEIGHTS = {"sentence_perplexity_std": -0.8, "sentence_length_std": 0.5}
HITS, SECONDS = 3, 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", word_count(text).cast("long").alias("n_words"), raw_word_count(text).cast("long").alias("n_tokens"))


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_with_offsets(_documents(spark, sf_dir))
    return rows.select("doc_id", F.col("sid").cast("long").alias("sid"), F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"), F.col("word_count").cast("long").alias("word_count"), F.md5("text").alias("text_md5"))


def signals_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rhythm_features(_documents(spark, sf_dir))
    return rows.select("doc_id", F.col("sentence_count").cast("long").alias("sentence_count"), *map(_r, ("burstiness", "sentence_length_mean", "sentence_length_std", "sentence_length_cv")))


def signals_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_features(_documents(spark, sf_dir)).select("doc_id", *map(_r, ("type_token_ratio", "hapax_ratio", "avg_word_length", "stopword_ratio", "punctuation_density", "comma_per_sentence", "discourse_marker_ratio")))


def signals_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_features(_documents(spark, sf_dir)).select("doc_id", *map(_r, ("contraction_ratio", "uppercase_ratio", "digit_ratio")))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id", "left")


def corpus_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.funnel(_corpus(spark, sf_dir))


def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean(_corpus(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("label").cast("long").alias("label"), F.md5("text").alias("text_md5"))


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.class_balance(_labels(spark, sf_dir))
    return rows.select("n_human", "n_ai", *map(_r, ("pct_human", "pct_ai", "imbalance_ratio", "majority_baseline")), "majority_class", "minority_class", "is_skewed")


def length_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_stats(_documents(spark, sf_dir, "source"), "source").select("source", "n_docs", "min_words", _r("median_words"), _r("mean_words"), "max_words")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir, "source").join(_labels(spark, sf_dir), "doc_id")
    return corpus.value_counts(rows, "source", "label")


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_count(table(spark, sf_dir, "documents").select("source"), "source")


def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def md5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_labels(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "is_test")


def md5_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(_labels(spark, sf_dir), "doc_id", "label").select("doc_id", "label", F.col("fold").cast("long").alias("fold"))


def sample_and_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rotate_variants(splits.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")).select("doc_id", F.col("position").cast("long").alias("position"), "prompt_variant")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed score, their type-token ratio, in folds."""
    ratio = style_features(_documents(spark, sf_dir)).select("doc_id", F.round("type_token_ratio", 4).alias("probability"))
    rows = splits.stratified_folds(_labels(spark, sf_dir), "doc_id", "label").join(ratio, "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.with_prediction(rows)


def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_scored(spark, sf_dir)).select("class", *map(_r, ("precision", "recall", "f1")), "support")


def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by_source(_scored(spark, sf_dir)).select("source", "n", "correct", _r("accuracy"), "labels")


def roc_auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, sf_dir)).select(_r("roc_auc"))


def fold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fold_accuracy(_scored(spark, sf_dir)).select("n_folds", _r("mean_accuracy"), _r("std_accuracy"))


def source_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_gap(_scored(spark, sf_dir), "src1", "src0").select(_r("base_accuracy"), _r("other_accuracy"), _r("gap"), "finding")


def top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst_errors(_scored(spark, sf_dir), "doc_id").select("doc_id", "label", _r("probability"), _r("certainty"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the bigram model of all."""
    own = blocks(_documents(spark, sf_dir))
    scores = score_blocks(own)
    tables.discard(own)
    return scores


def doc_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_features(_scores(spark, sf_dir)).select("doc_id", *map(_r, ("perplexity", "mean_token_logprob", "std_token_logprob", "median_token_logprob", "mean_token_entropy")))


def _sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(_scores(spark, sf_dir))


def sentence_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentence_scores(spark, sf_dir).select("doc_id", F.col("sid").cast("long").alias("sid"), "token_count", _r("mean_logprob"), _r("perplexity"))


def pooled_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = model.sentence_moments(_sentence_scores(spark, sf_dir)).join(_labels(spark, sf_dir).filter("label = 0"), "doc_id", "left_semi")
    return model.pooled_calibration(moments).select("n_sentences", _r("logprob_mean"), _r("logprob_std"))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _documents(spark, sf_dir).select("doc_id", raw_word_count(F.col("text")).cast("long").alias("n_tokens"))
    return lm.window_plan(lengths)


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.deviations(_sentence_scores(spark, sf_dir), FIXED_WEIGHTS)


def sentence_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deviations(spark, sf_dir).select("doc_id", F.col("sid").cast("long").alias("sid"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("ppl_z", "length_z", "combined")], "dominant", "direction")


def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = style_features(_documents(spark, sf_dir)).select("doc_id", F.round("type_token_ratio", 4).alias("probability"))
    rows = explain.flags(_deviations(spark, sf_dir).join(ratio, "doc_id"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if("flagged").alias("n_flagged"), F.count_if(F.col("reason") == explain.REASON_PERPLEXITY).alias("n_predictable"), F.count_if(F.col("reason") == explain.REASON_TOO_FEW).alias("n_unlocalized"))


def essay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.essay_gate(_documents(spark, sf_dir)).select("doc_id", "n_chars_trimmed", "n_words", F.col("status").cast("long").alias("status"))


def length_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = explain.length_state(raw_word_count(F.coalesce("text", F.lit(""))))
    return _documents(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probability")
    return _scored(spark, sf_dir).select("doc_id", _r("probability"), explain.short_label(p).alias("label_text"), explain.confidence_label(p).alias("sentence"), explain.confidence(p).alias("confidence"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), time.alias("ts"), "event_id")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = limiter.rate_limit(_hits(spark, sf_dir), HITS, SECONDS)
    return rows.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"), F.round("retry_after", 3).alias("retry_after"), F.when(~F.col("allowed"), limiter.retry_header(F.col("retry_after"))).alias("retry_header"))


def rate_limit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return limiter.limiter_summary(limiter.rate_limit(_hits(spark, sf_dir), HITS, SECONDS)).select("key", "n_hits", "n_allowed")


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_documents(spark, sf_dir))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[model.ModelBundle, DataFrame]:
    """A model of all features, each to six digits."""
    rows, _ = pipelines.training_rows(_documents(spark, sf_dir, "source"), _labels(spark, sf_dir))
    return pipelines.train(tables.stored(rows.withColumns({f: F.round(f, 6) for f in FEATURE_NAMES})))


def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held = _trained(spark, sf_dir)
    return held.select("doc_id", "label", _r("probability"), "predicted")


def essay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle, _ = _trained(spark, sf_dir)
    answers = pipelines.analyze(_documents(spark, sf_dir), bundle, _bigrams(spark, sf_dir))
    return answers.select("doc_id", F.col("status").cast("long").alias("status"), "error", "overall_probability", "confidence_label", "label", "confidence", F.to_json("signals").alias("signals"), F.to_json("sentences").alias("sentences"), "flagged_sentence_count", F.to_json("top_features").alias("top_features"))


QUERIES: tuple[Query, ...] = (
    doc_words, doc_sentences, signals_rhythm, signals_style, signals_surface, corpus_funnel, corpus_clean, class_balance, length_stats_by_source,
    label_counts, distinct_sources, pending_anti, md5_split, md5_folds, sample_and_rotate, confusion_report, accuracy_by_source, roc_auc_rank,
    fold_accuracy, source_gap, top_failures, doc_perplexity, sentence_perplexity, pooled_calibration, window_plan, sentence_deviation, sentence_flags, essay_gate,
    length_states, score_labels, rate_limit, rate_limit_summary, logistic_scores, essay_report,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (*QUERIES, *more_queries.QUERIES, *model_queries.QUERIES)}


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_WORDS = "regexp_extract_all(t, '[A-Za-z][A-Za-z''’-]*')"
_SENTENCES = rf"""
raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]+["''”’)\]]*)(\s+|$)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS ps FROM raw),
piece AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM cut),
token AS (SELECT *, regexp_matches(p, '(^|[^.!?])[.]' || chr(1)) AS lone, lower(regexp_extract(p, '([\pL\pN.]*)[.]' || chr(1), 1)) AS w FROM piece),
bound AS (SELECT doc_id, i, p, (contains(p, chr(1)) AND NOT (lone AND (w IN ({_in(ABBREVIATIONS)}) OR regexp_full_match(w, '\pL'))))::INT AS b FROM token),
grouped AS (SELECT doc_id, i, replace(p, chr(1), '') AS p, sum(b) OVER (PARTITION BY doc_id ORDER BY i) - b AS g,
  coalesce(sum(length(replace(p, chr(1), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM bound),
joined AS (SELECT doc_id, g, min(off) AS off, string_agg(p, '' ORDER BY i) AS s FROM grouped GROUP BY doc_id, g),
trimmed AS (SELECT doc_id, g, off + length(regexp_extract(s, '^\s*')) AS start_char, regexp_replace(s, '^\s+|\s+$', '', 'g') AS t FROM joined),
sent AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sid, start_char, t, len({_WORDS}) AS word_count FROM trimmed WHERE t <> '')"""

_STYLE = rf"""
doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
dw AS (SELECT doc_id, t, list_transform({_WORDS}, lambda x: lower(x)) AS w FROM doc),
ew AS (SELECT doc_id, unnest(w) AS word FROM dw),
cw AS (SELECT doc_id, word, count(*) AS c FROM ew GROUP BY ALL),
hw AS (SELECT doc_id, count(*) AS types, count(*) FILTER (c = 1) AS once, sum(c * length(word)) AS chars,
  sum(c) FILTER (word IN ({_in(STOPWORDS)})) AS stops, sum(c) FILTER (word IN ({_in(DISCOURSE_MARKERS)})) AS marks FROM cw GROUP BY doc_id),
style AS (SELECT d.doc_id, t, len(w) AS n, types, once, chars, coalesce(stops, 0) AS stops, coalesce(marks, 0) AS marks FROM dw d LEFT JOIN hw USING (doc_id))"""

_SCORED = rf"""{_STYLE},
folds AS (SELECT doc_id, quality AS label, (row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1)
  % least(5, greatest((SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)), 2)) AS fold FROM labels),
sc AS (SELECT f.doc_id, label, fold, source, probability, (probability >= 0.5)::INT AS predicted FROM folds f
  JOIN (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(types / n, 4) END AS probability FROM style) USING (doc_id) JOIN documents USING (doc_id))"""

_TOKENS = rf"""{_SENTENCES},
sw AS (SELECT doc_id, sid, unnest(list_transform({_WORDS}, lambda x: lower(x))) AS word, generate_subscripts({_WORDS}, 1) AS i FROM sent),
wt AS MATERIALIZED (SELECT doc_id, sid, word, lag(word) OVER (PARTITION BY doc_id ORDER BY sid, i) AS prev FROM sw),
pc AS (SELECT prev, word, count(*) AS c FROM wt WHERE prev IS NOT NULL GROUP BY ALL),
voc AS (SELECT count(DISTINCT word)::DOUBLE AS v FROM wt),
tot AS (SELECT prev, sum(c)::DOUBLE AS total FROM pc GROUP BY prev),
seen AS MATERIALIZED (SELECT prev, word, v, total, ln((c + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v)) AS logprob FROM pc JOIN tot USING (prev), voc),
ctx AS (SELECT prev, any_value(ln(0.1::DOUBLE / (total + 0.1::DOUBLE * v))) AS unseen,
  sum(-exp(logprob) * logprob) - (any_value(v) - count(*)) * any_value(0.1::DOUBLE / (total + 0.1::DOUBLE * v)) * any_value(ln(0.1::DOUBLE / (total + 0.1::DOUBLE * v))) AS entropy FROM seen GROUP BY prev),
tok AS MATERIALIZED (SELECT doc_id, sid, logprob, entropy FROM wt JOIN seen USING (prev, word) JOIN ctx USING (prev))"""

_SENTENCE_SCORES = rf"""{_TOKENS},
ss AS MATERIALIZED (SELECT s.doc_id, s.sid, word_count, coalesce(n, 0) AS token_count, coalesce(m, 0) AS mean_logprob, CASE WHEN m IS NULL THEN 0 ELSE exp(least(-m, 20)) END AS perplexity
  FROM sent s LEFT JOIN (SELECT doc_id, sid, count(*) AS n, avg(logprob) AS m FROM tok GROUP BY doc_id, sid) USING (doc_id, sid))"""

_PPL_WEIGHT, _LENGTH_WEIGHT = explain.signal_weights(FIXED_WEIGHTS)
_DEVIATIONS = rf"""{_SENTENCE_SCORES},
st AS (SELECT doc_id, count(*) AS k, avg(perplexity) AS pm, coalesce(stddev_samp(perplexity), 0) AS ps, avg(word_count) AS lm, coalesce(stddev_samp(word_count), 0) AS ls
  FROM ss WHERE token_count > 0 GROUP BY doc_id),
zz AS (SELECT ss.doc_id, sid, token_count, coalesce(k, 0) >= 4 AS localized,
  CASE WHEN token_count > 0 AND ps > 1e-9 THEN (perplexity - pm) / ps ELSE 0 END AS pz, CASE WHEN token_count > 0 AND ls > 1e-9 THEN (word_count - lm) / ls ELSE 0 END AS lz
  FROM ss LEFT JOIN st USING (doc_id)),
cc AS (SELECT *, {_PPL_WEIGHT}::DOUBLE * greatest(-pz, 0) AS pw, {_LENGTH_WEIGHT}::DOUBLE * greatest(lz, 0) AS lw FROM zz),
dev AS MATERIALIZED (SELECT doc_id, sid, token_count, localized, CASE WHEN localized THEN pz END AS ppl_z, CASE WHEN localized THEN lz END AS length_z,
  CASE WHEN localized THEN greatest(pw, lw) END AS combined,
  CASE WHEN localized AND greatest(pw, lw) > 0 THEN CASE WHEN pw >= lw THEN 'perplexity' ELSE 'length' END END AS dominant,
  CASE WHEN localized AND greatest(pw, lw) > 0 THEN CASE WHEN pw >= lw THEN 'low' ELSE 'high' END END AS direction FROM cc)"""

_STAGED = r"""
c AS (SELECT doc_id, text, quality AS label, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS key FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT *, label IS NOT NULL AS labelled, label IS NOT NULL AND key <> '' AS has_text, label IS NOT NULL AND len(regexp_extract_all(key, '\S+')) >= 50 AS long FROM c),
g AS (SELECT *, long AND row_number() OVER (PARTITION BY key, long ORDER BY doc_id) = 1 AS first FROM f)"""

_LIMITED = f"""RECURSIVE e AS (
  SELECT user_id::VARCHAR AS key, epoch_us(ts) / 1e6 AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT key, n, event_id, [ts] AS hits, true AS allowed, {HITS - 1} AS remaining, 0.0::DOUBLE AS wait FROM e WHERE n = 1
  UNION ALL
  SELECT key, n, event_id, CASE WHEN len(live) >= {HITS} THEN live ELSE list_append(live, ts) END, len(live) < {HITS}, greatest({HITS} - len(live) - 1, 0),
    CASE WHEN len(live) >= {HITS} THEN greatest(live[1] + {SECONDS} - ts, 0) ELSE 0 END
  FROM (SELECT e.*, list_filter(r.hits, lambda h: h > e.ts - {SECONDS}) AS live FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))"""

_REPORT = """q AS (SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM sc),
pr AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, tn + fp AS support FROM q
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn FROM q),
fs AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


def oracle_sql() -> dict[str, str]:
    punctuation = r"len(regexp_extract_all(t, '\pP'))"
    contractions = r"len(regexp_extract_all(t, '(?i)[\pL\pN_]+[''’](?:t|s|re|ve|ll|d|m)(?:[^\pL\pN_]|$)'))"
    digits, tokens = r"len(regexp_extract_all(t, '\p{Nd}'))", r"regexp_extract_all(t, '\S+')"
    guard = lambda top, bottom="n": f"round(CASE WHEN n = 0 THEN 0 ELSE {top} / {bottom} END, 6)"
    known = {
        "doc_words": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''’-]*')) AS n_words, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n_tokens FROM documents",
        "doc_sentences": f"WITH {_SENTENCES} SELECT doc_id, sid, start_char::BIGINT AS start_char, (start_char + length(t))::BIGINT AS end_char, word_count, md5(t) AS text_md5 FROM sent",
        "signals_rhythm": f"""WITH {_SENTENCES},
x AS (SELECT doc_id, avg(word_count) AS m, coalesce(stddev_samp(word_count), 0) AS s FROM sent WHERE word_count > 0 GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS sentence_count, round(coalesce((s - m) / nullif(s + m, 0), 0), 6) AS burstiness, round(coalesce(m, 0), 6) AS sentence_length_mean,
  round(coalesce(s, 0), 6) AS sentence_length_std, round(coalesce(s / nullif(m, 0), 0), 6) AS sentence_length_cv
FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "signals_style": rf"""WITH {_STYLE}, {_SENTENCES}, k AS (SELECT doc_id, count(*) AS sents FROM sent GROUP BY doc_id)
SELECT doc_id, {guard('types')} AS type_token_ratio, {guard('once')} AS hapax_ratio, {guard('chars')} AS avg_word_length, {guard('stops')} AS stopword_ratio,
  {guard(punctuation)} AS punctuation_density,
  {guard("(length(t) - length(replace(t, ',', '')))", "greatest(coalesce(sents, 0), 1)")} AS comma_per_sentence, {guard('marks')} AS discourse_marker_ratio
FROM style LEFT JOIN k USING (doc_id)""",
        "signals_surface": rf"""WITH {_STYLE}
SELECT doc_id, {guard(contractions)} AS contraction_ratio,
  {guard(f"len(list_filter({tokens}, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1))", f"greatest(len({tokens}), 1)")} AS uppercase_ratio,
  {guard(digits, "greatest(length(t), 1)")} AS digit_ratio FROM style""",
        "corpus_funnel": f"WITH {_STAGED} SELECT count(*) AS n_raw, count(*) FILTER (labelled) AS n_labelled, count(*) FILTER (has_text) AS n_with_text, count(*) FILTER (long) AS n_long_enough, count(*) FILTER (first) AS n_unique FROM g",
        "corpus_clean": f"WITH {_STAGED} SELECT doc_id, label, md5(text) AS text_md5 FROM g WHERE first",
        "class_balance": """WITH n AS (SELECT count(*) FILTER (quality = 0) AS h, count(*) FILTER (quality = 1) AS a FROM labels)
SELECT h AS n_human, a AS n_ai, round(100.0 * h / (h + a), 6) AS pct_human, round(100.0 * a / (h + a), 6) AS pct_ai, round(greatest(h, a) / least(h, a), 6) AS imbalance_ratio,
  round(100.0 * greatest(h, a) / (h + a), 6) AS majority_baseline, CASE WHEN h >= a THEN 'human' ELSE 'AI' END AS majority_class, CASE WHEN h >= a THEN 'AI' ELSE 'human' END AS minority_class,
  greatest(h, a) / least(h, a) >= 1.5 AS is_skewed FROM n""",
        "length_stats_by_source": r"""WITH c AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents)
SELECT source, count(*) AS n_docs, min(n) AS min_words, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median_words, round(avg(n), 6) AS mean_words, max(n) AS max_words FROM c GROUP BY source""",
        "label_counts": "SELECT source, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
        "distinct_sources": "SELECT count(DISTINCT source) AS n_distinct FROM documents",
        "pending_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "md5_split": """SELECT doc_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM labels""",
        "md5_folds": f"WITH {_SCORED} SELECT doc_id, label, fold FROM folds",
        "sample_and_rotate": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents)
SELECT doc_id, position, ['light_grammar_flow', 'sentence_variety_word_choice', 'grammar_phrasing_keep_voice'][position % 3 + 1] AS prompt_variant FROM o WHERE position < 40""",
        "confusion_report": f"""WITH {_SCORED}, {_REPORT}
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM fs
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM fs
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM fs""",
        "accuracy_by_source": f"WITH {_SCORED} SELECT source, count(*) AS n, sum((label = predicted)::INT)::BIGINT AS correct, round(avg((label = predicted)::INT), 6) AS accuracy, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS labels FROM sc GROUP BY source",
        "roc_auc_rank": f"""WITH {_SCORED}, rk AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM sc)
SELECT round(((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)))::DOUBLE, 6) AS roc_auc FROM rk""",
        "fold_accuracy": f"WITH {_SCORED}, a AS (SELECT fold, avg((label = predicted)::INT) AS a FROM sc GROUP BY fold) SELECT count(*) AS n_folds, round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy FROM a",
        "source_gap": f"""WITH {_SCORED}, a AS (SELECT avg((label = predicted)::INT) FILTER (starts_with(source, 'src1')) AS b, avg((label = predicted)::INT) FILTER (contains(source, 'src0')) AS o FROM sc)
SELECT round(b, 6) AS base_accuracy, round(o, 6) AS other_accuracy, round(b - o, 6) AS gap, CASE WHEN b - o IS NULL THEN 'not computable' WHEN b - o > 0 THEN 'harder' ELSE 'not harder' END AS finding FROM a""",
        "top_failures": f"WITH {_SCORED} SELECT doc_id, label, round(probability, 6) AS probability, round(abs(probability - 0.5), 6) AS certainty FROM sc WHERE label <> predicted ORDER BY abs(probability - 0.5) DESC, doc_id LIMIT 3",
        "doc_perplexity": f"""WITH {_TOKENS} SELECT doc_id, round(exp(least(-avg(logprob), 20)), 6) AS perplexity, round(avg(logprob), 6) AS mean_token_logprob,
  round(coalesce(stddev_samp(logprob), 0), 6) AS std_token_logprob, round(quantile_cont(logprob, 0.5), 6) AS median_token_logprob, round(avg(entropy), 6) AS mean_token_entropy FROM tok GROUP BY doc_id""",
        "sentence_perplexity": f"WITH {_SENTENCE_SCORES} SELECT doc_id, sid, token_count, round(mean_logprob, 6) AS mean_logprob, round(perplexity, 6) AS perplexity FROM ss",
        "pooled_calibration": f"""WITH {_SENTENCE_SCORES} SELECT count(*) AS n_sentences, round(avg(mean_logprob), 6) AS logprob_mean, round(greatest(stddev_samp(mean_logprob), 1e-6), 6) AS logprob_std
FROM ss WHERE token_count > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
        "window_plan": r"""WITH l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n < 2 THEN 0 WHEN n <= 1024 THEN 1 ELSE 1 + ceil((n - 1024) / 512)::BIGINT END)) AS w FROM l)
SELECT doc_id, w AS "window", w * 512 AS first, least(w * 512 + 1024, n) AS last, least(w * 512 + 1024, n) - CASE WHEN w = 0 THEN 1 ELSE w * 512 + 512 END AS scored FROM w""",
        "sentence_deviation": f"WITH {_DEVIATIONS} SELECT doc_id, sid, round(ppl_z, 6) + 0.0::DOUBLE AS ppl_z, round(length_z, 6) + 0.0::DOUBLE AS length_z, round(combined, 6) + 0.0::DOUBLE AS combined, dominant, direction FROM dev",
        "sentence_flags": f"""WITH {_DEVIATIONS}, {_STYLE},
fl AS (SELECT doc_id, localized, dominant, localized AND token_count > 0 AND round(types / n, 4) >= 0.5 AND combined >= 1.5 AND abs(CASE WHEN dominant = 'perplexity' THEN ppl_z ELSE length_z END) >= 1.0 AS flagged
  FROM dev JOIN style USING (doc_id))
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (flagged AND dominant = 'perplexity') AS n_predictable, count(*) FILTER (NOT localized) AS n_unlocalized FROM fl GROUP BY doc_id""",
        "essay_gate": r"""WITH g AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS c, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w FROM documents)
SELECT doc_id, c AS n_chars_trimmed, w AS n_words, (CASE WHEN c < 250 OR c > 150000 THEN 422 WHEN w < 50 OR w > 20000 THEN 400 ELSE 200 END)::BIGINT AS status FROM g""",
        "length_states": r"""WITH c AS (SELECT len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents)
SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'too-short' WHEN n > 20000 THEN 'too-long' WHEN n > 2000 THEN 'long' ELSE 'ok' END AS state, count(*) AS n FROM c GROUP BY ALL""",
        "score_labels": f"""WITH {_SCORED}, p AS (SELECT *, round_even(probability * 100, 0)::INT AS pct FROM sc)
SELECT doc_id, round(probability, 6) AS probability, CASE WHEN probability >= 0.5 THEN 'Likely AI' ELSE 'Likely Human' END AS label_text,
  CASE WHEN probability >= 0.5 THEN printf('{explain.LABEL_AI}', pct) ELSE printf('{explain.LABEL_HUMAN.replace("'", "''")}', 100 - pct) END AS sentence,
  round_even(least(abs(probability - 0.5) / 0.5, 1.0), 4) AS confidence FROM p""",
        "rate_limit": f"WITH {_LIMITED} SELECT event_id, allowed, remaining::BIGINT AS remaining, round(wait, 3) AS retry_after, CASE WHEN NOT allowed THEN greatest(floor(wait + 0.999), 1)::BIGINT END AS retry_header FROM r",
        "rate_limit_summary": f"WITH {_LIMITED} SELECT key, count(*) AS n_hits, count(*) FILTER (allowed) AS n_allowed FROM r GROUP BY key",
    }
    known |= more_queries.oracle_sql(known, _STYLE, _SENTENCES, _SENTENCE_SCORES, _in(DISCOURSE_MARKERS))
    features = f"f AS MATERIALIZED (SELECT * FROM ({known['signals_style']}) JOIN ({known['signals_surface']}) USING (doc_id))"
    return known | model_queries.oracle_sql(known, {"features": features, "sentences": _SENTENCES, "sentence_scores": _SENTENCE_SCORES})
