"""Registered queries on subwords, the back-off model, fits, folds, files and streams, and the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import DISCOURSE_MARKERS, FEATURE_NAMES, STOPWORDS
from .functions.numbers import rounded
from .functions.subwords import coded_tokens, piece_pattern, subword_pieces
from .functions.text import raw_word_count
from .more_queries import FIXED_MODEL, _documents, _features, _table
from .operators import backoff, corpus, explain, limiter, metrics, model, splits
from .plans import pipelines
from .sources import tables
from .streaming import limiter as streams

#: Pieces by rule: function words, connectives, and a consonant with a vowel.
VOCABULARY = tuple(dict.fromkeys((*STOPWORDS, *DISCOURSE_MARKERS, *(c + v for c in "bcdfghklmnprstvwz" for v in "aeiou"))))
WIDTH, OVERLAP = 64, 1
NEWTON_FEATURES = ("type_token_ratio", "stopword_ratio", "avg_word_length")
NEWTON_STEPS = 4
FIT_STEPS = 12
HITS, SECONDS = 3, 86_400.0


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


# --- subwords and the back-off model ------------------------------------------


def subword_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each text and their places, as digests."""
    cut = subword_pieces(_documents(spark, sf_dir), VOCABULARY)
    text = lambda f: F.md5(F.array_join(F.transform("pieces", f), " "))
    return cut.select("doc_id", F.size("pieces").cast("long").alias("n_tokens"), text(lambda p: p["piece"]).alias("pieces_md5"), text(lambda p: F.concat(p["start"].cast("string"), F.lit(":"), p["end"].cast("string"))).alias("offsets_md5"))


def _subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_tokens(_documents(spark, sf_dir), VOCABULARY)


def backoff_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and entropy of each text's pieces under the model of all."""
    tokens = _subwords(spark, sf_dir)
    scored = backoff.BackoffModel(tokens, start=-1).score_training(tokens)
    return scored.groupBy("doc_id").agg(F.count("*").alias("n_scored"), F.round(F.avg("logprob"), 6).alias("mean_logprob"), F.round(F.exp(F.least(-F.avg("logprob"), F.lit(20.0))), 6).alias("perplexity"), F.round(F.avg("entropy"), 6).alias("mean_entropy"))


def backoff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of pieces whose context begins anew, with the scores that each gives."""
    tokens = _subwords(spark, sf_dir)
    scored = backoff.BackoffModel(tokens, start=-1).score(backoff.in_windows(tokens, WIDTH, OVERLAP))
    lengths = tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    return backoff.window_scores(scored, lengths, WIDTH, OVERLAP).select("doc_id", "window", "first", "last", "scored", "n_scored", _r("mean_logprob"), _r("mean_entropy"))


# --- fits and scores ----------------------------------------------------------


def newton_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights after each of a few steps of Newton's method."""
    rows = tables.stored(_features(spark, sf_dir).select("doc_id", *NEWTON_FEATURES).join(_labels(spark, sf_dir), "doc_id"))
    found = sorted(model.feature_moments(rows, NEWTON_FEATURES).collect())
    moments = [r["mean"] for r in found], [r["scale"] for r in found]
    path = model.newton_path(rows, NEWTON_FEATURES, moments, (1.0, 1.0), NEWTON_STEPS, 0.0)
    return spark.createDataFrame([(step, name, round(float(v), 6)) for step, b in enumerate(path) for name, v in zip([*NEWTON_FEATURES, "(intercept)"], b)], "step long, name string, weight double")


def sentence_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood and phrase of the sentences that a response returns."""
    from .queries import _sentence_scores

    settings = explain.Settings()
    likelihood = model.sentence_likelihood(FIXED_MODEL, settings.sentence_zscore_offset, settings.sentence_zscore_slope)
    rows = _sentence_scores(spark, sf_dir).filter(F.col("sid") < settings.max_explained_sentences).withColumn("p", likelihood)
    return rows.select("doc_id", F.col("sid").cast("long").alias("sid"), F.bround("p", 4).alias("ai_likelihood"), explain.phrase(F.bround("p", 9)).alias("phrase"))


def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each text, a third of them with digits for letters, and the sentences that a response returns."""
    from .queries import _bigrams

    docs = _documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\p{L}", "7")).otherwise(F.col("text")))
    answers = pipelines.analyze(docs, FIXED_MODEL, _bigrams(spark, sf_dir))
    return answers.select("doc_id", F.col("status").cast("long").alias("status"), "error", F.size("sentences").cast("long").alias("n_returned"), F.size("top_features").cast("long").alias("n_features"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows of a score: percent, sentence count, highlight."""
    scores = _features(spark, sf_dir).select("doc_id", rounded(F.col("type_token_ratio"), 4).alias("p"), "comma_per_sentence")
    return scores.select("doc_id", explain.gauge_percent(F.col("p")).cast("long").alias("percent"), explain.flagged_summary(F.floor(F.col("comma_per_sentence")).cast("int"), F.lit(9)).alias("summary"), _highlight().alias("highlight"))


def _highlight() -> Column:
    return F.round(explain.highlight_intensity(F.col("comma_per_sentence") - 0.25), 6)


def _model_files(spark: SparkSession) -> DataFrame:
    names = list(NEWTON_FEATURES)
    bodies = {
        "named": {"feature_names": names, "feature_weights": {names[1]: -1.5, names[0]: 2.0}, "weights": [9, 9, 9], "intercept": 0.25},
        "listed": {"feature_names": names[::-1], "weights": [0.5, -2, 1.25], "intercept": -1},
        "nested": {"model": {"coef": [[1.0, 0.5, -0.125]], "intercept": [0.75]}, "version": "2"},
        "short": {"feature_names": names, "weights": [1.0], "intercept": 1.5},
    }
    rows = [F.struct(F.lit(k).alias("model_id"), F.lit(json.dumps(v)).alias("body")) for k, v in bodies.items()] + [F.struct(F.lit("broken").alias("model_id"), F.lit('{"weights": [1').alias("body"))]
    return spark.range(1).select(F.inline(F.array(*rows)))


def model_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by model files of several layouts."""
    features = _features(spark, sf_dir).select("doc_id", *NEWTON_FEATURES)
    return model.score_with(features, model.model_weights(_model_files(spark), NEWTON_FEATURES), "doc_id").select("doc_id", "model_id", _r("probability"))


# --- folds --------------------------------------------------------------------


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in groups: some sources whole, the others four ids each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source").endswith("7"), F.col("source")).otherwise(F.floor(F.col("doc_id") / 4).cast("string")).alias("grp"))
    return _labels(spark, sf_dir).join(docs, "doc_id")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_folds(_grouped(spark, sf_dir), "label", "grp").select("grp", F.col("fold").cast("long").alias("fold"))


# --- files --------------------------------------------------------------------


def column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of one column of a CSV table, and of one that it lacks."""
    path = f"{tables.scratch(spark)}/prompts.csv"
    tables.write_csv(_documents(spark, sf_dir, "source", "lang").drop("text").withColumnRenamed("source", "prompt_id"), path)
    found, missing = tables.read_columns(spark, path, ["prompt_id"]), tables.read_columns(spark, path, ["prompt"])
    return corpus.distinct_count(found, "prompt_id").withColumn("has_prompt", F.lit(missing is not None))


def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures appended as tab-separated lines by two writers, and tallied."""
    path = f"{tables.scratch(spark)}/failures.tsv"
    words = raw_word_count(F.coalesce("text", F.lit("")))
    reason = F.when(words < 50, "too\tshort").when(words > 2000, 'too "long"')
    rows = _documents(spark, sf_dir).select(F.lit("2025-01-01T00:00:00").alias("timestamp"), F.col("doc_id").alias("index"), F.element_at(F.array(*map(F.lit, splits.VARIANTS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("prompt_variant"), reason.alias("reason")).filter("reason IS NOT NULL")
    for part in (0, 1):
        tables.append_failures(spark, rows.filter(F.col("index") % 2 == part), path)
    return tables.read_failures(spark, path).groupBy("prompt_variant", "reason").agg(F.count("*").alias("n"), F.min("index").cast("long").alias("first_index"))


def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written in order, and each row's place in its file."""
    path = f"{tables.scratch(spark)}/lengths.csv"
    stats = corpus.length_stats(_documents(spark, sf_dir, "source"), "source")
    tables.write_csv(stats.select("source", "n_docs", "max_words"), path, [F.desc("max_words"), "source"])
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    read = tables.read_csv(spark, path, "source string, n_docs long, max_words long").select("*", place.alias("at"))
    return read.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "source", "n_docs", "max_words"))).alias("r")).select(F.posexplode("r").alias("i", "r")).select((F.col("i") + 1).cast("long").alias("place"), "r.source", "r.n_docs", "r.max_words")


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with bad ones among them: the last of each key, and what was skipped, counted by the pass that reads."""
    path = f"{tables.scratch(spark)}/cache.jsonl"
    docs = _documents(spark, sf_dir)
    good = F.to_json(F.struct((F.col("doc_id") % 700).cast("int").alias("index"), F.lit("m").alias("model"), F.lit("t").alias("text")))
    line = F.when(F.col("doc_id") % 11 == 0, F.lit('{"index": 3, "text')).when(F.col("doc_id") % 13 == 0, F.lit('{"text": "no key"}')).when(F.col("doc_id") % 17 == 0, F.lit("  ")).otherwise(good)
    docs.select(line.alias("value")).write.text(path)
    last, seen = tables.read_jsonl(spark, path)
    kept = tables.stored(last)
    return kept.agg(F.count("*").alias("n_keys"), F.min("index").cast("long").alias("first_key")).withColumns({c: F.lit(seen.get[c]).cast("long") for c in ("n_lines", "n_skipped")})


# --- streams ------------------------------------------------------------------


def _own_session(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of the same cluster with settings of its own, for what a stream needs."""
    own = spark.newSession()
    for key, value in ({"spark.sql.session.timeZone": "UTC"} | {k.replace("__", "."): v for k, v in conf.items()}).items():
        own.conf.set(key, value)
    return own


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; its path is a pattern, as the source takes a plain one for a folder."""
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/{name}.parquet*")


def rate_limit_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as a stream over all events with a table of keys that is far too small for them."""
    own = _own_session(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", spark__sql__shuffle__partitions="8")
    folder = tables.scratch(spark)
    hits = _stream(own, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id")
    decided = streams.rate_limit_evicting(hits, HITS, SECONDS, most_keys=64, buckets=16)
    decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"), F.round("retry_after", 3).alias("retry_after"), F.when(~F.col("allowed"), limiter.retry_header(F.col("retry_after"))).alias("retry_header"))


def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by client, told by the forwarded address where it is trusted."""
    events = _table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 50).cast("string"), F.lit(" , 10.9.9.9"))).alias("forwarded"), F.when(F.col("event_id") % 6 > 0, F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string"))).alias("host"))
    keys = [events.groupBy(limiter.client_key(F.col("forwarded"), F.col("host"), trusted).alias("client")).agg(F.count("*").alias("n")).withColumn("trusted", F.lit(trusted)) for trusted in (True, False)]
    return keys[0].unionByName(keys[1])


def committed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed into JSON lines after a try that broke off before its commit."""
    folder = tables.scratch(spark)
    work = lambda batch: batch.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    lines = tables.CommittedLines(f"{folder}/lines")
    lines.write(work(_documents(spark, sf_dir)), 0)  # lost before it was committed
    lines.write(work(_documents(spark, sf_dir)).limit(5), 99)  # a batch that never comes again
    own = _own_session(spark)
    for _ in range(2):  # run again when all is done, it adds nothing
        streams.resumable(_stream(own, sf_dir, "documents"), work, lines.path, f"{folder}/checkpoint").awaitTermination()
    lines.append(work(_documents(spark, sf_dir)), 0)
    return lines.read(spark, "doc_id long, text_md5 string").select("doc_id", "text_md5")


QUERIES = (
    subword_offsets, backoff_perplexity, backoff_windows, newton_weights, sentence_likelihoods, answer_shapes, display_values, model_layouts, grouped_folds,
    column_scan, failure_log, sorted_rows, malformed_lines, rate_limit_evictions, client_keys, committed_lines,
)


# --- SQL ----------------------------------------------------------------------


def newton_sql(k: int, steps: int) -> str:
    """Tables ``b0`` to ``b{steps}`` of Newton's method for ``tr`` (label, w, x with a 1 at its end), each system solved by elimination."""
    out = [f"ij AS (SELECT i, j FROM range(1, {k + 2}) AS a(i), range(1, {k + 2}) AS c(j))", f"b0 AS (SELECT list_transform(range(0, {k + 1}), lambda z: 0.0::DOUBLE) AS b)"]
    for s in range(steps):
        out += [
            f"p{s} AS MATERIALIZED (SELECT w, x, label, b, 1 / (1 + exp(-list_inner_product(x, b))) AS p FROM tr, b{s})",
            f"h{s} AS (SELECT i, j, sum(w * p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i <= {k} THEN 1 ELSE 0 END AS h FROM p{s}, ij GROUP BY i, j)",
            f"g{s} AS (SELECT i, sum(w * (p - label) * x[i]) + CASE WHEN i <= {k} THEN any_value(b[i]) ELSE 0 END AS g FROM p{s}, range(1, {k + 2}) AS r(i) GROUP BY i)",
            f"m{s} AS (SELECT list(list_append(r, g) ORDER BY i) AS m FROM (SELECT i, list(h ORDER BY j) AS r FROM h{s} GROUP BY i) JOIN g{s} USING (i))",
            f"""d{s} AS MATERIALIZED (SELECT list_transform(list_reduce(list_prepend(m, list_transform(range(1, {k + 2}), lambda c: [[c::DOUBLE]])),
  lambda a, c: list_transform(a, lambda r, i: CASE WHEN i = c[1][1] THEN list_transform(r, lambda v: v / r[c[1][1]::BIGINT])
    ELSE list_transform(r, lambda v, t: v - r[c[1][1]::BIGINT] / a[c[1][1]::BIGINT][c[1][1]::BIGINT] * a[c[1][1]::BIGINT][t]) END)), lambda r: r[{k + 2}]) AS d FROM m{s})""",
            f"b{s + 1} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v - d[i]) AS b FROM b{s}, d{s})",
        ]
    return ",\n".join(out)


def _standardised(names: tuple[str, ...], table: str, balanced: bool) -> str:
    """``mo``, the moments of ``table``, and ``x`` of any of its rows as an expression."""
    sd = ", ".join(f"avg({n}) AS {n}_m, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS {n}_s" for n in names)
    w = "count(*) / (2.0::DOUBLE * count(*) FILTER (label = 0)) AS w0, count(*) / (2.0::DOUBLE * count(*) FILTER (label = 1)) AS w1" if balanced else "1.0::DOUBLE AS w0, 1.0::DOUBLE AS w1"
    return f"mo AS MATERIALIZED (SELECT {sd}, {w} FROM {table})"


def _x(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"({n} - {n}_m) / {n}_s" for n in names) + ", 1.0::DOUBLE]"


_PIECES = rf"""
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{piece_pattern(VOCABULARY)}|[ \t\n\r\f\v]+') AS ps FROM documents),
flat AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cut),
placed AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM flat),
tk AS MATERIALIZED (SELECT doc_id, piece AS word, (e - length(piece))::BIGINT AS s, e::BIGINT AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM placed WHERE NOT regexp_matches(piece, '^[ \t\n\r\f\v]'))"""

#: The distribution of every context over all words and one unknown (''), from the definition.
_BACKOFF = f"""{_PIECES},
seq AS MATERIALIZED (SELECT doc_id, i, word, lag(word) OVER o AS p1, coalesce(lag(word, 2) OVER o, '') AS p2 FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c3 AS MATERIALIZED (SELECT p2, p1, word, count(*) AS c FROM seq WHERE p1 IS NOT NULL GROUP BY ALL),
c2 AS MATERIALIZED (SELECT p1, word, count(*) AS c FROM c3 GROUP BY ALL),
c1 AS (SELECT word, count(*) AS c FROM c2 GROUP BY ALL),
f1 AS MATERIALIZED (SELECT word, greatest(c - {backoff.DISCOUNT}::DOUBLE, 0) / sum(c) OVER () + {backoff.DISCOUNT}::DOUBLE * count(*) OVER () / sum(c) OVER () / (count(*) OVER () + 1) AS p FROM c1
  UNION ALL SELECT '', {backoff.DISCOUNT}::DOUBLE * count(*) / sum(c) / (count(*) + 1) FROM c1),
t2 AS (SELECT p1, sum(c)::DOUBLE AS n, count(*) AS k FROM c2 GROUP BY p1),
f2 AS MATERIALIZED (SELECT t2.p1, f1.word, greatest(coalesce(c, 0) - {backoff.DISCOUNT}::DOUBLE, 0) / n + {backoff.DISCOUNT}::DOUBLE * k / n * p AS p FROM t2 CROSS JOIN f1 LEFT JOIN c2 ON c2.p1 = t2.p1 AND c2.word = f1.word),
t3 AS (SELECT p2, p1, sum(c)::DOUBLE AS n, count(*) AS k FROM c3 GROUP BY ALL),
f3 AS MATERIALIZED (SELECT t3.p2, t3.p1, f2.word, greatest(coalesce(c, 0) - {backoff.DISCOUNT}::DOUBLE, 0) / n + {backoff.DISCOUNT}::DOUBLE * k / n * p AS p
  FROM t3 JOIN f2 ON f2.p1 = t3.p1 LEFT JOIN c3 ON c3.p2 = t3.p2 AND c3.p1 = t3.p1 AND c3.word = f2.word),
e2 AS (SELECT p1, -sum(p * ln(p)) AS h FROM f2 GROUP BY p1),
e3 AS (SELECT p2, p1, -sum(p * ln(p)) AS h FROM f3 GROUP BY ALL),
s3 AS (SELECT p2, p1, word, p, h FROM f3 JOIN c3 USING (p2, p1, word) JOIN e3 USING (p2, p1))"""

_REASONS = {"too short": 'too\tshort', "too long": 'too "long"'}


def oracle_sql(known: dict[str, str], parts: dict[str, str]) -> dict[str, str]:
    """``known`` has the SQL of the other queries; ``parts`` their common parts: sentence_scores, limited, gate, features of the fixed model."""
    three = ", ".join(NEWTON_FEATURES)
    settings = explain.Settings()
    likelihood = f"1 / (1 + exp(-greatest(least(((mean_logprob - {FIXED_MODEL.sentence_logprob_mean!r}::DOUBLE) / {FIXED_MODEL.sentence_logprob_std!r}::DOUBLE - {settings.sentence_zscore_offset!r}::DOUBLE) * {settings.sentence_zscore_slope!r}::DOUBLE, 30), -30)))"
    features = parts["features"]
    every = ", ".join(f"coalesce({n}, 0)::DOUBLE AS {n}" for n in FEATURE_NAMES)
    digits = "CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\\pL', '7', 'g') ELSE text END"
    gate = known["essay_gate"].replace("FROM documents", "FROM odd")
    deal = """deal(i, held, grp, fold) AS (
  SELECT 0::BIGINT, list_transform(range(0, 5), lambda z: [0, 0]::BIGINT[]), NULL::VARCHAR, NULL::BIGINT
  UNION ALL
  SELECT o, list_transform(held, lambda h, z: CASE WHEN z = f + 1 THEN [h[1] + n0, h[2] + n1] ELSE h END), grp, f FROM (
    SELECT l.o, l.n0, l.n1, held, l.grp, list_sort(list_transform(held, lambda h, z: [h[1] * l.n0 * w0 + h[2] * l.n1 * w1, h[1] + h[2], z - 1]))[1][3] AS f
    FROM deal JOIN lefts l ON l.o = deal.i + 1, weights))"""
    return {
        "subword_offsets": f"""WITH {_PIECES}, a AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS p, string_agg(s || ':' || e, ' ' ORDER BY i) AS o FROM tk GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_tokens, md5(coalesce(p, '')) AS pieces_md5, md5(coalesce(o, '')) AS offsets_md5 FROM documents LEFT JOIN a USING (doc_id)""",
        "backoff_perplexity": f"""WITH {_BACKOFF}
SELECT doc_id, count(*) AS n_scored, round(avg(ln(p)), 6) AS mean_logprob, round(exp(least(-avg(ln(p)), 20)), 6) AS perplexity, round(avg(h), 6) AS mean_entropy
FROM seq JOIN s3 USING (p2, p1, word) GROUP BY doc_id""",
        "backoff_windows": f"""WITH {_BACKOFF},
l AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY doc_id),
w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n < 2 THEN 0 WHEN n <= {WIDTH} THEN 1 ELSE 1 + ceil((n - {WIDTH}) / {WIDTH - OVERLAP})::BIGINT END)) AS w FROM l),
cov AS (SELECT doc_id, w, w * {WIDTH - OVERLAP} AS first, least(w * {WIDTH - OVERLAP} + {WIDTH}, n) AS last FROM w),
scoring AS (SELECT s.doc_id, s.i, min(w) AS w FROM seq s JOIN cov c ON c.doc_id = s.doc_id AND s.i > c.first AND s.i < c.last GROUP BY ALL),
ctx AS (SELECT s.doc_id, s.word, s.p1, CASE WHEN s.i - c.first > 1 THEN s.p2 ELSE '' END AS p2, c.w FROM scoring k JOIN seq s USING (doc_id, i) JOIN cov c ON c.doc_id = k.doc_id AND c.w = k.w),
sc AS (SELECT x.doc_id, x.w, ln(coalesce(f3.p, f2.p)) AS logprob, coalesce(e3.h, e2.h) AS h FROM ctx x LEFT JOIN f3 ON f3.p2 = x.p2 AND f3.p1 = x.p1 AND f3.word = x.word
  LEFT JOIN e3 ON e3.p2 = x.p2 AND e3.p1 = x.p1 LEFT JOIN f2 ON f2.p1 = x.p1 AND f2.word = x.word LEFT JOIN e2 ON e2.p1 = x.p1),
su AS (SELECT doc_id, w, count(*) AS n_scored, avg(logprob) AS a, avg(h) AS h FROM sc GROUP BY ALL)
SELECT c.doc_id, c.w AS "window", first, last, last - CASE WHEN c.w = 0 THEN 1 ELSE first + {OVERLAP} END AS scored, n_scored, round(a, 6) AS mean_logprob, round(h, 6) AS mean_entropy
FROM cov c LEFT JOIN su ON su.doc_id = c.doc_id AND su.w = c.w""",
        "newton_weights": f"""WITH {features}, r AS MATERIALIZED (SELECT quality AS label, {three} FROM f JOIN labels USING (doc_id)),
{_standardised(NEWTON_FEATURES, "r", False)}, tr AS MATERIALIZED (SELECT label, 1.0::DOUBLE AS w, {_x(NEWTON_FEATURES)} AS x FROM r, mo),
{newton_sql(len(NEWTON_FEATURES), NEWTON_STEPS)}, al AS ({" UNION ALL ".join(f"SELECT {s} AS step, b FROM b{s}" for s in range(NEWTON_STEPS + 1))}),
n AS (SELECT unnest({[*NEWTON_FEATURES, "(intercept)"]}) AS name, unnest(range(1, {len(NEWTON_FEATURES) + 2})) AS i)
SELECT step::BIGINT AS step, name, round(b[i], 6) AS weight FROM al, n""",
        "logistic_scores": f"""WITH RECURSIVE su AS ({known["signals_surface"]}), st AS ({known["signals_style"]}), rh AS ({known["signals_rhythm"]}), pe AS ({known["doc_perplexity"]}), sp AS ({known["sentence_spread"]}),
dw AS ({known["doc_words"]}),
al AS MATERIALIZED (SELECT doc_id, quality AS label, {every} FROM labels JOIN st USING (doc_id) JOIN su USING (doc_id) JOIN rh USING (doc_id) JOIN dw USING (doc_id) LEFT JOIN pe USING (doc_id) LEFT JOIN sp USING (doc_id)
  WHERE sentence_count > 0 AND n_words > 0),
fo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM al),
tn AS (SELECT * FROM fo WHERE NOT is_test), {_standardised(FEATURE_NAMES, "tn", True)},
tr AS MATERIALIZED (SELECT label, CASE WHEN label = 1 THEN w1 ELSE w0 END AS w, {_x(FEATURE_NAMES)} AS x FROM tn, mo),
{newton_sql(len(FEATURE_NAMES), FIT_STEPS)},
pr AS (SELECT doc_id, label, 1 / (1 + exp(-list_inner_product({_x(FEATURE_NAMES)}, b))) AS p FROM fo, mo, b{FIT_STEPS} WHERE is_test)
SELECT doc_id, label, round(p, 6) AS probability, (p >= 0.5)::INTEGER AS predicted FROM pr""",
        "sentence_likelihoods": f"""WITH {parts["sentence_scores"]}, l AS (SELECT doc_id, sid, {likelihood} AS p FROM ss WHERE sid < {settings.max_explained_sentences})
SELECT doc_id, sid, round_even(p, 4) AS ai_likelihood, CASE WHEN round_even(p, 9) >= {settings.sentence_flag_threshold} THEN '{explain.PHRASES[0]}' WHEN round_even(p, 9) >= 0.5 THEN '{explain.PHRASES[1]}' ELSE '{explain.PHRASES[2]}' END AS phrase FROM l""",
        "answer_shapes": f"""WITH odd AS (SELECT doc_id, {digits} AS text FROM documents), g AS ({gate}), {parts["sentences"].replace("FROM documents", "FROM odd")},
k AS (SELECT doc_id, count(*) AS n, sum(word_count) AS words FROM sent GROUP BY doc_id),
j AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(words, 0) AS words, status = 200 AND (n IS NULL OR words = 0) AS bare FROM g LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN bare THEN 400 ELSE status END::BIGINT AS status,
  CASE WHEN bare THEN 'The text has no sentences or words to analyse.' WHEN status = 422 THEN 'Essay must have {settings.min_essay_chars} to {settings.max_essay_chars} characters.'
    WHEN n_words < {settings.min_essay_words} THEN 'Essay is too short: ' || n_words || ' words. At least {settings.min_essay_words} are needed.'
    WHEN n_words > {settings.max_essay_words} THEN 'Essay is too long: ' || n_words || ' words. At most {settings.max_essay_words} are allowed.' END AS error,
  CASE WHEN status = 200 AND NOT bare THEN least(n, {settings.max_explained_sentences}) END AS n_returned, CASE WHEN status = 200 AND NOT bare THEN 5 END::BIGINT AS n_features FROM j""",
        "display_values": f"""WITH {features} SELECT doc_id, floor(round(type_token_ratio, 4) * 100 + 0.5)::BIGINT AS percent, floor(comma_per_sentence)::INTEGER || ' of 9 sentences flagged.' AS summary,
  round(CASE WHEN comma_per_sentence - 0.25 > 0 THEN least((comma_per_sentence - 0.25) / 2.5, 1) ELSE 0 END, 6) AS highlight FROM f""",
        "model_layouts": f"""WITH {features}, m(model_id, a, b, c, i) AS (VALUES ('named', 2.0::DOUBLE, -1.5::DOUBLE, 0.0::DOUBLE, 0.25::DOUBLE), ('listed', 1.25, -2, 0.5, -1), ('nested', 1, 0.5, -0.125, 0.75), ('short', 0, 0, 0, 1.5), ('broken', 0, 0, 0, 0))
SELECT doc_id, model_id, round(1 / (1 + exp(-(a * {NEWTON_FEATURES[0]} + b * {NEWTON_FEATURES[1]} + c * {NEWTON_FEATURES[2]} + i))), 6) AS probability FROM f, m""",
        "grouped_folds": f"""WITH RECURSIVE g AS (SELECT CASE WHEN source LIKE '%7' THEN source ELSE (doc_id // 4)::VARCHAR END AS grp, quality AS label FROM labels JOIN documents USING (doc_id)),
n AS (SELECT grp, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM g GROUP BY grp),
r AS (SELECT *, row_number() OVER (PARTITION BY n0, n1 ORDER BY md5('42:' || grp), grp) AS r, count(*) OVER (PARTITION BY n0, n1) AS k,
  '{{' || CASE WHEN n0 > 0 THEN '"0":' || n0 ELSE '' END || CASE WHEN n0 > 0 AND n1 > 0 THEN ',' ELSE '' END || CASE WHEN n1 > 0 THEN '"1":' || n1 ELSE '' END || '}}' AS kind FROM n),
lefts AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n0 + n1 DESC, kind, r) AS o FROM r WHERE r > k - k % 5),
weights AS (SELECT sum(n0 + n1)::BIGINT // sum(n0)::BIGINT AS w0, sum(n0 + n1)::BIGINT // sum(n1)::BIGINT AS w1 FROM n),
{deal}
SELECT grp, fold FROM deal WHERE grp IS NOT NULL UNION ALL SELECT grp, (r - 1) % 5 FROM r WHERE r <= k - k % 5""",
        "column_scan": "SELECT count(DISTINCT source) AS n_distinct, false AS has_prompt FROM documents",
        "failure_log": rf"""WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents)
SELECT ['light_grammar_flow', 'sentence_variety_word_choice', 'grammar_phrasing_keep_voice'][doc_id % 3 + 1] AS prompt_variant, CASE WHEN n < 50 THEN 'too' || chr(9) || 'short' ELSE 'too "long"' END AS reason, count(*) AS n, min(doc_id) AS first_index
FROM w WHERE n < 50 OR n > 2000 GROUP BY ALL""",
        "sorted_rows": r"""WITH c AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents), s AS (SELECT source, count(*) AS n_docs, max(n) AS max_words FROM c GROUP BY source)
SELECT row_number() OVER (ORDER BY max_words DESC, source) AS place, source, n_docs, max_words FROM s""",
        "malformed_lines": """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'bad' WHEN doc_id % 17 = 0 THEN 'blank' ELSE 'good' END AS k FROM documents)
SELECT count(DISTINCT doc_id % 700) FILTER (k = 'good') AS n_keys, min(doc_id % 700) FILTER (k = 'good') AS first_key, count(*) FILTER (k <> 'blank') AS n_lines, count(*) FILTER (k = 'bad') AS n_skipped FROM l""",
        "rate_limit_evictions": known["rate_limit"],
        "client_keys": """WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN '10.0.0.' || user_id % 50 END AS f, CASE WHEN event_id % 6 > 0 THEN 'host' || user_id % 20 END AS h FROM events)
SELECT coalesce(f, h, 'unknown') AS client, count(*) AS n, true AS trusted FROM e GROUP BY 1 UNION ALL SELECT coalesce(h, 'unknown'), count(*), false FROM e GROUP BY 1""",
        "committed_lines": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    }
