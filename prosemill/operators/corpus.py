"""Labelled corpora: column resolution, cleaning, funnel and balance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, raw_word_count, strip

#: Column names in order of preference.
TEXT_COLUMN_CANDIDATES = ("text", "essay", "full_text", "essay_text", "content")
LABEL_COLUMN_CANDIDATES = ("generated", "label", "is_generated", "ai_generated", "target", "class")

#: Spellings of the two labels.
TRUTHY = ("1", "true", "yes", "ai", "generated")
FALSY = ("0", "false", "no", "human")

MIN_WORDS = 50
PREPARE_SKEW = 3.0
TRAIN_SKEW = 1.5


class CorpusError(ValueError):
    """Input that cannot be read as a corpus."""


def resolve_column(columns: Sequence[str], candidates: Iterable[str], override: str | None = None) -> str | None:
    """The column that ``override`` names, exactly or in any case; else the first candidate in any case."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    if override:
        found = override if override in columns else by_lower.get(override.lower())
        if found is None:
            raise CorpusError(f"no column {override!r} among {list(columns)}")
        return found
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def admit(table: DataFrame, name: str, text: str | None = None, label: str | None = None) -> DataFrame | None:
    """text, label, _source; None for a table that is no labelled corpus; an error for labels without text."""
    text_col, label_col = resolve_column(table.columns, TEXT_COLUMN_CANDIDATES, text), resolve_column(table.columns, LABEL_COLUMN_CANDIDATES, label)
    if text_col is None and label_col is not None:
        raise CorpusError(f"{name}: label column {label_col!r} but no text column among {table.columns}")
    if text_col is None or label_col is None:
        return None
    return table.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").alias("label"), F.lit(name).alias("_source"))


def require_columns(table: DataFrame, needed: Iterable[str], name: str) -> DataFrame:
    missing = sorted(set(needed) - set(table.columns))
    if missing:
        raise CorpusError(f"{name}: missing {missing}, found {table.columns}")
    return table


def coerce_label(label: Column, kind: str = "string") -> Column:
    """0, 1 or null.  Numbers and booleans by value; text by spelling, so the text ``1.0`` is null."""
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or kind.startswith("decimal"):
        number = label.cast("double")
        return F.when(number.isin(0.0, 1.0), number.cast("int"))
    token = F.lower(strip(label.cast("string")))
    return F.when(token.isin(*TRUTHY), 1).when(token.isin(*FALSY), 0)


def drop_unlabelled(corpus: DataFrame) -> DataFrame:
    kind = dict(corpus.dtypes)["label"]
    return corpus.withColumn("label", coerce_label(F.col("label"), kind)).filter("label IS NOT NULL")


def bad_labels(corpus: DataFrame, k: int = 5) -> DataFrame:
    """The most common labels that are dropped."""
    kind = dict(corpus.dtypes)["label"]
    return corpus.filter(coerce_label(F.col("label"), kind).isNull()).groupBy(F.col("label").cast("string").alias("label")).count().orderBy(F.desc("count"), "label").limit(k)


def staged(corpus: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``corpus`` with what each stage keeps, and ``_digest``, a hash of the collapsed text, for long rows only."""
    keyed = corpus.withColumn("_key", collapsed(F.coalesce("text", F.lit(""))))
    passed = keyed.withColumns({"is_labelled": F.col("label").isNotNull(), "has_text": F.col("label").isNotNull() & (F.col("_key") != ""), "is_long": F.col("label").isNotNull() & (raw_word_count(F.col("_key")) >= min_words)})
    return passed.withColumn("_digest", F.when(F.col("is_long"), F.sha2("_key", 256))).drop("_key")


def clean(corpus: DataFrame, order: Sequence[str], min_words: int = MIN_WORDS) -> DataFrame:
    """Labelled rows with text of ``min_words`` or more, the first of each collapsed text; labels do not matter for that.

    Texts are read for their digests once, which are stored beside ``order``.  The
    first of a text is a partial minimum, so copies shuffle one row per task, and the
    keepers meet ``corpus`` by ``order``, which no two rows share: a text that a third of
    the rows hold is no hot key.  Where rows do share it, they are told apart by their
    digests, and of equal ones one stays.
    """
    from ..sources.tables import stored

    keys = [f"_o{i}" for i in range(len(order))]
    narrow = stored(staged(corpus, min_words).filter("is_long").select("_digest", *[F.col(c).alias(k) for c, k in zip(order, keys)]))
    keepers = narrow.groupBy("_digest").agg(F.min(F.struct(*keys)).alias("_first")).select("_first.*", F.col("_digest").alias("_d"))
    same = F.lit(True)
    for c, k in zip(order, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    if narrow.groupBy(*keys).count().filter("count > 1").isEmpty():
        return corpus.join(keepers, same, "left_semi")
    rows = staged(corpus, min_words).filter("is_long").join(keepers, same & (F.col("_digest") == F.col("_d")))
    return rows.dropDuplicates(["_digest"]).select(*corpus.columns)


def funnel(corpus: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows after each stage, from one pass of conditional counts over digests."""
    return staged(corpus, min_words).agg(F.count("*").alias("n_raw"), F.count_if("is_labelled").alias("n_labelled"), F.count_if("has_text").alias("n_with_text"), F.count_if("is_long").alias("n_long_enough"), F.countDistinct("_digest").alias("n_unique"))


def class_balance(labels: DataFrame, skew: float = TRAIN_SKEW) -> DataFrame:
    """Counts, shares, ratio of the classes, baseline and the names of the larger and the smaller class."""
    n = labels.agg(F.count_if(F.col("label") == 0).alias("n_human"), F.count_if(F.col("label") == 1).alias("n_ai"))
    larger, smaller = F.greatest("n_human", "n_ai"), F.least("n_human", "n_ai")
    total = F.col("n_human") + F.col("n_ai")
    imbalance = F.when(smaller == 0, F.lit(float("inf"))).otherwise(larger / F.when(smaller != 0, smaller))
    share = lambda x: F.when(total == 0, 0.0).otherwise(100.0 * x / F.when(total != 0, total))
    human = F.col("n_human") >= F.col("n_ai")
    return n.select("n_human", "n_ai", share(F.col("n_human")).alias("pct_human"), share(F.col("n_ai")).alias("pct_ai"), imbalance.alias("imbalance_ratio"), share(larger).alias("majority_baseline"), F.when(human, "human").otherwise("AI").alias("majority_class"), F.when(human, "AI").otherwise("human").alias("minority_class"), (imbalance >= skew).alias("is_skewed"))


def length_stats(docs: DataFrame, *by: str) -> DataFrame:
    """Least, median, mean and most words per group."""
    return docs.withColumn("_n", raw_word_count(F.coalesce("text", F.lit("")))).groupBy(*by).agg(F.count("*").alias("n_docs"), F.min("_n").cast("long").alias("min_words"), F.percentile("_n", F.lit(0.5)).alias("median_words"), F.avg("_n").alias("mean_words"), F.max("_n").cast("long").alias("max_words"))


def value_counts(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def distinct_count(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.countDistinct(column).alias("n_distinct"))


def present_in(table: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows of ``table`` whose stripped text is one of ``other``: a semi join on its hash and text."""
    return _by_text(table, column, other, other_column, "left_semi")


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select(key), key, "left_anti")


def _by_text(table: DataFrame, column: str, other: DataFrame, other_column: str, how: str) -> DataFrame:
    left = table.withColumn("_k", F.sha2(strip(F.col(column)), 256))
    return left.join(other.select(F.sha2(strip(F.col(other_column)), 256).alias("_k")), "_k", how).drop("_k")


def excerpt_source(cache: DataFrame, essays: DataFrame, order: Sequence[str], chars: int = 120) -> DataFrame:
    """Cache rows (text excerpt) with the first essay in ``order``, unique, that starts alike, white space collapsed.

    The first of a beginning is a partial minimum over narrow rows; the essay itself is
    fetched by its key, so that a common beginning is no hot key that carries texts.
    """
    head = lambda c: F.substring(collapsed(F.col(c)), 1, chars)
    first = essays.select(head("text").alias("_h"), F.struct(*order).alias("_key")).groupBy("_h").agg(F.min("_key").alias("_key"))
    whole = essays.select(F.struct(*order).alias("_k"), F.struct(*essays.columns).alias("essay"))
    found = first.join(whole, F.col("_key") == F.col("_k")).select("_h", "essay")
    return cache.withColumn("_h", head("excerpt")).join(found, "_h", "left").drop("_h")
