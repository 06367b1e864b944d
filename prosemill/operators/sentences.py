"""Documents to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentence_pieces, sentences, strip, tokenize_words, word_count


def units(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``_sentences`` and ``_words``, the words of each: cut once, for all that reads them.

    What takes documents also takes these, so a plan that needs sentences in several
    places cuts and stores them first.
    """
    if "_words" in docs.columns:
        return docs.select("doc_id", "text", "_sentences", "_words")
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), sentences(text).alias("_sentences"))
    return cut.withColumn("_words", F.transform("_sentences", tokenize_words))


def cut_words(docs: DataFrame) -> DataFrame:
    """doc_id and ``_words`` of ``units``: what a language model reads, in a fraction of the texts' bytes."""
    return (docs if "_words" in docs.columns else units(docs)).select("doc_id", "_words")


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """``split_sentences`` without the texts, for which the words alone do."""
    return cut_words(docs).select("doc_id", F.posexplode(F.transform("_words", F.size)).alias("sid", "word_count"))


def split_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sid, text, word_count: a map over documents, no shuffle."""
    rows = units(docs).select("doc_id", F.posexplode(F.arrays_zip("_sentences", F.transform("_words", F.size))).alias("sid", "s"))
    return rows.select("doc_id", "sid", F.col("s._sentences").alias("text"), F.col("s.1").alias("word_count"))


def split_with_offsets(docs: DataFrame) -> DataFrame:
    """As ``split_sentences``, with start and end as code points of the text.

    Starts are running sums over the lengths of a document's pieces, which shuffles
    them by document, the sentences' texts only where they are used; use
    ``split_sentences`` where offsets are not needed.
    """
    pieces = docs.select("doc_id", F.posexplode(sentence_pieces(F.col("text"))).alias("pos", "piece"))
    cut = pieces.select("doc_id", "pos", F.length("piece").alias("_n"), F.length(F.regexp_extract("piece", r"(?U)^\s*", 0)).alias("_lead"), strip(F.col("piece")).alias("text"))
    measured = cut.select("*", F.length("text").alias("_m"), word_count(F.col("text")).cast("int").alias("word_count"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    at = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    solid = measured.withColumn("start", (at + F.col("_lead")).cast("int")).filter("_m > 0")
    return solid.select("doc_id", (F.row_number().over(order) - 1).alias("sid"), "text", "start", (F.col("start") + F.col("_m")).cast("int").alias("end"), "word_count")
