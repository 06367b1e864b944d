"""A back-off model of order three: interpolated Kneser-Ney.

The chance of a word after two others is its discounted share of what followed them,
and the discounted mass times the chance after one word, and so on down to the
uniform chance over all words and one for unknown ones:

    P3(w | u v) = max(c(uvw) - D, 0) / c(uv) + D k(uv) / c(uv) * P2(w | v)
    P2(w | v)   = max(n(vw) - D, 0) / n(v)   + D k(v) / n(v)   * P1(w)
    P1(w)       = max(n(w) - D, 0) / n       + D k / n         / (k + 1)

c counts words in place, n the different words before (its sums are over w), k the
different words after.  Contexts that were never seen leave all to the next order.

The entropy of a context needs no pass over the vocabulary.  What was not seen has
P = b * Q, with b the mass left over and Q the order below, so its part of the
sum of P log P follows from the sums of Q and Q log Q over all words, which are 1
and minus the entropy below, less those over the words that were seen.

A text's first word is not scored; its second one has no word two places before, and a
start mark stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.tables import stored
from .language_model import look_up, owner_window, window_plan

DISCOUNT = 0.75
START = ""

#: Triples of numbers that are broadcast at most, about 100 bytes each.
HOT_TRIPLES = 1_000_000


def _plogp(p: Column) -> Column:
    return p * F.log(p)


def _order(counts: DataFrame, context: list[str], below: DataFrame | None, shared: list[str], base: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """Seen words with ``p``, and contexts with the mass ``b`` left over and entropy ``h``; ``below`` has p and h of the order below.

    ``counts`` has the context, word and c.
    """
    totals = counts.groupBy(*context).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    totals = totals.withColumn("b", discount * F.col("kinds") / F.col("total"))
    seen = counts.join(totals.select(*context, "total", "b"), context) if context else counts.crossJoin(F.broadcast(totals.select("total", "b")))
    low = below.withColumnRenamed("p", "q").withColumnRenamed("h", "below") if below is not None else None
    joined = seen.join(low, [*shared, "word"]) if low is not None else seen.crossJoin(F.broadcast(base))
    priced = stored(joined.withColumn("p", F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("b") * F.col("q")).drop("total"))
    one = priced.groupBy(*context).agg(F.sum(_plogp(F.col("p"))).alias("s"), F.sum("q").alias("sq"), F.sum(_plogp(F.col("q"))).alias("sql"), F.max("below").alias("below"), F.max("b").alias("b"))
    entropy = -(F.col("s") + F.col("b") * (F.log("b") * (1 - F.col("sq")) - F.col("below") - F.col("sql")))
    return priced.select(*context, "word", "p", "c"), stored(one.select(*context, "b", entropy.alias("h")))


class BackoffModel:
    """Stored tables of the three orders: words with ``p``, contexts with ``b`` and ``h``."""

    def __init__(self, tokens: DataFrame, discount: float = DISCOUNT, start: str | int = START) -> None:
        """Fit on (word, prev, prev2), texts or numbers; all counts come from those of triples, so the tokens are read once."""
        self.start = start
        placed = tokens.filter("prev IS NOT NULL").select(F.coalesce("prev2", F.lit(start)).alias("prev2"), "prev", "word")
        three = stored(placed.groupBy("prev2", "prev", "word").agg(F.count("*").alias("c")))
        two = stored(three.groupBy("prev", "word").agg(F.count("*").alias("c")))
        one = two.groupBy("word").agg(F.count("*").alias("c"))
        # Uniform over the known words and one for all others; its entropy is the logarithm of their number.
        base = one.agg((1.0 / (F.count("*") + 1)).alias("q"), F.log(F.count("*") + 1).alias("below"))
        words, floor = _order(one, [], None, [], base, discount)
        self.unknown = floor.crossJoin(F.broadcast(base)).select((F.col("b") * F.col("q")).alias("unknown"), F.col("h").alias("h1"))
        self.one = words
        self.two, self.after_one = _order(two, ["prev"], words.drop("c").crossJoin(F.broadcast(self.unknown.select(F.col("h1").alias("h")))), [], base, discount)
        lower = self.two.drop("c").join(self.after_one.select("prev", "h"), "prev")
        self.three, self.after_two = _order(three, ["prev2", "prev"], lower, ["prev"], base, discount)

    def _met(self, tokens: DataFrame) -> DataFrame:
        asked = tokens.filter("prev IS NOT NULL").withColumn("prev2", F.coalesce("prev2", F.lit(self.start)))
        top = stored(self.three.join(self.after_two.select("prev2", "prev", "h"), ["prev2", "prev"]))
        return look_up(asked, top, ["prev2", "prev", "word"], hot=HOT_TRIPLES if isinstance(self.start, int) else None)

    def score_training(self, tokens: DataFrame) -> DataFrame:
        """As ``score`` for the tokens that the model was fitted on, all of whose triples it knows."""
        return self._met(tokens).select(*tokens.columns, F.log("p").alias("logprob"), F.col("h").alias("entropy"))

    def score(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` (word, prev, prev2) with ``logprob`` and ``entropy``, by the longest context that was seen.

        ``tokens`` are read more than once.  Triples that the model knows, almost all,
        take one look-up, common ones without a shuffle; only the others go down the orders.
        """
        met = self._met(tokens)
        out = [*tokens.columns, "logprob", "entropy"]
        known = met.filter("p IS NOT NULL").withColumns({"logprob": F.log("p"), "entropy": F.col("h")})
        rest = met.filter("p IS NULL").drop("p", "c", "h")
        rest = rest.join(self.after_two.select("prev2", "prev", F.col("b").alias("b3"), F.col("h").alias("h3")), ["prev2", "prev"], "left")
        rest = rest.join(self.after_one.select("prev", F.col("b").alias("b2"), F.col("h").alias("h2")), "prev", "left")
        rest = rest.join(self.two.select("prev", "word", F.col("p").alias("p2")), ["prev", "word"], "left").join(self.one.select("word", F.col("p").alias("p1")), "word", "left").crossJoin(F.broadcast(self.unknown))
        p1 = F.coalesce("p1", "unknown")
        p2 = F.coalesce("p2", F.coalesce("b2", F.lit(1.0)) * p1)
        fallen = rest.withColumns({"logprob": F.log(F.coalesce("b3", F.lit(1.0)) * p2), "entropy": F.coalesce("h3", "h2", "h1")})
        return known.select(*out).unionByName(fallen.select(*out))


def in_windows(tokens: DataFrame, width: int = Settings.perplexity_window_tokens, overlap: int = Settings.perplexity_window_stride) -> DataFrame:
    """``tokens`` with the ``window`` that scores each, and the words before it as far as that window has them.

    Windows of ``width`` tokens overlap by ``overlap``; a token's score is that of the first
    window that holds it and a word before it, and the context begins anew in each window.
    """
    overlap = max(1, min(overlap, width - 1))
    window = owner_window(F.col("tok_idx"), width, overlap)
    inside = F.col("tok_idx") - window * (width - overlap)
    return tokens.withColumns({"window": window, "prev2": F.when(inside > 1, F.col("prev2"))})


def window_scores(scored: DataFrame, lengths: DataFrame, width: int, overlap: int) -> DataFrame:
    """The windows of ``window_plan`` with the mean log-probability and entropy of the tokens that each scores."""
    sums = scored.groupBy("doc_id", "window").agg(F.count("*").alias("n_scored"), F.avg("logprob").alias("mean_logprob"), F.avg("entropy").alias("mean_entropy"))
    return window_plan(lengths, width, overlap).join(sums, ["doc_id", "window"], "left")
