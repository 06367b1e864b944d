"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are words.  ``allocate`` shares a budget of words over the sources by
weight, under a cap for each source.  A source's target divided by its size is
the expected number of copies of each of its documents: the whole part is taken
as it is, the fraction is rounded by the pivotal method.  A document with fractional
copies is paired with the next smaller ones of its group, and words are moved between
both sides, at random and without changing any expectation, until it is integral,
or one of them.  The words taken from the source change in no step but the last one of
all, which falls on a small document, as large ones are rounded first.  A source of
ten or so documents has no small ones to spare and misses its target by a few hundredths.

The pairing is a reduction tree.  Documents of a source are dealt by a hash of
their id into groups of about ``GROUP_UNITS``; each group leaves one fractional
document at most; ``FAN_IN`` groups meet on the next level, until one document
of the source is left, which a last draw rounds.  A level is stored before the
next reads it.  The draws depend on seed, source, level and group alone, so
reruns, retries and other partitionings agree.

Cases: a null text or one without words has size 0 and is taken 0 times; a null
source is a source of its own, last in order; rows with equal id, source and
size are one unit, of whose rows as many as possible are rounded as a whole and
one by the tree, so that their copies differ by one at most and a row that repeats
often moves its source no further than any other; a source without words has
target 0; an empty table gives an empty result; texts of any length are counted in
the JVM; the stage keeps other columns whatever their names.  The source table, one
row per source, is ranked in one task: sources are taken to be thousands at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, discard, join_small, prepare, store, unused

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
GROUP_UNITS = 512
FAN_IN = 64
SEED = 7

_LEVEL = "doc_id long, source string, size long, m long, whole int, more long, p double, g long, level int"


def word_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the number of words."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"))


def allocate(sizes: DataFrame, percent: int = SHARE_PERCENT, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Targets by weight, none above ``cap`` times its source's size (water filling).

    ``sizes`` has ``source`` and ``source_size``, one row per source.  With the
    sources in order of the level at which they fill up, the common level of the
    unfilled ones is the largest of the levels that any prefix of filled sources
    leaves; ordered sums over the source table give them all.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    out = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    before = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) * (percent / 100.0) - before) / after)
    return out.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(every))).select("source", "source_size", "target")


def _draws(*key: object) -> np.random.Generator:
    digest = hashlib.sha256(repr(key).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "little")))


def pivot(p: list[float], words: list[int], rng: np.random.Generator, last: bool) -> list[float]:
    """Round ``p`` in order, largest first; all but one entry come out integral, and all if ``last``.

    An entry is paired with the next fractional ones, as many as together have the
    words that it may need.  A step moves words between both sides, each of those behind
    giving or taking by its distance from 0 or 1, whichever is nearer, up to where the entry
    or one of them is integral: one way or the other, with the chances that keep all
    expectations.  So a large entry does not use up the small ones, and what stays
    fractional in the end is small, where there are entries enough.
    """
    q, w = np.array(p, float), np.array(words, float)
    for i in range(len(q)):
        while 0.0 < q[i] < 1.0:
            behind = i + 1 + np.flatnonzero((q[i + 1 :] > 0) & (q[i + 1 :] < 1))
            if not len(behind):
                break
            part = np.minimum(q[behind], 1 - q[behind])
            enough = int(np.searchsorted(np.cumsum(w[behind] * part), max(q[i], 1 - q[i]) * w[i])) + 1
            behind, part = behind[:enough], part[:enough]
            moved = w[behind] @ part
            up = min((1 - q[i]) * w[i], (q[behind] / part).min() * moved)
            down = min(q[i] * w[i], ((1 - q[behind]) / part).min() * moved)
            move = up if rng.random() * (up + down) < down else -down
            q[i] += move / w[i]
            q[behind] -= move / moved * part
            q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
    open_ = np.flatnonzero((q > 0) & (q < 1))
    if last and len(open_):
        q[open_[0]] = float(rng.random() < q[open_[0]])
    return q.tolist()


def _round(level: int, last: bool, seed: int):
    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "m", "doc_id"], ascending=[False, False, True], ignore_index=True)
        source = None if key[0] is None or key[0] != key[0] else key[0]
        rows["p"] = pivot(rows["p"].tolist(), rows["size"].tolist(), _draws(seed, source, level, int(key[1])), last)
        rows["g"], rows["level"] = int(key[1]) // FAN_IN, level
        return rows

    return group


def copies(docs: DataFrame, percent: int = SHARE_PERCENT, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED, group_units: int = GROUP_UNITS) -> DataFrame:
    """One row per unit: doc_id, source, size, m (equal rows), copies of each, more (rows with one more), source_size, target."""
    prepare(docs.sparkSession)
    units = store(word_sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n_units"))
    targets = store(allocate(per_source.select("source", "source_size"), percent, weights, cap).join(per_source.select(F.col("source").alias("_s"), "n_units"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_units") / group_units))
    most_groups = targets.agg(F.max(groups)).first()[0] or 1
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("m") * (F.col("rate") - F.floor("rate"))
    rows = (
        join_small(units, targets.select("source", "source_size", "target", groups.alias("groups")), ["source"])
        .withColumn("rate", rate)
        .select("doc_id", "source", "size", "m", F.floor("rate").cast("int").alias("whole"), F.floor(part).alias("more"), (part - F.floor(part)).alias("p"), F.pmod(F.xxhash64("doc_id", "size"), "groups").cast("long").alias("g"), F.lit(0).alias("level"))
    )
    levels, level, last = [], 0, False
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    while not last:
        last = most_groups == 1
        done = store(rows.groupBy("source", "g").applyInPandas(_round(level, last, seed), _LEVEL), f"mix-level{level}")
        levels.append(done.filter(~open_))
        rows, level, most_groups = done.filter(open_), level + 1, -(-most_groups // FAN_IN)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    discard(units)
    out = out.withColumns({"copies": F.col("whole"), "more": F.col("more") + F.col("p").cast("int")})
    return join_small(out, targets.select("source", "source_size", "target"), ["source"]).select("doc_id", "source", "size", "m", "copies", "more", "source_size", "target")


def op1_mix(docs: DataFrame) -> DataFrame:
    """The digest of the contract, one row per document."""
    rows = copies(docs).withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    rows = rows.withColumn("copies", F.col("copies") + F.when(F.col("each") <= F.col("more"), 1).otherwise(0))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    Rows of a unit that repeats are numbered in the order of a hash of the text to tell which have one more.
    """
    names = ["d", "s", "n", "size", "m", "copies", "more", "place"]
    d, s, n, size, m, each, more, place = unused(docs, *names)
    plan = copies(docs).filter("copies > 0 OR more > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), F.col("m").alias(m), F.col("copies").alias(each), F.col("more").alias(more))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long"))
    joined = sized.join(plan, sized["doc_id"].eqNullSafe(plan[d]) & sized["source"].cast("string").eqNullSafe(plan[s]) & (sized[size] == plan[n]))
    once, again = joined.filter(F.col(m) == 1).withColumn(place, F.lit(1)), joined.filter(F.col(m) > 1)
    again = again.withColumn(place, F.row_number().over(Window.partitionBy(d, s, n).orderBy(F.xxhash64("text"))))
    times = F.col(each) + F.when(F.col(place) <= F.col(more), 1).otherwise(0)
    every = once.unionByName(again).withColumn(each, times.cast("int")).filter(F.col(each) > 0)
    return every.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*[f"`{c}`" for c in docs.columns])
