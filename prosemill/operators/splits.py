"""Deterministic samples, splits and folds.

Rows are ordered by an MD5 of seed and id: the same on every engine, partitioning
and run.  (A library's pseudo-random order is not reproducible here.)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
SAMPLE_SIZE = 40
TEST_SHARE = 0.2
FOLDS = 5

#: The names of the prompt variants, in turn.
VARIANTS = ("light_grammar_flow", "sentence_variety_word_choice", "grammar_phrasing_keep_voice")


def draw(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """The ``n`` rows that come first, with their position: a top-k, not a sort."""
    taken = rows.withColumn("_o", draw(key, seed)).orderBy("_o", key).limit(n)
    return taken.withColumn("position", F.row_number().over(Window.orderBy("_o", key)) - 1).drop("_o")


def rotate_variants(sample: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    return sample.withColumn("prompt_variant", F.element_at(F.array(*map(F.lit, variants)), (F.col("position") % len(variants) + 1).cast("int")))


def ranked(rows: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    """``_rank`` (from 1) in the order of the draw, and ``_n``, within each value of ``by``.

    The draw's first three digits cut a class into 4096 ranges.  Rows are numbered
    within their range and the counts of the ranges before are added, so that a
    class with most rows is sorted by many tasks.
    """
    drawn = rows.withColumn("_o", draw(key, seed)).withColumn("_range", F.substring("_o", 1, 3))
    counts = drawn.groupBy(by, "_range").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(by)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_o", key))
    met = drawn.withColumn("_place", place).join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("_rank", F.col("_before") + F.col("_place")).drop("_o", "_range", "_by", "_r", "_before", "_place")


def stratified_split(rows: DataFrame, key: str, label: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``is_test``: the first ``share`` of each class, rounded; of all rows, if a class has fewer than two."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    strata = F.lit("all") if sizes.filter("n < 2").limit(1).count() else F.col(label).cast("string")
    layered = ranked(rows.withColumn("_s", strata), key, "_s", seed)
    return layered.withColumn("is_test", F.col("_rank") <= F.round(F.col("_n") * share)).drop("_s", "_n", "_rank")


def hashed_split(rows: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED, group: str | None = None) -> DataFrame:
    """``is_test`` by the hash alone, a map without a shuffle; rows of one ``group`` stay together."""
    point = F.conv(F.substring(draw(group or key, seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("is_test", point < F.lit(int(share * (1 << 32))))


def fold_count(rows: DataFrame, label: str, k: int = FOLDS) -> int:
    """``k``, or the smallest class's rows if fewer, but two at least."""
    smallest = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return min(k, max(smallest, 2))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = FOLDS, seed: int = SEED, group: str | None = None) -> DataFrame:
    """``fold``: the classes dealt out in turn; whole groups by ``grouped_folds`` if rows of a group must stay together."""
    if group:
        return rows.join(grouped_folds(rows, label, group, k, seed).withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return ranked(rows, key, label, seed).withColumn("fold", ((F.col("_rank") - 1) % fold_count(rows, label, k)).cast("int")).drop("_rank", "_n")


def dealt_greedily(folds: int, weights: dict[str, int]) -> Callable[[dict[str, int]], int]:
    """A dealer that puts each group, given by its rows of each class, where rows of its classes are fewest.

    That is the fold for which the sum of squares of all counts, weighted by class,
    grows least; of equal ones the fold with fewest rows, then the first.
    """
    held: list[dict[str, int]] = [{} for _ in range(folds)]

    def deal(group: dict[str, int]) -> int:
        cost = lambda f: (sum(n * held[f].get(c, 0) * weights[c] for c, n in group.items()), sum(held[f].values()), f)
        best = min(range(folds), key=cost)
        for c, n in group.items():
            held[best][c] = held[best].get(c, 0) + n
        return best

    return deal


def grouped_folds(rows: DataFrame, label: str, group: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """``group`` and its ``fold``: every group whole, the classes as even over the folds as greedy dealing makes them.

    Groups with the same rows of each class are alike: of every kind as many as go into
    all folds evenly are dealt out by the order of the draw.  What is left, fewer than k of
    a kind, is dealt greedily, the largest first.  So what goes one by one through one task
    is kinds of groups, not groups or rows, and a hundred or so bytes each.
    """
    label_ = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    counts = rows.groupBy(group, label_.alias("_c")).agg(F.count("*").alias("_n"))
    kinds = counts.groupBy(group).agg(F.sum("_n").alias("_size"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "_n"))))).alias("_kind"))
    totals = {r["_c"]: r["n"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}
    weights = {c: sum(totals.values()) // n for c, n in totals.items()}
    # A kind with very many groups is numbered in ranges, as ``ranked`` does it.
    numbered = ranked(kinds, group, "_kind", seed)
    even = F.col("_n") - F.col("_n") % k

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = dealt_greedily(k, weights)
        for batch in batches:
            yield pd.DataFrame({"_kind": batch["_kind"], "_rank": batch["_rank"], "_fold": [to(json.loads(x)) for x in batch["_kind"]]})

    left = numbered.filter(F.col("_rank") > even).select("_size", "_kind", "_rank")
    dealt = left.coalesce(1).sortWithinPartitions(F.desc("_size"), "_kind", "_rank").mapInPandas(deal, "_kind string, _rank long, _fold int")
    dealt = dealt.select(F.col("_kind").alias("_k"), F.col("_rank").alias("_r"), "_fold")
    met = numbered.join(dealt, (F.col("_kind") == F.col("_k")) & (F.col("_rank") == F.col("_r")), "left")
    return met.select(group, F.coalesce("_fold", ((F.col("_rank") - 1) % k).cast("int")).alias("fold"))


def first_held_out(rows: DataFrame, preference: list[str], source: str, row: str) -> DataFrame:
    """The held-out row of the most preferred source, the first in order."""
    rank = F.coalesce(*[F.when(F.col(source) == s, i) for i, s in enumerate(preference)], F.lit(len(preference)))
    return rows.filter("is_test").withColumn("_r", rank).orderBy("_r", row).limit(1).drop("_r")
