"""Exact top-k inner-product search by columnar branch and bound.

Vectors are turned to integers and laid out by dimension.  A query adds up the
products of one block of dimensions after the other; after each block, what a
candidate can still gain is at most the product of both remaining lengths
(Cauchy-Schwarz), and candidates that cannot reach the query's k-th best score
are compacted away.  Bounds carry a slack above rounding error and ties stay
in; the scores of those that are left are integer sums, so the result is exact.

Queries and candidates are dealt by a hash of their id into blocks of about
``QUERY_BLOCK`` and ``CANDIDATE_BLOCK`` rows; each pair of blocks is one task
that sends k rows per query on.  No task holds more than one block of each.  The
first block of candidates goes first: its k-th best scores go with the queries
to all other blocks as bounds from the start, and a candidate too short for every
query of a block is not sent there.

Cases: vectors that are null or hold a null or non-finite component, also after
scaling, take no part, nor do rows without an id; vectors of other lengths count
as filled up with zeros; an id that repeats is one query (its first vector in
array order) and each of its rows is a candidate, for other ids; a query with
fewer than k candidates returns them all; scores beyond a long are ranked by
their true value and returned as the nearest long; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, prepare, store

K = 5
QUERY_EVERY = 50
SCALE = 256
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384
DIM_BLOCK = 16
PROBE = 64
_LONG = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows as float64, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _lengths(x: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean length of each row, and of what follows each block of dimensions, whatever the size of components."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)
    part = np.cumsum(((x / most[:, None]) ** 2)[:, ::-1], axis=1)[:, ::-1]
    part = np.sqrt(np.hstack([part, np.zeros((len(x), 1))])) * most[:, None]
    return part[:, 0], part[:, [*starts[1:], x.shape[1]]].T


def _scores(q: np.ndarray, rows: np.ndarray, exact: bool) -> list[int]:
    """Integer inner products; as doubles where these are exact."""
    if exact:
        return (rows @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [sum(a * int(b) for a, b in zip(whole, row)) for row in rows]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int = K, dim_block: int = DIM_BLOCK, least_of: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's best ``k``, the smaller id first among equal scores.

    ``least_of`` has a score that each query's result has to reach, if known.
    """
    dims = candidates.shape[1]
    starts = list(range(0, dims, dim_block)) or [0]
    columns = np.ascontiguousarray(candidates.T)
    blocks = [columns[s : s + dim_block] for s in starts]
    with np.errstate(over="ignore", invalid="ignore"):
        (long_c, rest_c), (long_q, rest_q) = _lengths(candidates, starts), _lengths(queries, starts)
        found = []
        for n, (qid, q) in enumerate(zip(query_ids.tolist(), queries)):
            most = long_q[n] * long_c
            slack, wild = most * (dims * 2.0**-50) + 1e-3, ~(most < 1e300)
            alive = np.flatnonzero(ids != qid)
            score = q[:dim_block] @ blocks[0] if dims else np.zeros(len(ids))
            score = score[alive]
            calm = alive[~wild[alive]]
            probe = calm[np.argpartition(-score[~wild[alive]], PROBE)[:PROBE]] if len(calm) > PROBE else calm
            full = np.sort(candidates[probe] @ q - slack[probe])
            least = full[-k] if len(full) >= k else -np.inf
            if least_of is not None and least_of[n] == least_of[n]:
                least = max(least, least_of[n])
            for b in range(len(starts)):
                if b:
                    score = score + q[starts[b] : starts[b] + dim_block] @ blocks[b][:, alive]
                reach = score + rest_q[b, n] * rest_c[b, alive] * (1 + 1e-9) + slack[alive]
                keep = (reach >= least) | wild[alive]
                alive, score = alive[keep], score[keep]
            exact = _scores(q, candidates[alive], not len(alive) or bool((most[alive] < 2.0**52).all()))
            best = sorted(zip((-x for x in exact), ids[alive].tolist()))[:k]
            found += [(qid, v, -x) for x, v in best]
    return found


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dims = max(int(np.max(t.column("v").combine_chunks().value_lengths())) for t in (left, right))
            least = right.column("least").to_numpy(zero_copy_only=False).astype(float)
            rows = search(right.column("vec_id").to_numpy(), _matrix(right.column("v"), dims), left.column("vec_id").to_numpy(), _matrix(left.column("v"), dims), k, least_of=least)
        q, v, s = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array([max(-_LONG - 1, min(_LONG, x)) for x in s], pa.int64()), "beyond": pa.array([_beyond(x) for x in s], pa.string())})

    return run


def _beyond(score: int) -> str | None:
    """A string that sorts like the score, for one that a long does not hold: sign, number of digits, digits."""
    if -_LONG - 1 <= score <= _LONG:
        return None
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return f"1{text}" if score > 0 else "0" + "".join(chr(ord("0") + 9 - int(c)) for c in text) + "~"


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null unless all are finite, scaled too."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * scale)
    odd = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Doubles from 2 ** 53 on are whole, and floor() would give a long.
    return F.when(~odd, F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Best ``k`` of all rows for the rows that ``is_query`` selects; ``vectors`` has vec_id and v."""
    prepare(vectors.sparkSession)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v", length.alias("length"))
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    across, down = -(-max(1, n_queries) // query_block), -(-max(1, n) // candidate_block)
    dealt = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    spread = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("length", "v").alias("length")).withColumn("qb", dealt(across))
    left = vectors.select("vec_id", "v", "length", dealt(down).alias("cb")).withColumn("qb", spread(0, across - 1))
    kind = "query_id long, vec_id long, score long, beyond string"

    def met(some: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        right = asked.select(*[F.col(c).alias(c) for c in ("vec_id", "v", "qb", "least")]).withColumn("cb", spread(first, last))
        return some.select(*[F.col(c).alias(c) for c in ("vec_id", "v", "qb", "cb")]).groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_tile(k), kind)

    tiles = met(left.filter("cb = 0"), queries.withColumn("least", F.lit(None).cast("double")), 0, 0)
    if down > 1:
        tiles = store(tiles, "topk-first")
        seeds = tiles.groupBy("query_id").agg(F.min("score").alias("seed"), F.count("*").alias("found"), F.count("beyond").alias("wild"))
        least = F.when((F.col("found") >= k) & (F.col("wild") == 0), F.col("seed") * (1 - F.signum("seed") * 2.0**-50) - 1.0)
        asked = store(queries.join(seeds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "length", "qb", least.alias("least")), "topk-queries")
        bound = F.when((F.col("least") > 0) & (F.col("length") > 0) & (F.col("length") < 1e150), F.col("least") / F.col("length")).otherwise(0.0)
        shortest = asked.groupBy("qb").agg(F.min(bound * (1 - 1e-9)).alias("shortest"))
        rest = left.filter("cb > 0")
        if across <= BROADCAST_ROWS:
            rest = rest.join(F.broadcast(shortest), "qb").filter(F.col("length") >= F.col("shortest"))
        tiles = tiles.unionByName(met(rest, asked, 1, down - 1))
    best = Window.partitionBy("query_id").orderBy(F.when(F.col("beyond") >= "1", F.col("beyond")).desc_nulls_last(), F.desc("score"), F.col("beyond").desc_nulls_first(), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(embeddings: DataFrame) -> DataFrame:
    """The digest of the contract."""
    vectors = embeddings.select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
