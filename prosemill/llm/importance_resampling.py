"""Importance resampling towards a target distribution.

Words are hashed into a fixed number of buckets, counted over all raw texts and
over all target texts.  A bucket's gain is the log ratio of both shares, a text's
weight the sum of its words' gains, read from one array.  Adding Gumbel noise made
from a hash of the id turns "the highest scores" into a draw without replacement
whose odds follow the weights, alike in every run.

The draw sorts nothing globally.  Every partition writes its rows as one sorted
run, eligible rows first.  Every so many rows of each run a key is taken; from
these keys come splitters that cut all runs into ranges, and the exact counts of
the ranges tell which ones the draw reaches.  Only those are shuffled: a task gets
the sorted pieces of all runs in its range, plays them off in a tournament tree
and stops when the draw is complete.  Ranks go on from the counts of the ranges
before.  Rows of the ranges behind never move.

The driver holds the gains (one number a bucket), ``SAMPLES`` keys and one more per
run, and as many counts.  Texts are read in stretches of about a megabyte.

Cases: a null or empty text has no words, weight 0 and no rank; a null id hashes
like an empty one and comes last among ties; rows that repeat are rows of their
own, those of one id and score ranked one after the other; an empty target leaves the
gains to the raw counts alone; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SLICE_BYTES, lower_ascii, partitions, prepare, slices, store, text_bytes

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
SAMPLES = BROADCAST_ROWS // 2
RANGE_ROWS = 65_536

_CRC = np.array([zlib.crc32(bytes([b])) ^ 0xFF000000 for b in range(256)], np.uint32)
_CRC = _CRC[np.arange(256) ^ 0xFF]
_SHORT = 64
_PLACE_BITS = 33

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


# --- words and buckets ------------------------------------------------------


def crc32_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``[s, e)``: one step takes the next byte of all spans that have one."""
    size = e - s
    order = np.argsort(np.minimum(size, _SHORT + 1).astype(np.uint16), kind="stable")[::-1]
    at, sizes = s[order], size[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-sizes, -_SHORT))
    for k in range(_SHORT):
        m = int(np.searchsorted(-sizes, -k))
        if m <= first:
            break
        c = crc[first:m]
        crc[first:m] = _CRC[(c ^ data[at[first:m] + k]) & 0xFF] ^ (c >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~crc
    for k in order[:first]:
        out[k] = zlib.crc32(data[s[k] : e[k]])
    return out


def _stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SLICE_BYTES`` that end outside a word; a longer word is one range."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE_BYTES)
        while b < n:
            gap = np.flatnonzero(~_WORD[data[b : b + 65536]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + 65536)
        yield a, b
        a = b


def word_buckets(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every word, some at a time."""
    data, offs = text_bytes(column)
    for i, j in slices(offs):
        start, end = int(offs[i]), int(offs[j])
        for a, b in _stretches(data[start:end]) if j == i + 1 else [(0, end - start)]:
            some = lower_ascii(data[start + a : start + b])
            word = np.zeros(len(some) + 2, bool)
            word[1:-1] = _WORD[some]
            begins, ends = word[1:] & ~word[:-1], ~word[1:] & word[:-1]
            if j > i + 1:
                cut = offs[i + 1 : j] - start
                cut = cut[word[cut] & word[cut + 1]]
                begins[cut] = ends[cut] = True
            s, e = np.flatnonzero(begins), np.flatnonzero(ends)
            doc = np.searchsorted(offs[i : j + 1] - start, s + a, side="right") - 1 + i
            yield doc, crc32_spans(some, s, e) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Words of all texts by bucket; a task sends one row per bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in word_buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over that in the raw texts, one added to each count."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every row."""

    def score(batches):
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for doc, bucket in word_buckets(batch.column(1), len(gain)):
                if not len(doc):
                    continue
                cut = np.append(0, np.flatnonzero(np.diff(doc)) + 1)
                n[doc[cut]] += np.diff(np.append(cut, len(doc)))
                weight[doc[cut]] += np.add.reduceat(gain[bucket], cut)
            total = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(total)], ["doc_id", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_features long, weight long, score long")


# --- the draw ---------------------------------------------------------------


class Tournament:
    """A tree of matches between the heads of sorted runs; after each win only the winner's path is played again."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.best: list[tuple | None] = [None] * self.size + [h and (h, k) for k, h in enumerate(heads)]
        for node in range(self.size - 1, 0, -1):
            self.best[node] = self._match(self.best[2 * node], self.best[2 * node + 1])

    @staticmethod
    def _match(a: tuple | None, b: tuple | None) -> tuple | None:
        return a if b is None or a is not None and a < b else b

    def __iter__(self) -> Iterator[tuple]:
        while self.best[1] is not None:
            head, k = self.best[1]
            yield head
            after, node = next(self.runs[k], None), self.size + k
            self.best[node] = after and (after, k)
            while node > 1:
                node //= 2
                self.best[node] = self._match(self.best[2 * node], self.best[2 * node + 1])


def _keys(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, bool, int, int]]:
    """Highest score first, then the smaller id, a null one last, then the place."""
    for score, doc, place in zip(table.column("score").to_pylist(), table.column("doc_id").to_pylist(), table.column("place").to_pylist()):
        yield -score, doc is None, doc or 0, place


def _merge(draw: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        before = table.column("before")[0].as_py()
        run_of = table.column("place").to_numpy() >> _PLACE_BITS
        cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), table.num_rows]
        rank: list[int | None] = [None] * table.num_rows
        runs = [zip(_keys(table.slice(a, b - a)), range(a, b)) for a, b in zip(cuts, cuts[1:])]
        for n, (_, row) in enumerate(Tournament(runs), before + 1):
            if n > draw:
                break
            rank[row] = n
        return table.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, pa.int64()))

    return run


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``scores`` with the rank of the drawn rows: ``percent`` of those with ``least_words`` words, highest scores first."""
    eligible = F.col("n_features") >= least_words
    order = [eligible.desc(), F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = store(scores.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resampling-runs")
    n = runs.filter(eligible).count()
    draw = n * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return runs.select(*out, F.lit(None).cast("long").alias("rank"))
    step = max(1, -(-n // samples))
    position = F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)
    sample = sorted(_keys(runs.filter(eligible & (position % step == 0)).select("score", "doc_id", "place").toArrow()))
    size = range_rows or min(RANGE_ROWS, max(256, n // (4 * partitions(runs.sparkSession))))
    splitters = sample[max(1, size // step) :: max(1, size // step)]

    def place(batches):
        for batch in batches:
            at = [bisect_right(splitters, key) for key in _keys(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "range"])

    placed = runs.filter(eligible).mapInArrow(place, f"{', '.join(f'{c} long' for c in out)}, place long, range int")
    before, starts = 0, []
    for r, rows in sorted(placed.groupBy("range").count().collect()):
        if before >= draw:
            break
        starts.append((r, before))
        before += rows
    reached = F.broadcast(runs.sparkSession.createDataFrame(starts, "range int, before long"))
    merged = placed.join(reached, "range").groupBy("range").applyInArrow(_merge(draw), f"{', '.join(f'{c} long' for c in out)}, rank long")
    behind = placed.filter(F.col("range") > starts[-1][0]).select(*out, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(behind).unionByName(runs.filter(~eligible).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Draw ``percent`` of the documents by how much their words look like those of ``target``, both with a text."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return drawn(scored(docs, gain, seed), percent, least_words)


def op13_resample(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return resample(docs, benchmark)


OP13_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, NULL, row_number() OVER (),
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
pieces AS (SELECT side, r, unnest(w) AS word FROM words),
distinct_words AS (SELECT DISTINCT word, encode(word) AS b FROM pieces),
-- CRC-32, bit by bit over the bytes in hexadecimal
crc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) AS h
  FROM distinct_words),
hits AS (SELECT p.side, p.r, c.h % 10000 AS bucket FROM pieces p JOIN crc c USING (word)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM hits GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM counts, totals),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM hits JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ranked
"""
