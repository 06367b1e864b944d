"""Line dedup by winnowing.

A document is the sequence of its lines that hold a word, each without the
white space at its ends.  A line weighs 1 and 1 more for each ``LINE_WORDS`` words,
and a window is a shortest run of lines, from its first or to its last one, that
weighs ``MIN_RUN``: three short lines, or one of 50 words.  Every repeated run of
that weight is a union of windows.

* Winnowing: a window selects its line with the smallest hash, so equal windows
  select the same line, and each repeated run has a fingerprint for sure.  A position
  that several windows select is one row, with the hashes of the lines around it.
* Join: fingerprints that only one position has are gone after an aggregation by
  fingerprint; the positions of the others are joined to them.
* Extension: from a shared fingerprint, each window that selected it is gone along
  to both sides, line by line.  All but the earliest of equal extensions (smaller
  doc_id, null last, then smaller line) are marked, and marked windows that touch or
  overlap join to one run of any length.

All lines of marked runs go, with the blank lines inside them; what is compared
is always the input, not what is left.

The earliest window of an extension is a minimum that each task computes for its
own rows first, so a line or copy that a third of the rows share shuffles one row
per task; joins to fingerprints and minima split hot keys off.

Cases: a null text counts as empty and stays null; a document that weighs less than
``MIN_RUN`` keeps everything; rows with equal id and text are the same document,
and neither removes the other; rows with equal id and other texts are ordered by a
hash of the text; long texts and long lines are read a megabyte at a time; other columns are
kept whatever their names, but ``dedup_lines`` replaces those called like its counts
(the stage does not).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, SPACE_CLASS, TEXT_BATCH_BYTES, _SPACE, binary_lists, chain, discard, hash_spans, join_split, prepare, released, slices, store, stretches, text_bytes, unused, word_spans

MIN_RUN = 3
LINE_WORDS = 25
COUNTS = ("n_lines", "n_removed", "n_runs")

_LAST = (1 << 63) - 1
_PLACE = ["d", "th", "at"]


def _line_stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SLICE_BYTES`` that end after a line; a longer line is one range."""
    a, n = 0, len(data)
    while a < n:
        ends = np.flatnonzero(data[a : a + SLICE_BYTES] == 10)
        b = a + int(ends[-1]) + 1 if len(ends) else min(n, a + SLICE_BYTES)
        while not len(ends) and b < n:
            ends = np.flatnonzero(data[b : b + SLICE_BYTES] == 10)
            b = b + int(ends[0]) + 1 if len(ends) else min(n, b + SLICE_BYTES)
        yield a, b
        a = b


def _trimmed(data: np.ndarray) -> tuple[int, int]:
    """Start and end of what is not white space, looked for from both ends; equal if there is nothing."""
    n = len(data)
    start = next((k + int(f[0]) for k in range(0, n, 65536) if len(f := np.flatnonzero(~_SPACE[data[k : k + 65536]]))), n)
    end = next((max(0, k - 65536) + int(f[-1]) + 1 for k in range(n, 0, -65536) if len(f := np.flatnonzero(~_SPACE[data[max(0, k - 65536) : k]]))), start)
    return start, end


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line that holds a word, white space at its ends left out."""
    if len(offs) == 2 and len(data) > 2 * SLICE_BYTES:
        found = []
        for a, b in _line_stretches(data):
            if b - a > SLICE_BYTES:
                start, end = _trimmed(data[a:b])
                found.append(np.array([[a + start], [a + end]])[:, : int(end > start)])
            else:
                found.append(np.array(line_spans(data[a:b], np.array([0, b - a]))[:2]) + a)
        s, e = np.concatenate(found, axis=1)
        return s, e, np.zeros(len(s), np.int64)
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return (np.empty(0, np.int64),) * 3
    line, doc = np.cumsum(data == 10)[solid], np.searchsorted(offs, solid, side="right") - 1
    new = np.ones(len(solid), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(solid)) - 1
    return solid[first], solid[last] + 1, doc[first]


def _words_of(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each line."""
    out = np.zeros(len(starts), np.int64)
    for a, b in stretches(data) if len(offs) == 2 else [(0, len(data))]:
        at = word_spans(data[a:b], np.clip(offs - a, 0, b - a))[0] + a
        out += np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(starts))
    return out


def windows(doc: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the shortest runs of ``least`` weight that start or end at each line of a document."""
    n, found = len(doc), []
    for step in (1, -1):
        total, size, inside = weight.copy(), np.where(weight >= least, 1, 0), np.ones(n, bool)
        for k in range(1, least):
            other = np.arange(n) + step * k
            inside &= (other >= 0) & (other < n)
            other = np.clip(other, 0, n - 1)
            inside &= doc[other] == doc
            total = total + np.where(inside, weight[other], 0)
            size = np.where((size == 0) & inside & (total >= least), k + 1, size)
        at = np.flatnonzero(size)
        found.append((at if step > 0 else at - size[at] + 1) * (least + 1) + size[at])
    both = np.unique(np.concatenate(found))
    return both // (least + 1), both % (least + 1)


def positions(data: np.ndarray, offs: np.ndarray, min_run: int, line_words: int) -> tuple[np.ndarray, ...]:
    """The lines that windows select: (document, line, fingerprint, hashes of the lines around, windows).

    Each line is there once.  The lines around are ``min_run - 1`` before and as many
    behind it, 0 where the document has none; bit ``place * min_run + size - 1`` tells a
    window of ``size`` lines that has the fingerprint in that place.
    """
    s, e, doc = line_spans(data, offs)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, 2 * min_run - 2), np.uint64), np.empty(0, np.int64)
    line = hash_spans(data, s, e)
    first, size = windows(doc, 1 + _words_of(data, offs, s) // line_words, min_run)
    low, place = line[first], np.zeros(len(first), np.int64)
    for k in range(1, min_run):
        at = np.minimum(first + k, len(line) - 1)
        less = (size > k) & (line[at] < low)
        low, place = np.where(less, line[at], low), np.where(less, k, place)
    chosen, of = np.unique(first + place, return_inverse=True)
    held = np.zeros(len(chosen), np.int64)
    np.bitwise_or.at(held, of, np.int64(1) << (place * min_run + size - 1))
    near = np.zeros((len(chosen), 2 * min_run - 2), np.uint64)
    for c, step in enumerate([*range(1 - min_run, 0), *range(1, min_run)]):
        at = np.clip(chosen + step, 0, len(line) - 1)
        near[:, c] = np.where((at == chosen + step) & (doc[at] == doc[chosen]), line[at], 0)
    return doc[chosen], chosen - np.searchsorted(doc, doc[chosen], side="left"), line[chosen], near, held


def extended(fp: np.ndarray, near: np.ndarray, held: np.ndarray, min_run: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(row, place, size, hash of the lines in order) of the windows that selected each row's fingerprint, from it to both sides."""
    for place in range(min_run):
        for size in range(place + 1, min_run + 1):
            rows = np.flatnonzero(held >> np.int64(place * min_run + size - 1) & 1)
            if len(rows):
                around = lambda step: fp[rows] if not step else near[rows, step + min_run - 1 - (step > 0)]  # noqa: B023, E731
                back = chain(*[around(-k) for k in range(place + 1)])
                yield rows, place, size, chain(np.full(len(rows), np.uint64(size)), back, *[around(k) for k in range(1, size - place)])


def _without(text: str, starts: list[int], sizes: list[int]) -> tuple[str, int, int]:
    """(kept text, lines with a word that are removed, removed runs)."""
    lines = text.split("\n")
    words = [k for k, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
    gone = np.zeros(len(words) + 1, bool)
    for s, n in zip(starts, sizes):
        gone[s : s + n] = True
    drop = {words[k] for k in np.flatnonzero(gone)}
    for k in np.flatnonzero(gone[:-1] & gone[1:]):
        drop.update(range(words[k], words[k + 1]))
    return "\n".join(line for k, line in enumerate(lines) if k not in drop), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, line_words: int = LINE_WORDS) -> DataFrame:
    """d, th, at, size: the windows that an earlier place holds too; ``docs`` has d, th and text."""
    ids, whole = ["d", "th"], "d long, th long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                doc, at, fp, near, held = positions(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_run, line_words)
                lists = binary_lists(near.ravel(), np.arange(len(doc) + 1) * near.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc + i)) for c in ids), pa.array(at.astype(np.int32)), pa.array(fp.view(np.int64)), lists, pa.array(held)], names=[*ids, "at", "fp", "near", "held"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = (batch.column(c).to_numpy() for c in ("at", "held"))
            fp, raw = batch.column("fp").to_numpy().view(np.uint64), batch.column("near").to_pylist()
            near = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), 2 * min_run - 2)
            for rows, place, size, ext in extended(fp, near, held, min_run):
                same = [pa.array(np.full(len(rows), x, np.int32)) for x in (size, place)]
                taken = [batch.column(c).take(pa.array(rows)) for c in (*ids, "fp")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array((at[rows] - place).astype(np.int32)), *same, pa.array(ext.view(np.int64))], names=[*ids, "fp", "at", "size", "place", "ext"])

    found = store(docs.select(*ids, "text").mapInArrow(released(find), f"{whole}, at int, fp long, near binary, held long"), "lines-positions")
    position = F.xxhash64(*ids, "at")
    shared = found.groupBy("fp").agg(F.min(position).alias("a"), F.max(position).alias("b"), F.count("*").alias("n")).filter("a <> b").select("fp", "n")
    joined = join_split(found, store(shared, "lines-shared"), ["fp"], found.count())
    met = store(joined.select(*ids, "at", "fp", "near", "held").mapInArrow(released(extend), f"{whole}, fp long, at int, size int, place int, ext long"), "lines-met")
    discard(found)
    key, place = ["fp", "place", "ext"], F.struct(*_PLACE)
    first = store(met.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "lines-first")
    return join_split(met, first, key, met.count()).filter(place > F.col("first")).select(*_PLACE, "size").distinct()


def last_id() -> Column:
    """The id, or the largest long for rows without one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with d, the id (null last), and th, a hash of the text."""
    return docs.withColumns({"d": last_id(), "th": F.xxhash64(text)})


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, line_words: int = LINE_WORDS, counts: Sequence[str] = COUNTS) -> DataFrame:
    """``docs`` with ``text`` as it is left, and ``counts``: lines with a word, those removed, and removed runs."""
    prepare(docs.sparkSession, TEXT_BATCH_BYTES)
    docs = docs.drop(*counts)
    marks = store(repeated_runs(identified(docs.select("doc_id", "text")), min_run, line_words).groupBy("d", "th").agg(F.collect_list(F.struct("at", "size")).alias("marks")), "lines-marked")
    names = docs.columns
    d, th, runs_ = unused(docs, "d", "th", "marks")
    keyed = docs.withColumns({d: last_id(), th: F.xxhash64("text")})
    joined = keyed.join(marks.select(F.col("d").alias(d), F.col("th").alias(th), F.col("marks").alias(runs_)).hint("merge"), [d, th], "left").select(*names, runs_)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column("text"), batch.column(runs_)
            data, offs = text_bytes(column)
            n_lines, removed, n_runs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offs):
                n_lines[i:j] = np.bincount(line_spans(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[2], minlength=j - i)
            marked, texts = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)), []
            for r in marked.tolist():
                windows_ = lists[r].as_py()
                text, removed[r], n_runs[r] = _without(column[r].as_py(), [w["at"] for w in windows_], [w["size"] for w in windows_])
                texts.append(text)
            if len(marked):
                mask = np.zeros(batch.num_rows, bool)
                mask[marked] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(texts, column.type))
            yield pa.RecordBatch.from_arrays([*(column if c == "text" else batch.column(c) for c in names), pa.array(n_lines), pa.array(removed), pa.array(n_runs)], names=[*names, *counts])

    return joined.mapInArrow(released(cut), schema)


def op4_lines(docs: DataFrame) -> DataFrame:
    """Per document: its lines, what was removed, and a digest of the text that is left."""
    left = dedup_lines(docs.select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", "n_runs", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def line_stage(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated runs; a document with no word left goes, ``n_chars`` follows the text."""
    counts = n_lines, n_removed, _ = unused(docs, *COUNTS)
    left = dedup_lines(docs, counts=counts).filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines))).select(*[f"`{c}`" for c in docs.columns])
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


OP4_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS solid FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
w AS (
  SELECT doc_id, i, row_number() OVER o AS s, regexp_replace(line, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g') AS a,
    1 + len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) // {LINE_WORDS} AS v FROM l WHERE solid
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT doc_id, s, CASE WHEN v >= {MIN_RUN} THEN [a] WHEN v + lead(v) OVER o >= {MIN_RUN} THEN [a, lead(a) OVER o]
      WHEN lead(a, 2) OVER o IS NOT NULL THEN [a, lead(a) OVER o, lead(a, 2) OVER o] END AS g
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY s)
  UNION
  SELECT doc_id, s - len(g) + 1, g FROM (
    SELECT doc_id, s, CASE WHEN v >= {MIN_RUN} THEN [a] WHEN v + lag(v) OVER o >= {MIN_RUN} THEN [lag(a) OVER o, a]
      WHEN lag(a, 2) OVER o IS NOT NULL THEN [lag(a, 2) OVER o, lag(a) OVER o, a] END AS g
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY s)) WHERE g IS NOT NULL),
r AS (SELECT doc_id, s, len(g) AS n FROM g WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, s + k AS s FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE k < n),
m AS (SELECT w.doc_id, i, w.s, c.s IS NOT NULL AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.s = c.s),
b AS (
  SELECT l.doc_id, l.i, l.line, l.solid, m.gone,
    last_value(m.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(m.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
  FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.i = m.i),
k AS (
  SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND gone) AS n_removed,
    count(*) FILTER (solid AND gone AND NOT coalesce(p, false)) AS n_runs,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT CASE WHEN solid THEN gone ELSE coalesce(p AND n, false) END), '') AS kept
  FROM b GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, n_runs, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM k
"""
