"""Exact substring dedup with a distributed, sparse suffix array.

Texts are UTF-8 bytes.  A byte goes if a string of ``LENGTH`` bytes that covers
it also starts earlier: in a document with a smaller id, or before in the same.

* Suffixes.  Every string of ``LENGTH`` bytes selects one position, the smallest
  hash of the ``GRAM`` bytes there (the last of equals), so equal strings select
  it at the same place.  The suffixes at selected positions, about one in 39,
  are the array; each owns the strings that selected it, a range of starts.
* Range partition.  Suffixes are range-partitioned at sampled splitters by the
  hash of their leading ``GRAM`` bytes, then by a hash of all bytes that the owned
  strings span, then by place; a very common suffix is split by its place.  In
  a sorted bucket, equal spans are one run: all but its first are removed as a
  whole.  What a bucket cannot tell, since its first and last leading gram may go
  on in the neighbours, is compared across the boundaries by one more join.
* Local sort.  Where one leading gram stands before different spans, the first
  suffix of each span brings its bytes: once for its strings that start close
  before it, ordered by the bytes from the suffix on and then by those to the left,
  and once for the others, ordered the other way round.  These are range-partitioned
  in that order, so that a common gram is split over many buckets.  A bucket sorts
  the bytes by multikey quicksort, a word of eight bytes at a time and only where
  suffixes still tie; neighbours' common prefixes and hashes of the bytes to the
  left then give, for every offset, the classes of equal strings, and all but the
  earliest string of a class are removed.
* Across boundaries.  A class of equal strings shares a leading part of the order's
  key, so it goes on in another bucket only if the bucket's first or last suffix
  shares that part too.  The strings of these classes that are left are compared
  across all buckets, by an aggregation with partial minima and a join.

Cases: a null text counts as empty; texts under ``LENGTH`` bytes keep
everything; a null id comes last; rows with equal id and text are the same
document, of which neither removes the other; rows with equal id and other texts
are ordered by a hash of the text; a long text is read a megabyte at a time; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, chain, discard, join_split, mix64, partitions, prefix_hash, prepare, slices, span_hash, store, text_bytes

LENGTH = 100
GRAM = 24

#: Suffixes of a bucket: of 32 bytes each while spans are compared, of some 200 with their bytes.
BUCKET_ROWS = 1_000_000
BUCKET_SPANS = 20_000

_LAST = (1 << 63) - 1
_ROW = "gram long, span long, d long, th long, own long"
_KEYS = ["gram", "span", "d", "th", "own"]


def _pack(at: np.ndarray, left: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Position, strings that start before it, and strings less one, in one number that sorts by position."""
    return (at << 24) | (left << 12) | more


def _unpack(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return own >> 24, (own >> 12) & 4095, own & 4095


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, v
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - size :]) if width > size else m


def suffixes(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, hash of the leading gram, hash of the span, position, left, more) of the selected positions.

    One long text is read in overlapping stretches; the last selected position of each
    may own strings of the next one, which begins with them again.
    """
    n = len(data)
    if len(offs) == 2 and n > 2 * SLICE_BYTES + length:
        found, a = [], 0
        while True:
            b = min(n, a + SLICE_BYTES + length)
            rows = suffixes(data[a:b], np.array([0, b - a]), length, gram)
            last = len(rows[0]) - (b < n)
            found.append([x[:last] + (a if k == 3 else 0) for k, x in enumerate(rows)])
            if b == n:
                return tuple(np.concatenate(x) for x in zip(*found))
            a += int(rows[3][last] - rows[4][last])
    if n < length:
        return (np.empty(0, np.int64),) * 6
    acc = prefix_hash(data)
    i = np.arange(n - gram + 1)
    lead = span_hash(acc, i, i + gram)
    bits = np.uint64(n.bit_length())
    ranked = (lead >> bits << bits) | (n - i).astype(np.uint64)
    at = n - (_sliding_min(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(start):
        return (np.empty(0, np.int64),) * 6
    at = at[start]
    head = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    lo, hi, at = start[head], start[np.append(head[1:], len(start)) - 1], at[head]
    span = chain(span_hash(acc, lo, hi + length), ((at - lo) << 12 | (hi - lo)).astype(np.uint64))
    doc = doc[lo]
    return doc, lead[at].view(np.int64), span.view(np.int64), at - offs[doc], at - lo, hi - lo


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray] | None:
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return {c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(names)} if parts else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted bucket: kind 0 is removed, 1 is the first of its span beside other spans, 2 is for the neighbours."""
    rows = _columns(batches, _KEYS)
    if rows is None:
        return
    changed = lambda c: np.append(True, rows[c][1:] != rows[c][:-1])
    new_gram = changed("gram")
    new_span = new_gram | changed("span")
    head = np.flatnonzero(new_span)
    first = head[np.cumsum(new_span) - 1]
    later = np.any([rows[c] != rows[c][first] for c in ("d", "th", "own")], axis=0)
    of = np.cumsum(new_gram) - 1
    spans = np.bincount(of[head])[of]
    edge = (of == 0) | (of == of[-1])
    kind = np.where(later, 0, np.where(~new_span, -1, np.where(edge, 2, np.where(spans > 1, 1, -1)))).astype(np.int32)
    keep = kind >= 0
    yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][keep]) for c in _KEYS), pa.array(kind[keep])], names=[*_KEYS, "kind"])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words``: by the first word, then only rows that still tie by the next."""
    order = np.arange(len(words))
    open_, group = order.copy(), np.zeros(len(words), np.int64)
    for k in range(words.shape[1]):
        if not len(open_):
            break
        rows = order[open_]
        by = np.lexsort((words[rows, k], group))
        rows, group = rows[by], group[by]
        order[open_] = rows
        new = np.append(True, (group[1:] != group[:-1]) | (words[rows[1:], k] != words[rows[:-1], k]))
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        tie = np.repeat(size > 1, size)
        open_, group = open_[tie], (np.cumsum(new) - 1)[tie]
    return order


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Row r holds ``size[r]`` bytes from ``start[r]`` on, forwards or backwards, then zeros."""
    k, out = np.arange(width), np.zeros((len(start), width), np.uint8)
    for i in range(0, len(start), 4096):
        inside = k < size[i : i + 4096, None]
        out[i : i + 4096] = np.where(inside, data[np.where(inside, start[i : i + 4096, None] + step * k, 0)], 0)
    return out


def repeated_strings(data: np.ndarray, begin: np.ndarray, place: np.ndarray, left: np.ndarray, more: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each suffix and offset, whether the string that starts ``offset`` before it has an earlier equal.

    ``data[begin[r]:]`` is the span of suffix ``r``; ``place`` ranks the suffixes
    by document and position, equal for the same place.
    """
    m, most = len(begin), length - gram
    right = _matrix(data, begin + left, length + more - left, -(-length // 8) * 8)
    order = multikey_order(right.view(">u8").astype(np.uint64))
    right = right[order, :length]
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    back = _matrix(data, begin + left - 1, left, most, -1) if most else np.zeros((m, 0), np.uint8)
    by_place = np.argsort(place, kind="stable")
    hash_, out, run = np.zeros(m, np.uint64), np.zeros((m, most + 1), bool), np.empty(m, np.uint64)
    for offset in range(most + 1):
        if offset:
            hash_ = mix64(hash_ * np.uint64(0x9E3779B97F4A7C15) + back[:, offset - 1] + np.uint64(1))
        run[order] = np.cumsum(np.append(0, common < length - offset)).astype(np.uint64)
        rows = by_place[((left >= offset) & (left - more <= offset))[by_place]]
        if len(rows) < 2:
            continue
        key = mix64(run[rows] * np.uint64(0xD6E8FEB86659FD93) ^ hash_[rows])
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        head = np.append(True, key[1:] != key[:-1])
        first = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
        out[rows, offset] = place[rows] > place[first]
    return out


def _compare(length: int, gram: int):
    """A sorted bucket of suffixes with their bytes: removed ranges, and the strings for other buckets with gram and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        grams, d, th, own = (table.column(c).to_numpy() for c in ("gram", "d", "th", "own"))
        data, offs = text_bytes(table.column("bytes"))
        at, left, more = _unpack(own)
        order = np.lexsort((own, th, d))
        step = np.append(0, np.any([c[order][1:] != c[order][:-1] for c in (d, th, own)], axis=0).cumsum())
        place = np.empty(len(order), np.int64)
        place[order] = step
        gone = repeated_strings(data, offs[:-1], place, left, more, length, gram)
        wide = np.zeros((len(gone), gone.shape[1] + 2), np.int8)
        wide[:, 1:-1] = gone
        edge = np.diff(wide, axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        none = pa.nulls(len(row), pa.int64())
        names = ["gram", "string", "d", "th", "lo", "hi"]
        yield pa.RecordBatch.from_arrays([none, none, pa.array(d[row]), pa.array(th[row]), pa.array(at[row] - high + 1), pa.array(at[row] - low + length)], names=names)

        acc = prefix_hash(data)
        part, (keys, to) = table.column("part").to_numpy(), text_bytes(table.column("key"))
        near = np.full(len(own), -1)
        for end in {0, len(own) - 1}:
            some = np.flatnonzero((grams == grams[end]) & (part == part[end]))
            bound = keys[to[end] : to[end + 1]]
            size = np.minimum(np.diff(to)[some], len(bound))
            same = (_matrix(keys, to[some], size, len(bound)) == bound) & (np.arange(len(bound)) < size[:, None])
            near[some] = np.maximum(near[some], np.where(same.all(axis=1), len(bound), (~same).argmax(axis=1)) if len(bound) else 0)
        half = (length - gram) // 2
        ends = np.flatnonzero(near >= 0)
        for i in range(0, len(ends), 2000):
            some, offset = ends[i : i + 2000], np.arange(gone.shape[1])
            shared = np.where(part[some, None] == 0, length - half + offset, half + 1 + length - offset)
            row, offset = np.nonzero(~gone[some] & (offset <= left[some, None]) & (offset >= (left - more)[some, None]) & (near[some, None] >= shared))
            row = some[row]
            start = offs[row] + left[row] - offset
            string = chain(span_hash(acc, start, start + length), offset.astype(np.uint64)).view(np.int64)
            lo = at[row] - offset
            yield pa.RecordBatch.from_arrays([*map(pa.array, (grams[row], string, d[row], th[row], lo, lo + length))], names=names)

    return run


def _fetch(length: int, gram: int):
    """Each suffix's bytes: part 0 for its strings of few bytes before it, part 1 for the others; and the key to sort by."""
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            wanted = lists.flatten()
            if not len(wanted):
                continue
            n = np.asarray(lists.value_lengths())
            of = np.repeat(np.arange(len(n)), n)
            grams, own = (wanted.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            at, left, more = _unpack(own)
            least = left - more
            for part, some, first, last in ((0, np.flatnonzero(least <= half), least, np.minimum(left, half)), (1, np.flatnonzero(left > half), np.maximum(least, half + 1), left)):
                for i in range(0, len(some), 20_000):
                    k = some[i : i + 20_000]
                    lo, hi, place = first[k], last[k], offs[of[k]] + at[k]
                    sides = [(place, np.minimum(length - lo, length - half if part == 0 else length), 1), (place - 1, np.minimum(hi, half if part == 0 else half + 1), -1)]
                    key = _joined(data, *(sides if part == 0 else sides[::-1]))
                    rows = pa.array(of[k])
                    yield pa.RecordBatch.from_arrays([pa.array(grams[k]), pa.array(np.full(len(k), part, np.int32)), key, batch.column("d").take(rows), batch.column("th").take(rows), pa.array(_pack(at[k], hi, hi - lo)), _raw(data, place - hi, length + hi - lo)], names=["gram", "part", "key", "d", "th", "own", "bytes"])

    return run


def _joined(data: np.ndarray, *sides: tuple[np.ndarray, np.ndarray, int]) -> pa.Array:
    """Binary values of two stretches each: from ``start`` on, ``size`` bytes, forwards or backwards."""
    total = sum(size for _, size, _ in sides)
    to = np.append(0, np.cumsum(total))
    raw, begin = np.empty(to[-1], np.uint8), to[:-1]
    for start, size, step in sides:
        ends = np.cumsum(size)
        k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        raw[k + np.repeat(begin, size)] = data[np.repeat(start, size) + step * k]
        begin = begin + size
    return pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _raw(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    to = np.append(0, np.cumsum(size))
    raw = data[np.arange(to[-1]) - np.repeat(to[:-1], size) + np.repeat(start, size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_spans: int = BUCKET_SPANS) -> DataFrame:
    """d, th, lo, hi: byte ranges to remove; they overlap freely.  ``docs`` has d, th and text."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), 2 * n_bytes // (length - gram + 2) // BUCKET_ROWS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in slices(offs):
                doc, lead, span, at, left, more = suffixes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram)
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(span), batch.column("d").take(rows), batch.column("th").take(rows), pa.array(_pack(at, left, more))], names=_KEYS)

    found = docs.select("d", "th", "text").mapInArrow(find, _ROW)
    judged = store(found.repartitionByRange(n, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_judge, _ROW + ", kind int"), "suffix-judged")

    place = F.struct("d", "th", "own")
    edge = judged.filter("kind = 2")
    first = edge.groupBy("gram", "span").agg(F.min(place).alias("first"))
    mixed = edge.groupBy("gram").agg(F.min("span").alias("a"), F.max("span").alias("b")).filter("a <> b").select("gram")
    split = store(edge.join(first, ["gram", "span"]).join(mixed.withColumn("mixed", F.lit(True)), "gram", "left").withColumn("later", place > F.col("first")), "suffix-edges")
    whole = judged.filter("kind = 0").select("d", "th", "own").unionByName(split.filter("later").select("d", "th", "own"))
    unclear = judged.filter("kind = 1").select("gram", "d", "th", "own").unionByName(split.filter("mixed AND NOT later").select("gram", "d", "th", "own").distinct())

    wanted = unclear.groupBy("d", "th").agg(F.collect_list(F.struct("gram", "own")).alias("wanted"))
    bytes_ = store(docs.select("d", "th", "text").join(wanted, ["d", "th"]).mapInArrow(_fetch(length, gram), "gram long, part int, key binary, d long, th long, own long, bytes binary"), "suffix-bytes")

    order = ["gram", "part", "key", "d", "th", "own"]
    n = max(partitions(spark), -(-bytes_.count() // bucket_spans))
    compared = store(bytes_.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_compare(length, gram), "gram long, string long, d long, th long, lo long, hi long"), "suffix-compared")
    discard(bytes_)
    strings, start = compared.filter("string IS NOT NULL"), F.struct("d", "th", "lo")
    earliest = store(strings.groupBy("gram", "string").agg(F.min(start).alias("first"), F.max(start).alias("most"), F.count("*").alias("n")).filter("first <> most").drop("most"), "suffix-earliest")
    many = join_split(strings, earliest, ["gram", "string"], strings.count()).filter(start > F.col("first")).select("d", "th", "lo", "hi")
    few = compared.filter("string IS NULL").select("d", "th", "lo", "hi")
    lo = F.shiftright("own", 24) - F.shiftright("own", 12).bitwiseAND(F.lit(4095))
    return whole.select("d", "th", lo.alias("lo"), (lo + F.col("own").bitwiseAND(F.lit(4095)) + length).alias("hi")).unionByName(few).unionByName(many)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with d, the id (null last), and th: 0, or a hash of the text where ids repeat."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    unique = docs.select(d.alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return docs.withColumn("d", d).withColumn("th", F.lit(0).cast("long") if unique else F.xxhash64("text"))


def covered(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The union of the ranges within 0 to ``n``, as maximal runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, min(hi, n)))
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_spans: int = BUCKET_SPANS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if ``with_text``.

    Kept bytes need not be UTF-8: a cut can fall inside a character.
    """
    prepare(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    keyed = identified(docs.select("doc_id", "text"))
    marks = store(removed_ranges(keyed, length, gram, bucket_spans).groupBy("d", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "suffix-ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            rows = []
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                runs = covered([(r["lo"], r["hi"]) for r in ranges or []], len(raw))
                ends = [0, *[x for run in runs for x in run], len(raw)]
                kept = b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            out = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array([r[4] for r in rows], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    joined = keyed.join(marks, ["d", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op5_bytes(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return dedup_bytes(docs)


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS p, x FROM d WHERE length(x) >= 200),
w AS (SELECT doc_id, p, md5_number(substring(x, (2 * p + 1)::BIGINT, 200)) AS s FROM p),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, p - 100 > lag(p) OVER o OR lag(p) OVER o IS NULL AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
v AS (SELECT doc_id, k, min(p) AS lo, max(p) + 100 AS hi FROM k GROUP BY doc_id, k),
t AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM v),
a AS (
  SELECT d.doc_id, any_value(x) AS x, coalesce(sum(hi - lo), 0) AS n_removed, count(lo) AS n_spans, coalesce(max(hi), 0) AS e,
    coalesce(string_agg(substring(x, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT), '' ORDER BY lo), '') AS kept
  FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, n_removed::BIGINT AS n_removed, n_spans,
  sha256(unhex(kept || substring(x, (2 * e + 1)::BIGINT))) AS kept_sha256 FROM a
"""
