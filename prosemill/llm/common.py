"""Shared pieces of the training-data operators.

* ``store`` cuts lineage: it writes a table below ``spark.checkpoint.dir``
  (shared by driver and executors) and rereads it, so that a lost executor
  costs a reread and never a recomputation of the whole plan.  Stored tables that
  were not discarded before go when the driver ends.
* the byte helpers look at an Arrow string column as one ``uint8`` vector plus
  offsets, so that words, lines and n-grams are found by vector operations on
  slices of about a megabyte, whatever the Arrow batch holds.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: code points 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast; checked against the table before each broadcast.
BROADCAST_ROWS = 20_000

#: A key is hot with this part of all rows; so there are no more hot keys than that.
HOT_KEYS = 1000

SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch of whole texts; both sides of a worker's socket hold some.
TEXT_BATCH_BYTES = 4 << 20

#: From so large a group on, a worker gives its memory back after it.
RELEASE_BYTES = 4 << 20

#: Paths of the stored tables that are not discarded yet.
_STORED: dict[str, SparkSession] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where it is unset and driver and executors are one process."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.prosemill.scratch", None)
    if not root:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="prosemill-")
        spark.conf.set("spark.prosemill.scratch", root)
    return root.rstrip("/")


def prepare(spark: SparkSession, batch_bytes: int = 8 << 20) -> None:
    """Bound Arrow batches, and let finished queries give their shuffle files back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def release() -> None:
    """Give memory that is free back to the system: a worker outlives its tasks, and what it keeps adds to the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run``, of batches or of a group, that releases memory when a task's batches or a large group are done."""

    def batches_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    def done(table: pa.Table, out: pa.Table) -> pa.Table:
        if table.nbytes >= RELEASE_BYTES:
            release()
        return out

    def group(table: pa.Table) -> pa.Table:
        return done(table, run(table))

    def keyed(key: tuple, table: pa.Table) -> pa.Table:
        return done(table, run(key, table))

    kind = next(iter(inspect.signature(run).parameters))
    return {"batches": batches_, "table": group, "key": keyed}[kind]


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _STORED[path] = spark
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later result reads."""
    _delete(df.sparkSession, df.stored_at)
    _STORED.pop(df.stored_at, None)


@atexit.register
def _discard_rest() -> None:
    for path, spark in _STORED.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``df``, whose keys may be hot, to ``small``, which is unique on the keys.

    ``small`` is broadcast only after its rows were counted against
    ``BROADCAST_ROWS``; beyond that both sides are salted, so that a hot key
    spreads over ``salts`` tasks.  Null keys match null keys.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys]))
        on = None
        for k in keys:
            match = df[k].eqNullSafe(right[f"_k_{k}"])
            on = match if on is None else on & match
        return df.join(right, on, how).drop(*[f"_k_{k}" for k in keys])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    right = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys]).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = salted["_salt"] == right["_s"]
    for k in keys:
        on = on & salted[k].eqNullSafe(right[f"_k_{k}"])
    return salted.join(right, on, how).drop("_salt", "_s", *[f"_k_{k}" for k in keys])


def join_split(df: DataFrame, counted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Join ``df`` to ``counted``, unique on ``keys`` with ``n``, the rows of ``df`` that have the key.

    Keys with a thousandth of all ``rows`` or more are a thousand at most; they
    are broadcast, and the others shuffle.  ``df`` should be a stored table, as
    it is read twice.
    """
    hot = F.col("n") >= max(2, rows // HOT_KEYS)
    frequent, rest = counted.filter(hot).drop("n"), counted.filter(~hot).drop("n")
    return df.join(F.broadcast(frequent), keys).unionByName(df.join(rest.hint("merge"), keys))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


# --- bytes ---------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its ``n + 1`` offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SLICE_BYTES`` that end before white space; a longer word is one range."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE_BYTES)
        while b < n:
            blank = np.flatnonzero(_SPACE[data[b : b + 65536]])
            if len(blank):
                b += int(blank[0])
                break
            b = min(n, b + 65536)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each run of bytes that are not white space."""
    n = len(data)
    if n == 0:
        return (np.empty(0, np.int64),) * 3
    if n > 4 * SLICE_BYTES and len(offs) == 2:
        parts = []
        for a, b in stretches(data):
            m = min(b - a, SLICE_BYTES)
            s, e, _ = word_spans(data[a : a + m], np.array([0, m]))
            if m < b - a:  # the rest is one word, or the end of one
                s, e = (s, np.append(e[:-1], b - a)) if len(e) and e[-1] == m else (np.append(s, m), np.append(e, b - a))
            parts.append((s + a, e + a))
        s, e = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return s, e, np.zeros(len(s), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, np.ndarray] = {}
_POWERS_KEPT = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; those for long texts are not kept."""
    if len(_POWERS.get("up", ())) > n:
        return _POWERS["up"], _POWERS["down"]
    size, made = max(1 << 16, 1 << int(n + 1).bit_length()) if n < _POWERS_KEPT else n + 1, {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        p = np.full(size, np.uint64(base))
        p[0] = 1
        made[name] = np.cumprod(p, dtype=np.uint64)
    if n < _POWERS_KEPT:
        _POWERS.update(made)
    return made["up"], made["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any span of bytes."""
    up, _ = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=acc[1:])
    return acc


def span_hash(acc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``[s, e)``, equal for equal bytes anywhere."""
    _, down = _powers(len(acc))
    return mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of spans in order that do not overlap, a megabyte at a time: ``span_hash``, and for longer spans a chain of those of their megabytes."""
    out, i = np.empty(len(s), np.uint64), 0
    while i < len(s):
        if e[i] - s[i] > SLICE_BYTES:
            cuts = [*range(int(s[i]), int(e[i]), SLICE_BYTES), int(e[i])]
            out[i] = chain(*(hash_spans(data, np.array([a]), np.array([b])) for a, b in zip(cuts, cuts[1:])))[0]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, side="right")))
        out[i:j] = span_hash(prefix_hash(data[s[i] : e[j - 1]]), s[i:j] - s[i], e[i:j] - s[i])
        i = j
    return out


def chain(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of equally long hash vectors."""
    out = np.full(len(parts[0]), np.uint64(0x9FB21C651E98DF25))
    for p in parts:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def binary_lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column with the raw bytes of ``values[offs[i]:offs[i + 1]]``."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * size).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
