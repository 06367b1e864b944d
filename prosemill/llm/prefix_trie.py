"""A trie of conversations from sorted turn arrays.

Each turn becomes a digest of role and text, each conversation the array of its
turns' digests.  The arrays are range-partitioned and sorted over the whole table.
Neighbours share as many turns as their common prefix is long (LCP); a sweep keeps
the nodes of the current path on a stack, closes those deeper than the next LCP and
opens the rest.  A node is complete when it closes.

Nodes that go on in the next partition are told by the LCP of both partitions' edge
arrays.  They are the only ones that a partition leaves open: it writes what it has
of them under an id that follows from their prefix, and one aggregation stitches the
parts together.  A node counts as its parent's child, and once in what a subtree
saves, where it was opened; as a leaf where it is closed at last.  All else is sums.

The conversations that end at a node are neighbours in the order, ids ascending, and
go through its hash one by one; if a partition's edge cuts them, their ids go to one
task that hashes them as a stream.  A node with very many children is written under an
id, too, instead of keeping them waiting for its smallest member.  So a task holds a
conversation (16 bytes a turn and its length) and the nodes of a path.  The edge arrays
of all partitions meet in one task, one after the other.

Cases: turns without a conversation id belong to none; null roles and texts are empty;
null turns come first; turns of one number are ordered by the digest of role and
text, and rows that repeat are turns of their own; a conversation without turns ends
at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, partitions, prepare, store

HEAD_TURNS = 6
CENTURY = 100
PART_TURNS = 500_000
WAITING = 10_000

_SIZE = 16
_ROWS = 4096

_OUT = pa.schema(
    [
        ("kind", pa.int8()),
        ("id", pa.binary()),
        ("parent_id", pa.binary()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
_OUT_KIND = "kind byte, id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COMPLETE, _PART, _END = 0, 1, 2
_EMPTY = sha256(b"").hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: digest (hexadecimal) and code points of each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * _SIZE)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"),
    )
    own = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return turns.groupBy("conv_id").agg(own.alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of its century's first conversation, as the contract says."""
    arrays = store(arrays, "trie-arrays")
    first = F.col("conv_id") - F.col("conv_id") % CENTURY
    heads = arrays.filter(F.col("conv_id") % CENTURY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEAD_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    joined = arrays.withColumn("first", first).withColumn("h", h).join(heads, "first", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns of the common prefix of two arrays of digests."""
    low, high = 0, min(len(a), len(b)) // _SIZE
    if a[: high * _SIZE] == b[: high * _SIZE]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * _SIZE : mid * _SIZE] == b[low * _SIZE : mid * _SIZE]:
            low = mid
        else:
            high = mid
    return low


def _mark(key: bytes) -> bytes:
    return blake2b(key, digest_size=_SIZE).digest()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every partition, in order: turns shared with the one before and the one after, and marks of arrays that are equal across the edge."""
    held: list | None = None
    names = ["part", "before", "after", "same_before", "same_after"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    row = lambda r: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r[:5], kinds)], names)
    for batch in batches:
        for part, low, high in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high"))):
            now = [part, -1, -1, None, None, high]
            if held is not None:
                held[2] = now[1] = shared(held[5], low)
                if held[5] == low:
                    held[4] = now[3] = _mark(low)
                yield row(held)
            held = now
    if held is not None:
        yield row(held)


class _Node:
    """An open node: members so far, and sums over what closed below it."""

    __slots__ = ("children", "chars", "ends", "has_child", "least", "leaves", "n", "named", "new", "saved", "waiting")

    def __init__(self, chars: int, new: bool) -> None:
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.chars, self.new, self.named = None, chars, new, not new
        self.has_child, self.ends, self.waiting = False, None, []


class Sweep:
    """The stack over one partition's sorted arrays; ``rows`` has what is ready to write."""

    def __init__(self, before: int, after: int, same: set[bytes], waiting: int = WAITING) -> None:
        self.before, self.after, self.same, self.limit = before, after, same, waiting
        self.path: list[_Node] = []
        self.ids: list[bytes] = []
        self.key: bytes | None = None
        self.split = False
        self.rows: list[tuple] = []

    def _id(self, depth: int) -> bytes:
        """The id of the node at ``depth`` on the path, chained from those above it."""
        if not self.ids:
            self.ids.append(_mark(b""))
        while len(self.ids) <= depth:
            d = len(self.ids)
            self.ids.append(_mark(self.ids[-1] + self.key[(d - 1) * _SIZE : d * _SIZE]))
        return self.ids[depth]

    def _flush(self, depth: int) -> None:
        """Name the node and all above it, and write those that wait for it under its id."""
        for d in range(depth, -1, -1):
            node = self.path[d]
            node.named = True
            for r in node.waiting:
                self.rows.append((_COMPLETE, None, self._id(d), *r[0], None, *r[1]))
            node.waiting = []

    def _close(self, goes_on: bool) -> None:
        depth = len(self.path) - 1
        node = self.path[-1]
        if not node.has_child and not goes_on:
            node.leaves = 1
        node.saved += node.chars * (node.n - node.new)
        ends = node.ends.hexdigest() if node.ends else None
        if goes_on or node.named:
            self._flush(depth)
            self.rows.append((_PART, self._id(depth), self._id(depth - 1) if depth else None, depth, node.least, None, node.n, node.children, node.leaves, node.saved, ends))
        else:
            self.rows += [(_COMPLETE, None, None, *r[0], node.least, *r[1]) for r in node.waiting]
        self.path.pop()
        del self.ids[depth:]
        if not depth:
            if not (goes_on or node.named):
                self.rows.append((_COMPLETE, None, None, 0, node.least, None, node.n, node.children, node.leaves, node.saved, ends or _EMPTY))
            return
        above = self.path[-1]
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += node.new
        above.leaves += node.leaves
        above.saved += node.saved
        if not (goes_on or node.named):
            above.waiting.append(((depth, node.least), (node.n, node.children, node.leaves, node.saved, ends or _EMPTY)))
            if above.named or len(above.waiting) >= self.limit:
                self._flush(depth - 1)

    def add(self, key: bytes, conv_id: int, chars: list[int]) -> None:
        depth = len(key) // _SIZE
        if self.key is None:
            for d in range(depth + 1):
                self.path.append(_Node(chars[d - 1] if d else 0, d > self.before))
        elif key != self.key:
            common = shared(self.key, key)
            while len(self.path) - 1 > common:
                self._close(False)
            for d in range(common + 1, depth + 1):
                self.path.append(_Node(chars[d - 1], True))
        if key != self.key:
            for d in range(depth):
                self.path[d].has_child = True
            self.split = bool(self.same) and _mark(key) in self.same
        self.key = key
        node = self.path[depth]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if self.split:
            self.rows.append((_END, self._id(depth), None, None, conv_id, None, None, None, None, None, None))
        elif node.ends is None:
            node.ends = sha256(str(conv_id).encode())
        else:
            node.ends.update(f",{conv_id}".encode())

    def finish(self) -> None:
        while self.path:
            self._close(len(self.path) - 1 <= self.after)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _swept(waiting: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "before", "after", "same_before", "same_after", "key", "conv_id", "chars")]
            for now, before, after, low, high, key, conv_id, chars in zip(*columns):
                if now != part:
                    if sweep is not None:
                        sweep.finish()
                        yield _batch(sweep.rows)
                    part, sweep = now, Sweep(before, after, {low, high} - {None}, waiting)
                sweep.add(key, conv_id, chars)
                if len(sweep.rows) >= _ROWS:
                    yield _batch(sweep.rows)
                    sweep.rows = []
        if sweep is not None:
            sweep.finish()
            yield _batch(sweep.rows)

    return run


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each id's conversations, which come in order."""
    held, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([digest.hexdigest()])], ["id", "all_ends"])
    for batch in batches:
        for node, conv_id in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
            if node != held:
                if held is not None:
                    yield row()
                held, digest = node, sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
    if held is not None:
        yield row()


def prefix_trie(arrays: DataFrame, parts: int | None = None, waiting: int = WAITING) -> DataFrame:
    """The nodes of the trie of ``arrays``: conv_id and turns (digest in hexadecimal, chars)."""
    spark = arrays.sparkSession
    prepare(spark)
    keys = store(arrays.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "trie-keys")
    parts = parts or partitions(spark, -(-(keys.agg(F.sum(F.size("chars") + 1)).first()[0] or 0) // PART_TURNS))
    ordered = store(keys.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id()), "trie-ordered")
    discard(keys)
    # One row per partition, so at most as many as Spark was told to make.
    ends = ordered.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).coalesce(1).sortWithinPartitions("part")
    edges = store(ends.mapInArrow(_edges, "part int, before long, after long, same_before binary, same_after binary"), "trie-edges")
    dealt = ordered.join(F.broadcast(edges), "part").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "conv_id")
    swept = store(dealt.select("part", "before", "after", "same_before", "same_after", "key", "conv_id", "chars").mapInArrow(_swept(waiting), _OUT_KIND), "trie-swept")
    discard(ordered)
    split = swept.filter(F.col("kind") == _END).select("id", "conv_id").repartition(parts, "id").sortWithinPartitions("id", "conv_id").mapInArrow(_hashed_ends, "id binary, all_ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    stitched = swept.filter(F.col("kind") == _PART).groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = store(stitched.join(split, "id", "left").withColumn("ends_sha256", F.coalesce("all_ends", "ends", F.lit(_EMPTY))).drop("all_ends", "ends"), "trie-named")
    complete = swept.filter(F.col("kind") == _COMPLETE)
    known = complete.filter("parent_id IS NULL").select(*out)
    waits = complete.filter("parent_id IS NOT NULL").drop("kind", "id", "parent_conv_id").unionByName(named.drop("id"))
    parents = named.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    return known.unionByName(join_small(waits, parents, ["parent_id"], "left").select(*out))


def op11_trie(conversations: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return prefix_trie(rebuilt(turn_arrays(conversations)))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': digest, 'c': chars} ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY conv_id),
-- CRC-32 of the decimal id, bit by bit
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 6 AS h
  FROM own),
seq AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS s
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM seq),
prefixes AS (
  SELECT conv_id, depth, depth = len(s) AS at_end, sha256(array_to_string(list_transform(s[1:depth], lambda x: x.d), ' ')) AS id,
         CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(s[1:depth - 1], lambda x: x.d), ' ')) END AS parent,
         CASE WHEN depth > 0 THEN s[depth].c ELSE 0 END AS chars
  FROM steps),
nodes AS (
  SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM prefixes GROUP BY id),
children AS (SELECT parent AS id, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.id AS top, n.id, (n.n_convs - 1) * n.chars AS saved, n.id NOT IN (SELECT id FROM children) AS leaf
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
sums AS (SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM below GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.id LEFT JOIN children c ON c.id = n.id JOIN sums s ON s.top = n.id
"""
