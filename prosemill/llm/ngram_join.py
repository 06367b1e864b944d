"""Exact Jaccard join of documents' n-gram sets by a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns the 64-bit hashes of their
n-grams.  Which rows can reach the bound follows from sizes and column counts: with
the columns in one order, rarest first, two sets that reach it share one of the
first ``n - ceil(n * percent / 100) + 1`` columns of either (n is its size).  A
column that a single row has cannot be shared, so a document with that many
n-grams of its own meets no other, whatever passages it has in common with them.

The matrix is cut into blocks of columns.  A slice of documents sends each block
its incidences, 8 bytes each; the block counts its columns and sends back what
several rows have; the slice picks the first columns of its documents.  The very
common columns, those of a hundredth of all rows, are told beforehand from the
slices in which they are common, come last in the order and stay in their slice.
Rows that share a first column are range-partitioned and sorted by it and each is
joined to its neighbour only; the components of these edges contain all links and
tell which rows are multiplied with which.

Within such a component the product of the rows with each other is accumulated
block of columns by block of columns, and a pair is discarded as soon as its
overlap and what both rows have left cannot reach the overlap that their sizes
ask for.  A component with more than ``TILE_ROWS`` rows or ``TILE_GRAMS`` n-grams is
cut into blocks of rows.  First each block is multiplied with itself and the
component's first row; rows that it reaches are linked already and need not meet
each other again.  The rest, blocks of their own, then meets all rows in tiles.
So a component of n copies of one text sends n rows.  A tile sends on a spanning
forest of its links, never all of them.

Documents with equal sets are one row of the matrix.  Texts are read whole; the
sets of documents without a candidate never leave the first pass.  A node of the
link graph is a number of 20 digits, the doc_id or one above all of them.

Cases: a null or empty text, or one without words, has an empty set and links to
nothing; with fewer words than n, the whole sequence is the one n-gram; doc_id may
be any long; rows with equal doc_id are one node of the link graph, whatever their
texts, and each gives one row; a null doc_id is a node of its own for each text,
last in order, and never a component's name unless all its members have none
(then null); texts of any length are hashed a megabyte at a time; other columns
are ignored, and the stage keeps them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SLICE_BYTES, TEXT_BATCH_BYTES, binary_lists, chain, hash_spans, join_split, lower_ascii, mix64, partitions, prepare, released, slices, store, text_bytes, unused, word_spans
from .components import connected_components

WIDTH = 3
PERCENT = 90
HOT_SHARE = 100
BLOCK_GRAMS = 4_000_000
SLICE = 2 << 20
TILE_ROWS = 1024
TILE_GRAMS = 1 << 20
COLUMN_BLOCK = 2048

#: Rows of a product at a time.
PRODUCT_ROWS = 128

#: Near-duplicate stages: five words and a similarity of 0.8.
STAGE_WIDTH = 5
STAGE_PERCENT = 80

#: Nodes from here on stand for rows without a doc_id.
NO_ID = 1 << 63
NODE, NODE_TYPE = "decimal(20,0)", pa.decimal128(20, 0)

#: Keys of a sorted bucket, some 100 MB.
BUCKET_KEYS = 4_000_000


def node_id() -> Column:
    """doc_id, or a number above all ids from a hash of the text."""
    none = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)).cast(NODE) + F.lit(str(NO_ID)).cast(NODE)
    return F.coalesce(F.col("doc_id").cast("long").cast(NODE), none.cast(NODE))


def known_id(node: str) -> Column:
    """The doc_id of a node, null for rows without one."""
    return F.when(F.col(node) < F.lit(str(NO_ID)).cast(NODE), F.col(node).cast("long"))


def gram_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's n-grams, end to end, and their offsets."""
    data = lower_ascii(data)
    s, e, doc = word_spans(data, offs)
    word = hash_spans(data, s, e)
    n_words = np.bincount(doc, minlength=len(offs) - 1)
    n = max(0, len(word) - width + 1)
    gram, owner = chain(*[word[k : k + n] for k in range(width)]) if n else np.empty(0, np.uint64), doc[:n]
    inside = owner == doc[width - 1 : width - 1 + n]
    gram, owner = gram[inside], owner[inside]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = n_words[short].astype(np.uint64)
        for k in range(width - 1):
            whole = np.where(n_words[short] > k, chain(whole, word[np.minimum(first + k, len(word) - 1)]), whole)
        gram, owner = np.concatenate([gram, whole]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(len(offs)))


def _batches(batches: Iterator[pa.RecordBatch], width: int, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their sets, a slice of texts at a time."""
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for i, j in slices(offs, size):
            gram, to = gram_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
            yield batch.slice(i, j - i), gram, to


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[offs[1:]] - total[offs[:-1]]).view(np.int64)


def links(sizes: np.ndarray, gram: np.ndarray, offs: np.ndarray, percent: int, column_block: int = COLUMN_BLOCK) -> np.ndarray:
    """Smallest linked row reachable from each row: the blocked product of the rows with each other.

    Rows come sorted by size.  ``alive`` holds the rows that still have a pair
    which can reach its bound; the others leave the product.  Overlaps and bounds
    are two squares of 4 bytes a pair, worked on some rows at a time.
    """
    n = len(sizes)
    column, df = np.unique(gram, return_inverse=True, return_counts=True)[1:]
    shared = df[column] > 1
    column = (np.cumsum(df > 1) - 1)[column[shared]].astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[shared]
    del shared, df
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    del order
    left = np.bincount(row, minlength=n).astype(np.int64)
    alive = np.arange(n)
    need, overlap = np.empty((n, n), np.int32), np.zeros((n, n), np.int32)
    for a in range(0, n, PRODUCT_ROWS):
        need[a : a + PRODUCT_ROWS] = -(-percent * (sizes[a : a + PRODUCT_ROWS, None] + sizes[None, :]) // (100 + percent))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, column_block):
        lo, hi = np.searchsorted(column, [start, start + column_block])
        place = np.full(n, -1)
        place[alive] = np.arange(len(alive))
        r, c = place[row[lo:hi]], column[lo:hi] - start
        part = np.zeros((len(alive), column_block), np.float32)
        part[r[r >= 0], c[r >= 0]] = 1
        left -= np.bincount(row[lo:hi], minlength=n)
        rest, stay = left[alive], np.empty(len(alive), bool)
        for a in range(0, len(alive), PRODUCT_ROWS):
            some = slice(a, a + PRODUCT_ROWS)
            overlap[some] += (part[some] @ part.T).astype(np.int32)
            can = overlap[some] + np.minimum(rest[some, None], rest[None, :]) >= need[some]
            np.fill_diagonal(can[:, some], False)
            stay[some] = can.any(axis=1)
        if not stay.all():
            alive, overlap, need = alive[stay], overlap[np.ix_(stay, stay)], need[np.ix_(stay, stay)]
    linked = overlap >= need if len(column) else np.zeros((n, n), bool)
    del overlap, need
    root = np.arange(n)
    np.fill_diagonal(linked, True)
    label = np.arange(len(alive))
    while len(alive):
        new = np.concatenate([np.where(linked[a : a + PRODUCT_ROWS], label[None, :], len(alive)).min(axis=1) for a in range(0, len(alive), PRODUCT_ROWS)])
        new = new[new]
        if (new == label).all():
            break
        label = new
    root[alive] = alive[label] if len(alive) else alive
    return root


def _tile(percent: int):
    """a, b: a spanning forest of the links between a tile's rows; the leading row, where there is one, is a root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lead", "descending"), ("n", "ascending"), ("d", "ascending")]).combine_chunks()
        n, sets = table.column("n").to_numpy(), table.column("grams")
        gram = np.concatenate([np.frombuffer(sets[i].as_buffer(), np.uint64) for i in range(len(n))])
        root = links(n, gram, np.concatenate([[0], np.cumsum(n)]), percent)
        keep = pa.array(np.flatnonzero(root != np.arange(len(n))))
        d = table.column("d")
        return pa.table({"a": d.take(keep), "b": d.take(pa.array(root).take(keep))})

    return released(run)


def _multiplied(rows: DataFrame, percent: int, tile_rows: int, tile_grams: int) -> DataFrame:
    """a, b: links that span all that link the rows of a coarse component; ``rows``, stored, has root, d, n, grams."""
    kind = f"a {NODE}, b {NODE}"
    size = lambda: F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / tile_grams)).cast("int")
    sizes = store(rows.groupBy("root").agg(size().alias("blocks"), F.min("d").alias("first"), F.count("*").alias("n")), "ngram-sizes")
    large, none = sizes.filter("blocks > 1"), F.lit(False).alias("lead")
    n_large = large.count()
    roots = F.broadcast(large.select("root")) if n_large <= BROADCAST_ROWS else large.select("root")
    whole = rows.join(roots, "root", "left_anti").select("root", "d", "n", "grams", none).groupBy("root").applyInArrow(_tile(percent), kind)
    if not n_large:
        return whole

    total = rows.count()
    dealt = store(join_split(rows, large, ["root"], total).withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")), "ngram-dealt")
    starts = large.select("root", F.col("first").alias("d"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    lead = dealt.filter("d = first").select("root", "d", "n", "grams").dropDuplicates(["root"])
    ahead = starts.join(lead, ["root", "d"]).select("root", "own", "d", "n", "grams", F.lit(True).alias("lead"))
    blocks = dealt.select("root", "own", "d", "n", "grams", none).unionByName(ahead)
    within = store(blocks.groupBy("root", "own").applyInArrow(_tile(percent), kind), "ngram-within")

    reached = within.select(F.col("a").alias("d"), F.col("b").alias("first")).distinct()
    rest = store(dealt.filter("d <> first").join(reached, ["d", "first"], "left_anti"), "ngram-rest")
    again = rest.groupBy("root").agg(size().alias("parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    counted = store(again.join(large, "root").select("root", "parts", "n"), "ngram-again")
    part = F.pmod(F.xxhash64("d", F.lit("rest")), F.col("parts")).cast("int")
    left = join_split(rest, counted, ["root"], total).withColumn("part", part).withColumn("other", spread("blocks"))
    right = join_split(dealt, counted, ["root"], total).withColumn("part", spread("parts")).withColumn("other", F.col("own"))
    tiles = left.select("root", "part", "other", "d", "n", "grams").unionByName(right.select("root", "part", "other", "d", "n", "grams")).withColumn("lead", F.lit(False))
    return whole.unionByName(within).unionByName(tiles.groupBy("root", "part", "other").applyInArrow(_tile(percent), kind))


def _common(gram: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (48 bits) that a part of a slice's documents has, ``1 / HOT_SHARE`` and four at least, and their counts."""
    column, count = np.unique(gram >> np.uint64(16), return_counts=True)
    often = (count * HOT_SHARE >= n_docs) & (count >= 4)
    return column[often], count[often]


def _spread(width: int, n_blocks: int, hot: np.ndarray):
    """A slice's incidences by block of columns, (column << 16 | place in the slice); and a row with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        names = ["block", "slice", "body", "extra", "hot"]
        for rows, gram, to in _batches(batches, width, SLICE):
            n = np.diff(to)
            column = gram >> np.uint64(16)
            cell = column << np.uint64(16) | np.repeat(np.arange(len(n), dtype=np.uint64), n)
            common = np.isin(column, hot)
            docs = [x.tobytes() for x in (_sums(mix64(gram), to), n.astype(np.int32), np.sort(cell[common]))]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - at % n_blocks], pa.int32()), pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in docs)], names=names)
            cell = np.sort(cell[~common])
            block = ((cell >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(block, np.arange(n_blocks + 1))
            full = np.flatnonzero(np.diff(ends))
            none = pa.nulls(len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([at] * len(full), pa.int64()), pa.array([cell[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()), none, none], names=names)
            at += 1

    return released(run)


def _cells(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of binary rows end to end, and how many each row has."""
    data, offs = text_bytes(column)
    return data.view(dtype), np.diff(offs) // np.dtype(dtype).itemsize


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    """A block: the incidences of columns that several rows have, back to their slices with the columns' counts."""
    if key[0].as_py() < 0:
        return table.select(["slice", "body", "extra", "hot"])
    cell, size = _cells(table.column("body"), np.uint64)
    column = cell >> np.uint64(16)
    order = np.argsort(column, kind="stable")
    column = column[order]
    new = np.append(True, column[1:] != column[:-1])
    del column
    run = np.diff(np.append(np.flatnonzero(new), len(cell)))
    count = np.empty(len(cell), np.uint16)
    count[order] = np.repeat(np.minimum(run, 65535).astype(np.uint16), run)
    del order, run, new
    shared = count > 1
    ends = np.append(0, np.cumsum(shared))[np.append(0, np.cumsum(size))]
    cell, count = cell[shared], count[shared]
    bodies = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:])] for x in (cell, count)]
    return pa.table({"slice": table.column("slice"), "body": pa.array(bodies[0], pa.binary()), "extra": pa.array(bodies[1], pa.binary()), "hot": pa.nulls(len(size), pa.binary())})


def _first_columns(percent: int):
    """A slice with what came back: key and x for the first columns of each document that others have too."""

    def run(table: pa.Table) -> pa.Table:
        own = pc.is_valid(table.column("hot"))
        docs, back = table.filter(own), table.filter(pc.invert(own))
        (x, _), (n, _), (hot, _) = (_cells(docs.column(c), t) for c, t in (("body", np.int64), ("extra", np.int32), ("hot", np.uint64)))
        (cell, _), (count, _) = _cells(back.column("body"), np.uint64), _cells(back.column("extra"), np.uint16)
        cell, count = np.append(cell, hot), np.append(count.astype(np.int64), np.full(len(hot), 1 << 20))
        place = (cell & np.uint64(65535)).astype(np.int64)
        order = np.lexsort((cell, count, place))
        place, column = place[order], cell[order] >> np.uint64(16)
        shared = np.bincount(place, minlength=len(n))
        take = n - -(-percent * n.astype(np.int64) // 100) + 1 - (n - shared)
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        keep = rank < take[place]
        return pa.table({"key": pa.array(column[keep].astype(np.int64)), "x": pa.array(x[place[keep]])})

    return released(run)


def first_columns(texts: DataFrame, width: int, percent: int, n_grams: int, hot: np.ndarray) -> DataFrame:
    """key, x: the first columns of each set, where others have them; sets that can reach the bound share one."""
    n_blocks = max(partitions(texts.sparkSession), -(-n_grams // BLOCK_GRAMS))
    spread = texts.select("text").mapInArrow(_spread(width, n_blocks, hot), "block int, slice long, body binary, extra binary, hot binary")
    counted = spread.groupBy("block").applyInArrow(released(_counted), "slice long, body binary, extra binary, hot binary")
    return store(counted.groupBy("slice").applyInArrow(_first_columns(percent), "key long, x long"), "ngram-keys")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted bucket of keys: neighbours with equal keys and other sets, and the bucket's first and last row."""
    names, last = ["a", "b", "key", "x"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, x = batch.column("key").to_numpy(), batch.column("x").to_numpy()
        ends = [] if last is not None else [0]
        if last is not None:
            key, x = np.append(last[0], key), np.append(last[1], x)
        at = np.flatnonzero((key[1:] == key[:-1]) & (x[1:] != x[:-1]))
        pairs = np.unique(np.stack([x[at], x[at + 1]]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        none = pa.nulls(pairs.shape[1] + len(ends), pa.int64())
        edge = [pa.array(np.append(p, np.zeros(len(ends), np.int64)), mask=np.arange(len(none)) >= pairs.shape[1]) for p in pairs]
        first = [pa.array(np.append(np.zeros(pairs.shape[1], np.int64), v[ends]), mask=np.arange(len(none)) < pairs.shape[1]) for v in (key, x)]
        yield pa.RecordBatch.from_arrays([*edge, *first], names=names)
        last = key[-1], x[-1]
    if last is not None:
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=names)


def candidates(keys: DataFrame) -> DataFrame:
    """a, b: edges that connect all sets x with a common key; a key that is common is split over buckets."""
    n = max(partitions(keys.sparkSession), -(-keys.count() // BUCKET_KEYS))
    chained = store(keys.repartitionByRange(n, "key", "x").sortWithinPartitions("key", "x").mapInArrow(released(_chained), "a long, b long, key long, x long"), "ngram-chained")
    ends = chained.filter("key IS NOT NULL").select("key", "x").distinct()
    across = ends.join(ends.groupBy("key").agg(F.min("x").alias("b")), "key").filter("x <> b").select(F.col("x").alias("a"), "b")
    return chained.filter("key IS NULL").select("a", "b").unionByName(across)


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, tile_rows: int = TILE_ROWS, tile_grams: int = TILE_GRAMS) -> DataFrame:
    """d (see ``node_id``), n (set size) and root (smallest node that links reach), one row per row of ``docs``."""
    prepare(docs.sparkSession, TEXT_BATCH_BYTES)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    texts = docs.select(node_id().alias("d"), F.xxhash64("text").alias("t"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n and the fingerprint of each document's set; and, without n, columns that are common in the slice."""
        for rows, gram, to in _batches(batches, width):
            n, x, y = np.diff(to), _sums(mix64(gram), to), _sums(mix64(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5)), to)
            yield pa.RecordBatch.from_arrays([rows.column("d"), rows.column("t"), pa.array(n), pa.array(x), pa.array(y)], names=["d", "t", "n", "x", "y"])
            column, count = _common(gram, len(n))
            none = pa.nulls(len(column), pa.int64())
            yield pa.RecordBatch.from_arrays([none.cast(NODE_TYPE), none, none, pa.array(column.astype(np.int64)), pa.array(count)], names=["d", "t", "n", "x", "y"])

    scanned = store(texts.mapInArrow(released(scan), f"d {NODE}, t long, n long, x long, y long"), "ngram-sets")
    sets = scanned.filter("n IS NOT NULL")
    total, n_grams = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # There are no more such columns than HOT_SHARE times the mean size of a set.
    common = scanned.filter("n IS NULL").groupBy("x").agg(F.sum("y").alias("y")).filter(F.col("y") * HOT_SHARE >= total)
    hot = np.array([r["x"] for r in common.collect()], np.uint64)
    edges = candidates(first_columns(texts, width, percent, n_grams, hot))
    coarse = connected_components(edges)
    members = coarse.select(F.col("node").alias("x"), "root").unionByName(coarse.select(F.col("root").alias("x"), "root")).distinct()

    different = store(sets.filter("n > 0").groupBy("n", "x", "y").agg(F.min(F.struct("d", "t")).alias("first"), F.count("*").alias("rows")), "ngram-different")
    equal = different.filter("rows > 1").select("x", "y", F.col("n").alias("size"), F.col("first.d").alias("rep"), F.col("first.t").alias("rep_t"), F.col("rows").alias("n"))
    twins = join_split(sets.withColumnRenamed("n", "size"), equal, ["size", "x", "y"], total).filter("d <> rep OR t <> rep_t")
    copies = store(twins.select("d", "t", "rep").distinct(), "ngram-copies")
    mine = sets.join(copies.select("d").distinct(), "d", "left_semi").join(copies.select("d", "t"), ["d", "t"], "left_anti")
    moved = store(copies.select("d", "rep").unionByName(mine.select("d", F.col("d").alias("rep"))).distinct(), "ngram-moved")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the joined texts; rows come sorted by d and t, and of equal ones the first counts."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            d, t = batch.column("d"), batch.column("t")
            same = np.append(last is not None and last == (d[0].as_py(), t[0].as_py()), pc.and_(pc.equal(d[1:], d[:-1]), pc.equal(t[1:], t[:-1])).to_numpy(zero_copy_only=False))
            last = d[-1].as_py(), t[-1].as_py()
            for rows, gram, to in _batches(iter([batch.filter(pa.array(~same.astype(bool)))]), width):
                yield pa.RecordBatch.from_arrays([rows.column("d"), rows.column("root"), pa.array(np.diff(to)), binary_lists(gram, to)], names=["d", "root", "n", "grams"])

    wanted = different.join(members, "x").select(F.col("first.d").alias("d"), F.col("first.t").alias("t"), "root")
    rows = store(texts.join(wanted.hint("merge"), ["d", "t"]).mapInArrow(released(fetch), f"d {NODE}, root long, n long, grams binary"), "ngram-rows")
    linked = _multiplied(rows, percent, tile_rows, tile_grams)

    place = store(moved.groupBy("d").agg(F.min("rep").alias("least")), "ngram-place")
    bridges = moved.join(place, "d").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    roots = connected_components(linked.unionByName(bridges))
    out = sets.select("d", "n").join(place, "d", "left").withColumn("rep", F.coalesce("least", "d"))
    return out.join(roots, F.col("rep") == F.col("node"), "left").select("d", "n", F.coalesce("root", "rep").alias("root"))


def op9_components(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return join_components(docs.select("doc_id", "text")).select(known_id("d").alias("doc_id"), F.col("n").alias("n_shingles"), known_id("root").alias("component_id"))


def join_stage(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id, whole and once.

    Where that id repeats, its first row in the order of the columns stays.
    """
    keep, place = unused(docs, "keep", "place")
    best = join_components(docs, STAGE_WIDTH, STAGE_PERCENT).filter("d = root").select(F.col("d").alias(keep)).distinct()
    orderable = [F.col(f"`{c}`") for c, kind in docs.dtypes if not re.search("map<|variant|interval", kind)]
    first = Window.partitionBy(keep).orderBy(*orderable)
    return docs.withColumn(keep, node_id()).join(best, keep, "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
o AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
b AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
