"""Near-duplicates among embeddings by tiles of int8 products with exact error bounds.

A vector of length one is rounded to int8 by a scale of its own; the length of what
rounding took away is its error bound.  The product of two rounded vectors is an
exact integer, and the true cosine differs from it by at most what both errors allow
(Cauchy-Schwarz).  So a tile, the product of two blocks of rounded vectors, tells
most pairs for certain; the rows of the others are sent to the tile once more with
all their digits, and only those pairs are computed again in double precision.

Vectors of a label are cut into cells by their places along two directions.  Near
vectors are at most sqrt(2 - 2 * threshold) apart along any direction, so only neighbouring cells
meet.  Directions are the principal ones of ``SAMPLE_ROWS`` vectors; any others would
give the same result, more slowly.  Large cells are dealt into blocks of ``BLOCK``.

A tile sends a count and one edge per row that has links, never the pairs.  Equal
vectors of a label are one class from the start, with one row in the tiles.

Cases: vectors that are null, without components, all zero, or hold a null or
non-finite component link with nothing, nor do rows with a null label; vectors of
other lengths count as filled up with zeros; rows that repeat an id are vectors of
their own; a row without an id links like others, but names no component (null only
if no row of it has an id) and is not kept; components of any finite size are
scaled by a power of two first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, prepare, store
from .components import connected_components

THRESHOLD = 0.98
BLOCK = 2048
SAMPLE_ROWS = 2048
DIRECTIONS = 2

#: Products of so many int8 components add up exactly in single precision.
_EXACT = (1 << 24) // (127 * 127)

#: Above the rounding error of any sum below; near the threshold by less, a pair is computed again.
_SLACK = 1e-9

_PAIRS = 1 << 20


# --- vectors ----------------------------------------------------------------


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles filled up with zeros, scaled to a largest component of 0.5 to 1, and their lengths."""
    sizes = np.array([len(v) // 8 for v in column.to_pylist()], np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return out, np.sqrt(np.einsum("ij,ij->i", out, out))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and bounds on the length of each row's rounding error; rows have length one."""
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + _SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of two int8 matrices."""
    dims = min(a.shape[1], b.shape[1])
    if dims <= _EXACT:
        return a[:, :dims].astype(np.float32) @ b[:, :dims].astype(np.float32).T
    return sum((products(a[:, i : min(i + _EXACT, dims)], b[:, i : min(i + _EXACT, dims)]).astype(np.float64) for i in range(0, dims, _EXACT)), np.zeros((len(a), len(b))))


def bounds(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs certainly at the threshold or above, and pairs that may be either side of it."""
    (qa, sa, ea), (qb, sb, eb) = left, right
    near = products(qa, qb) * (sa[:, None] * sb)
    error = ea[:, None] + eb * (1 + ea)[:, None] + _SLACK
    sure = near - error >= threshold
    return sure, ~sure & (near + error >= threshold)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _linked(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """For the rows of the pairs (a, b): vectors linked, and one other row of the same component."""
    n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    at = np.flatnonzero(n)
    return pa.table({"node": ids[at], "links": n[at].astype(np.int64), "other": ids[_forest(len(ids), a, b)[at]]})


# --- one tile ---------------------------------------------------------------

_TILE = ("a", "b", "i", "j")
_TILE_KIND = "a long, b long, i int, j int"


def _side(table: pa.Table, left: bool) -> tuple[pa.Table, tuple]:
    some = table.filter(pc.equal(table.column("is_left"), left)).sort_by("node").combine_chunks()
    raw = some.column("codes").to_pylist()
    sizes = np.array([len(v) for v in raw], np.int64)
    codes = np.zeros((len(raw), int(sizes.max(initial=0))), np.int8)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(raw), np.int8)
    return some, (codes, some.column("scale").to_numpy(), some.column("error").to_numpy())


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple, tuple, bool, int]:
    """Ids and class sizes of the rows, left before right, and both matrices; one block with itself has no right side."""
    left, x = _side(table, True)
    right, y = _side(table, False)
    alone = right.num_rows == 0 and table.column("a")[0] == table.column("b")[0] and table.column("i")[0] == table.column("j")[0]
    rows = left if alone else pa.concat_tables([left, right])
    return rows.column("node").to_numpy(), rows.column("size").to_numpy().astype(float), x, x if alone else y, alone, left.num_rows


def _masks(x: tuple, y: tuple, alone: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    sure, open_ = bounds(x, y, threshold)
    return (np.triu(sure, 1), np.triu(open_, 1)) if alone else (sure, open_)


def _first(threshold: float):
    """Links that the rounded vectors prove, and the rows of the pairs that they leave open."""

    def run(table: pa.Table) -> pa.Table:
        ids, weight, x, y, alone, n = _sides(table)
        shift = 0 if alone else n
        sure, open_ = _masks(x, y, alone, threshold)
        a, b = np.nonzero(sure)
        found = _linked(ids, weight, a, b + shift)
        again = np.unique(np.concatenate([np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0)) + shift]))
        key = [table.column(c)[0].as_py() for c in _TILE]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        tile = lambda rows: {c: pa.array([v] * rows, k) for c, v, k in zip(_TILE, key, kinds)}
        side = pa.array((again < n).tolist(), pa.bool_())
        return pa.concat_tables(
            [
                pa.table(tile(found.num_rows) | {"is_left": pa.nulls(found.num_rows, pa.bool_())} | {c: found.column(c) for c in ("node", "links", "other")}),
                pa.table(tile(len(again)) | {"is_left": side, "node": pa.array(ids[again], pa.int64()), "links": pa.nulls(len(again), pa.int64()), "other": pa.nulls(len(again), pa.int64())}),
            ]
        )

    return run


def _second(threshold: float):
    """Links among the open pairs, in double precision."""

    def run(table: pa.Table) -> pa.Table:
        ids, weight, x, y, alone, n = _sides(table)
        shift = 0 if alone else n
        _, open_ = _masks(x, y, alone, threshold)
        a, b = np.nonzero(open_)
        vectors = pa.concat_tables([table.filter(pc.equal(table.column("is_left"), s)).sort_by("node") for s in (True, False)])
        v, length = _units(vectors.column("v").combine_chunks())
        b, keep, step = b + shift, np.zeros(len(a), bool), max(1, _PAIRS // max(1, v.shape[1]))
        for k in range(0, len(a), step):
            p, q = a[k : k + step], b[k : k + step]
            keep[k : k + step] = np.einsum("ij,ij->i", v[p], v[q]) / (length[p] * length[q]) >= threshold
        return _linked(ids, weight, a[keep], b[keep])

    return run


# --- the join ---------------------------------------------------------------


def _read(batches):
    """label, digest of label and components, components scaled by a power of two, as bytes; null unless they can link."""
    for batch in batches:
        digests, vectors = [], []
        embedding = batch.column("embedding")
        flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        ends = np.cumsum(embedding.value_lengths().fill_null(0).to_numpy())
        for label, x in zip(batch.column("label").to_pylist(), np.split(flat, ends[:-1])):
            most = np.abs(x).max(initial=0)  # NaN if there is one
            if label is None or not 0 < most < math.inf:
                digests.append(None)
                vectors.append(None)
                continue
            raw = (np.ldexp(x, -math.frexp(most)[1]) + 0.0).tobytes()
            digests.append(blake2b(f"{len(str(label))}:{label}:".encode() + raw, digest_size=16).digest())
            vectors.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "digest", "v"])


def _directions(classes: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The principal directions of a bounded sample, by digest; fewer rows where vectors are long."""
    width = classes.agg(F.max(F.length("v"))).first()[0] // 8
    sample = classes.orderBy("digest").limit(max(16, min(rows, (1 << 22) // width))).select("v").toArrow()
    x, length = _units(sample.column("v").combine_chunks())
    x /= length[:, None]
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIRECTIONS]


def _coded(directions: np.ndarray, width: float):
    """int8 codes with bounds, and the cell: the places along the directions in steps of ``width``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, length = _units(batch.column("v"))
            unit = v / length[:, None]
            codes, scale, error = quantised(unit)
            dims = min(unit.shape[1], directions.shape[1])
            cell = np.zeros((len(unit), DIRECTIONS), np.int32)
            cell[:, : len(directions)] = np.floor(unit[:, :dims] @ directions[:, :dims].T / width)
            sizes = [len(r) // 8 for r in batch.column("v").to_pylist()]
            raw = pa.array([c[:n].tobytes() for c, n in zip(codes, sizes)], pa.binary())
            places = [pa.array(cell[:, k]) for k in range(DIRECTIONS)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "label", "size")], raw, pa.array(scale), pa.array(error), *places], ["node", "label", "size", "codes", "scale", "error", "x", "y"])

    return run


def _tiles(coded: DataFrame, n: int, block: int) -> DataFrame:
    """The ``n`` rows of ``coded`` once for each tile that they are in."""
    # Labels of one block are one cell; of others, each cell meets itself and its neighbours.
    counted = coded.groupBy("label", "x", "y").count().withColumn("all", F.sum("count").over(Window.partitionBy("label")))
    place = lambda c: F.when(F.col("all") <= block, 0).otherwise(F.col(c))
    places = store(counted.select("label", "x", "y", place("x").alias("cx"), place("y").alias("cy"), "count"), "embedding-places")
    cells = places.groupBy("label", "cx", "cy").agg(F.ceil(F.sum("count") / block).cast("int").alias("blocks"))
    cells = store(cells.withColumn("cell", F.monotonically_increasing_id()), "embedding-cells")
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    around = cells.withColumn("d", step).select("label", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), F.struct("cell", "blocks").alias("met"))
    met = cells.join(around, ["label", "cx", "cy"]).groupBy("label", "cx", "cy", "cell", "blocks").agg(F.collect_list("met").alias("met"))
    where = store(places.join(met, ["label", "cx", "cy"]).select("label", "x", "y", F.col("count").alias("n"), "cell", "blocks", "met"), "embedding-where")
    rows = join_split(coded, where, ["label", "x", "y"], n)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("node", "size", "codes", "scale", "error", "cell", "own", F.explode("met").alias("met"))
    rows = rows.select("*", F.col("met.cell").alias("to"), F.explode(F.sequence(F.lit(0), F.col("met.blocks") - 1)).alias("other"))
    is_left = (F.col("cell") < F.col("to")) | ((F.col("cell") == F.col("to")) & (F.col("own") <= F.col("other")))
    pair = lambda own, other: (F.when(is_left, F.col(own)).otherwise(F.col(other)), F.when(is_left, F.col(other)).otherwise(F.col(own)))
    (a, b), (i, j) = pair("cell", "to"), pair("own", "other")
    return rows.select(a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"), is_left.alias("is_left"), "node", "size", "codes", "scale", "error")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}"
    rows = store(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(_read, f"{kind}, digest binary, v binary"), "embedding-rows")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")
    unlinked = rows.filter("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    n, n_classes = rows.filter("digest IS NOT NULL").count(), classes.count()
    if not n_classes:
        return unlinked
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    code_kind = f"node long, label {vectors.schema['label'].dataType.simpleString()}, size long, codes binary, scale double, error double, x int, y int"
    coded = store(classes.select("node", "label", "size", "v").mapInArrow(_coded(_directions(classes), width), code_kind), "embedding-codes")
    found_kind = "node long, links long, other long"
    tiles = _tiles(coded, n_classes, block)
    first = store(tiles.groupBy(*_TILE).applyInArrow(_first(threshold), f"{_TILE_KIND}, is_left boolean, {found_kind}"), "embedding-first")
    again = first.filter("is_left IS NOT NULL").drop("links", "other").join(coded.select("node", "size", "codes", "scale", "error").join(classes.select("node", "v"), "node"), "node")
    second = store(again.groupBy(*_TILE).applyInArrow(_second(threshold), found_kind), "embedding-second")
    found = first.filter("is_left IS NULL").select("node", "links", "other").unionByName(second)
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "node", "size", "least").join(links, "node", "left").join(roots, "node", "left")
    joined = F.col("links").isNotNull()
    named = store(named.select("digest", "least", F.when(joined, F.coalesce("root", "node")).alias("root"), "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "embedding-named")
    several = named.filter("root IS NOT NULL")
    least = several.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    out = ["digest", "n_links", "component_id", F.col("size").alias("n")]
    alone = named.filter("root IS NULL").withColumn("component_id", F.col("least"))
    classed = alone.select(*out).unionByName(join_split(several, least, ["root"], several.count()).select(*out))
    linked = join_split(rows.filter("digest IS NOT NULL").select("vec_id", "digest"), store(classed, "embedding-classed"), ["digest"], n)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(unlinked)


def op12_near_vectors(embeddings: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return near_vectors(embeddings)


OP12_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v
  FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE v IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts ON a = vec_id
"""
