"""Hierarchical language identification.

A first layer of linear support vector machines tells language families apart;
inside the winning family, one-versus-one machines separate the languages.  The
features are square roots of hashed counts of byte trigrams over the whole
text, scaled to length 1; letters only, in lower case.

The machines are fitted on the driver on a sample of labelled documents: of the
``MAX_LANGS`` most frequent labels, the rows with the smallest hashes of id and
text, ``MAX_TRAIN_PER_LANG`` a label and ``MAX_TRAIN_ROWS`` in all at most, whatever
repeats; a sample row leaves the executors as a vector of fixed size, never as
text.  The prediction is one pass without a shuffle, and
memory is bounded by a slice of texts.

Cases: a null text or one without a letter is ``und`` with score 0; a null id is
never learned from and not held out; rows are predicted one by one, repeated or
not; where nothing can be learned every document is ``und``; a text of any length
is one row of counts; ``predict`` replaces input columns called ``lang_pred`` or
``score``, the stage keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, TEXT_BATCH_BYTES, mix64, prepare, released, slices, text_bytes, unused

MAX_TRAIN_PER_LANG = 800
MAX_TRAIN_ROWS = 4000
MAX_LANGS = 200
BUCKETS = 4096
MIN_SCORE = 0.3
UND = "und"

#: Families of common languages; another language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "semitic": ("ar", "he", "mt", "am"),
    "turkic": ("tr", "az", "kk", "uz"),
}

#: Bytes as features: letters in lower case, bytes of longer characters, and 32 for the rest.
_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)
_KEYS = mix64(np.arange(1, 769, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, 256)


def _counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Trigrams of each text by bucket."""
    n = len(offs) - 1
    symbols = _SYMBOL[data]
    if len(symbols) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    mixed = _KEYS[0][symbols[:-2]] ^ _KEYS[1][symbols[1:-1]] ^ _KEYS[2][symbols[2:]]
    doc = np.repeat(np.arange(n), np.diff(offs))
    inside = (doc[:-2] == doc[2:]) & ~((symbols[:-2] == 32) & (symbols[1:-1] == 32))
    cell = doc[:-2][inside] * BUCKETS + (mixed[inside] >> np.uint64(52)).astype(np.int64)
    return np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``BUCKETS`` values for each text; one long text is counted a megabyte at a time."""
    if len(offs) == 2 and len(data) > SLICE_BYTES:
        parts = (data[a : a + SLICE_BYTES + 2] for a in range(0, len(data) - 2, SLICE_BYTES))
        counts = sum(_counts(part, np.array([0, len(part)])) for part in parts)
    else:
        counts = _counts(data, offs)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    data, offs = text_bytes(column)
    for i, j in slices(offs):
        for a in range(i, j, 256):
            b = min(j, a + 256)
            yield features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """A linear support vector machine with squared hinge loss; ``y`` is -1 or 1, classes weigh alike.

    Accelerated gradient steps on the primal from zero: the same sample gives the same machine.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (4.0 + penalty)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * (x.T @ (weight * slack * y)))
        ahead, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


@dataclass
class Duels:
    """One-versus-one machines over some classes; ``chances`` gives each class's chance."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    machines: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        margins = x @ self.machines[:, :-1].T + self.machines[:, -1]
        win = 1 / (1 + np.exp(-4.0 * np.clip(margins, -8, 8)))
        votes = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += np.log(win[:, k])
            votes[:, b] += np.log1p(-win[:, k])
        votes = np.exp((votes - votes.max(axis=1, keepdims=True)) * 2 / len(self.classes))
        return votes / votes.sum(axis=1, keepdims=True)


def fit_duels(x: np.ndarray, labels: np.ndarray) -> Duels:
    classes = sorted(set(labels.tolist()))
    pairs, machines = list(combinations(range(len(classes)), 2)), []
    for a, b in pairs:
        rows = (labels == classes[a]) | (labels == classes[b])
        machines.append(fit_svm(x[rows], np.where(labels[rows] == classes[a], 1.0, -1.0).astype(np.float32)))
    return Duels(classes, pairs, np.array(machines, np.float32).reshape(len(pairs), x.shape[1] + 1))


@dataclass
class LanguageModel:
    family: Duels
    within: dict[str, Duels]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        chances = self.family.chances(x)
        best = chances.argmax(axis=1)
        langs, score = np.empty(len(x), object), chances[np.arange(len(x)), best]
        for f in set(best.tolist()):
            rows = np.flatnonzero(best == f)
            duels = self.within[self.family.classes[f]]
            inner = duels.chances(x[rows])
            top = inner.argmax(axis=1)
            langs[rows] = np.array(duels.classes, object)[top]
            score[rows] *= inner[np.arange(len(rows)), top]
        return langs.tolist(), score


def family_of(lang: str, families: dict[str, tuple[str, ...]] | None = None) -> str:
    return next((f for f, members in (families or FAMILIES).items() if lang in members), f"only:{lang}")


def fit(docs: DataFrame, families: dict[str, tuple[str, ...]] | None = None, per_lang: int = MAX_TRAIN_PER_LANG, most_rows: int = MAX_TRAIN_ROWS) -> LanguageModel | None:
    """Learn from ``text`` and ``lang`` of a bounded sample of the rows that are not held out."""
    prepare(docs.sparkSession, TEXT_BATCH_BYTES)
    usable = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(MAX_LANGS, most_rows)).collect()}
    if not counts:
        return None
    cap = max(1, min(per_lang, most_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, 2 * cap / n) * (1 << 30)))])
    order = F.xxhash64("doc_id", "text", F.lit("sample"))
    # About twice the rows that are wanted are drawn; equal ones count once, and the cap is exact.
    drawn = usable.withColumn("order", order).filter(F.pmod("order", F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).groupBy("lang", "order").agg(F.min("text").alias("text"))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 30)), "order"))).filter(F.col("place") <= cap)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v.astype(np.float16).tobytes() for block in _blocks(batch.column("text")) for v in block]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), pa.array(rows, pa.binary())], names=["order", "lang", "x"])

    rows = sorted(((r["lang"], r["order"], bytes(r["x"])) for r in drawn.select("order", "lang", "text").mapInArrow(released(vectors), "order long, lang string, x binary").collect()), key=lambda r: r[:2])
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    langs = np.array([r[0] for r in rows], object)
    groups = np.array([family_of(lang, families) for lang in langs], object)
    return LanguageModel(fit_duels(x, groups), {f: fit_duels(x[groups == f], langs[groups == f]) for f in sorted(set(groups.tolist()))})


def held_out():
    """The fixed fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: LanguageModel | None, lang_pred: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    docs = docs.drop(lang_pred, score_name)
    if model is None:
        return docs.withColumns({lang_pred: F.lit(UND), score_name: F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score_name, T.DoubleType())])
    kept, names = docs.columns, schema.names
    (flag,) = unused(docs, "lettered")
    lettered = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = [np.empty(0)]
            for x in _blocks(batch.column("text")):
                lang, score = model.predict(x)
                langs += lang
                scores.append(score)
            known = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
            named = [lang if k else UND for lang, k in zip(langs, known)]
            score = np.where(known, np.clip(np.concatenate(scores), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(named, pa.string()), pa.array(score)], names=names)

    return lettered.mapInArrow(released(run), schema)


def op8_language(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def language_stage(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that have no language or a score below ``least``."""
    lang, score = unused(docs, "lang_pred", "score")
    return predict(docs, fit(docs), lang, score).filter((F.col(lang) != UND) & (F.col(score) >= least)).select(*[f"`{c}`" for c in docs.columns])
