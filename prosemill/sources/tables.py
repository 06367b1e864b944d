"""Readers and writers of the corpus files.

Everything goes through Spark's own readers and writers, so any store works.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import CorpusError, admit
from ..schemas import FAILURE, POLISH_CACHE

#: Paths below the shared folder that this driver has made.
_SCRATCH: dict[str, SparkSession] = {}

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Text columns as they are: labels are coerced, never inferred."""
    reader = spark.read.options(**_CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    """A projection; None if a column is absent."""
    table = read_csv(spark, path)
    return table.select(*columns) if set(columns) <= set(table.columns) else None


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv", without: Sequence[str] = ()) -> list[str]:
    """Sorted paths below ``folder`` by suffix, less the names in ``without``; a table of several files is one path."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    except AnalysisException:
        raise CorpusError(f"no folder {folder}") from None
    root = folder.rstrip("/")
    inside = re.sub("^[A-Za-z0-9]+:/*", "/", root) + "/"
    name = F.split_part(F.split_part("path", F.lit(inside), F.lit(2)), F.lit("/"), F.lit(1))
    names = sorted(r[0] for r in files.select(name).distinct().collect() if r[0].endswith(suffix) and r[0] not in without)
    if not names:
        raise CorpusError(f"no {suffix} file in {folder}")
    return [f"{root}/{n}" for n in names]


def read_corpus(spark: SparkSession, paths: Sequence[str], text: str | None = None, label: str | None = None) -> DataFrame:
    """The labelled tables among ``paths`` as one: text, label, _source, in file order by _file and _row."""
    parts = [admit(read_csv(spark, p), p.rsplit("/", 1)[-1], text, label) for p in paths]
    kept = [p.withColumn("_file", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, p in enumerate(parts) if p is not None]
    if not kept:
        raise CorpusError(f"no labelled corpus among {list(paths)}")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def source_of(path: str) -> str:
    """The source of an untagged file: its stem without ``_essays``."""
    return path.rsplit("/", 1)[-1].removesuffix(".csv").replace("_essays", "")


def scratch(spark: SparkSession) -> str:
    """A new path below the session's shared folder; a local one only where driver and executors are one process."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="prosemill-")
    path = f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def read_jsonl(spark: SparkSession, path: str, key: str = "index", schema: str = POLISH_CACHE) -> tuple[DataFrame, Observation]:
    """The last row of each key, and an observation of ``n_lines`` and ``n_skipped``; blank lines are skipped.

    The counts are made in the pass that reads the rows: ``get`` waits for an action on
    them.  Skipped are lines that are no JSON, and those without a key.  Last is what
    was written last: by time and name of the file, then by place in it; splits are read
    in no particular order.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("_n")).filter(F.trim("value") != "")
    parsed = lines.select("_n", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col(f"r.{key}").isNull()
    seen = Observation()
    counted = parsed.observe(seen, F.count("*").alias("n_lines"), F.count_if(bad).alias("n_skipped"))
    # The latest row of a key as a partial maximum: a key with many lines sends one per task.
    last = counted.filter(~bad).groupBy(f"r.{key}").agg(F.max_by("r", "_n").alias("r")).select("r.*").drop("_bad")
    return last, seen


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


class CommittedLines:
    """JSON lines appended batch by batch, each batch once whatever is run again.

    A batch has a folder of its own, which a replay writes anew, and counts from the
    moment its commit is written: a commit is a file of the log, which a store
    shows whole or not at all.  Readers take the committed batches alone, so a
    writer may be lost at any time.  Only one writer may write a batch at a time.
    """

    def __init__(self, path: str) -> None:
        self.path, self.log = path.rstrip("/"), f"{path.rstrip('/')}/_log"

    def committed(self, spark: SparkSession) -> DataFrame:
        """batch and n_lines of each commit."""
        try:
            return spark.read.schema("batch long, n_lines long").json(f"{self.log}/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "batch long, n_lines long")

    def write(self, rows: DataFrame, batch: int) -> int:
        """The lines of a batch, not committed yet; what an earlier try wrote of it goes."""
        at = f"{self.path}/batch={batch}"
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(at)
        return seen.get["n"]

    def commit(self, spark: SparkSession, batch: int, lines: int) -> None:
        spark.range(1).select(F.lit(batch).alias("batch"), F.lit(lines).alias("n_lines")).coalesce(1).write.mode("overwrite").json(f"{self.log}/{batch}")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write and commit a batch; nothing happens if it is committed already."""
        spark = rows.sparkSession
        if self.committed(spark).filter(F.col("batch") == batch).isEmpty():
            self.commit(spark, batch, self.write(rows, batch))

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The lines of all committed batches, and ``batch``; a batch that was aborted is not read."""
        done = sorted(r["batch"] for r in self.committed(spark).filter("n_lines > 0").select("batch").collect())
        if not done:
            return spark.createDataFrame([], f"{schema}, batch long")
        return spark.read.schema(f"{schema}, batch long").option("basePath", self.path).json([f"{self.path}/batch={b}" for b in done])


def write_csv(rows: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """With a header, sorted over all files if ``order`` is given; texts keep the white space at their ends."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def append_failures(spark: SparkSession, rows: list[tuple[str, int, str, str]] | DataFrame, path: str) -> None:
    """Tab-separated lines of time, index, variant and reason."""
    table = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, FAILURE)
    table.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(FAILURE)]).write.mode("append").option("sep", "\t").csv(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE).option("sep", "\t").csv(path)


def stored(rows: DataFrame, **options: str) -> DataFrame:
    """``rows`` written below the shared folder and reread: computed once, whatever reads them and whatever is lost.

    Shuffle files go as soon as the table is there.  ``options`` go to the writer.
    """
    path = scratch(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    rows.write.options(compression="zstd", **options).parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(rows: DataFrame) -> None:
    """Delete what ``stored`` gave and no later result reads."""
    _delete(rows.sparkSession, rows.stored_at)
    del _SCRATCH[rows.stored_at]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_scratch() -> None:
    """What ``scratch`` named goes when the driver ends; results may be read until then."""
    for path, spark in _SCRATCH.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)
