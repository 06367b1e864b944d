import os
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from prosemill.operators import limiter
from prosemill.sources.tables import CommittedLines
from prosemill.streaming.limiter import rate_limit_evicting, rate_limit_stream, resumable

EVENT = "key string, ts double, event_id long"


def brute(rows, limit, window):
    seen, out = defaultdict(deque), {}
    for key, ts, event in sorted(rows, key=lambda r: (r[1], r[2])):
        hits = seen[key]
        while hits and hits[0] <= ts - window:
            hits.popleft()
        if len(hits) >= limit:
            out[event] = (False, 0, hits[0] + window - ts)
        else:
            hits.append(ts)
            out[event] = (True, limit - len(hits), 0.0)
    return out


def rows(n=400):
    rng = random.Random(1)
    return [(rng.choice("aaab"), float(rng.randrange(0, 500)), i) for i in range(n)]


def decisions(frame):
    return {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in frame.collect()}


def test_batch(spark):
    data = rows()
    assert decisions(limiter.rate_limit(spark.createDataFrame(data, EVENT).repartition(3), 4, 60.0)) == brute(data, 4, 60.0)


def test_edges(spark):
    data = [("k", 0.0, 1), ("k", 60.0, 2), ("k", 59.9, 3), ("k", 60.5, 4), (None, 1.0, 5)]
    got = decisions(limiter.rate_limit(spark.createDataFrame(data, EVENT), 1, 60.0))
    assert [got[i][0] for i in range(1, 6)] == [True, True, False, False, True]
    assert abs(got[3][2] - 0.1) < 1e-9 and got[4][2] == 59.5
    frame = spark.createDataFrame([(" 1.2.3.4 , 5", "h"), ("", "h"), (None, None)], "f string, h string")
    pick = lambda trusted: [r.k for r in frame.select(limiter.client_key(F.col("f"), F.col("h"), trusted).alias("k")).collect()]
    assert pick(True) == ["1.2.3.4", "h", "unknown"] and pick(False) == ["h", "h", "unknown"]
    times = spark.createDataFrame([(0.0,), (0.2,), (1.0,), (1.5,)], "x double")
    assert [r.h for r in times.select(limiter.retry_header(F.col("x")).alias("h")).collect()] == [1, 1, 1, 2]


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_stream_over_several_batches(spark, tmp_path, watermark):
    data = sorted(((k, ts + 1e6, e) for k, ts, e in rows(120)), key=lambda r: (r[1], r[2]))
    for i in range(3):
        before = set((tmp_path / "in").glob("*.parquet"))
        spark.createDataFrame(data[40 * i : 40 * i + 40], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for new in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = rate_limit_stream(source, 4, 60.0, watermark).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == brute(data, 4, 60.0)


def test_resumable(spark, tmp_path):
    for i in range(2):
        spark.range(3).withColumn("n", F.lit(i)).write.mode("append").json(str(tmp_path / "jobs"))
        source = spark.readStream.schema("id long, n int").json(str(tmp_path / "jobs"))
        resumable(source, lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "done"), str(tmp_path / "check")).awaitTermination()
        assert CommittedLines(str(tmp_path / "done")).read(spark, "id long, n int, done boolean").count() == 3 * (i + 1)


@pytest.mark.parametrize(("most", "watermark"), [(4, None), (1000, "0 seconds")])
def test_idle_keys_are_evicted(spark, tmp_path, most, watermark):
    """Far more keys than the table holds, or a watermark past them: live ones stay in the state, idle ones go, and no decision changes."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(5)
    data = sorted((1e6 + 500 * b + rng.randrange(400), f"k{rng.choice([0, 1, 2, 3 + b * 40 + rng.randrange(40)])}", 100 * b + i) for b in range(3) for i in range(100))
    for b in range(3):
        before = set((tmp_path / "in").glob("*.parquet"))
        spark.createDataFrame([(k, t, e) for t, k, e in data[100 * b : 100 * b + 100]], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for new in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(new, (1_700_000_000 + b, 1_700_000_000 + b))
    source = own.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = rate_limit_evicting(source, 3, 60.0, most, 2, watermark).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    rows = [(k, t, e) for t, k, e in data]
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == brute(rows, 3, 60.0)
    kept = own.read.format("statestore").option("stateVarName", "hits").load(str(tmp_path / "check")).selectExpr("key.bucket AS b", "user_map_key.key AS k").collect()
    by_bucket, newest = {}, {}
    for r in kept:
        by_bucket.setdefault(r.b, set()).add(r.k)
    bucket = {r.key: r.b for r in spark.createDataFrame([(k,) for k in {r[0] for r in rows}], "key string").select("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("b")).collect()}
    for k, t, _ in rows:
        newest[bucket[k]] = max(newest.get(bucket[k], 0), t)
    if watermark:  # which is one for all buckets
        newest = dict.fromkeys(newest, max(newest.values()))
    for k, t, e in rows:
        if t > newest[bucket[k]] - 60.0 and brute(rows, 3, 60.0)[e][0]:
            assert k in by_bucket[bucket[k]]
    assert len(kept) < len(bucket) / 2
