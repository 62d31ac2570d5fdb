"""Incremental ingest and the streamed limiter: restarts, repeats, late rows and hot keys."""

import hashlib
import os
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.streaming import ingest, limits


def put(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_each_content_once_over_runs(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.mkdir(folder)
    for i in range(7):
        put(folder, f"{i}.txt", f"text {i % 5}")
    run = lambda: ingest.ingested(ingest.files(spark, folder, "*.txt", 2).drop("content"), out, state)
    assert Counter(r.sha256 for r in run().collect()) == Counter({sha(f"text {i}"): 1 for i in range(5)})
    before = sorted(os.listdir(out))
    assert run().count() == 5
    assert [f for f in sorted(os.listdir(out)) if f.endswith(".parquet") and f not in before] == []  # nothing was processed
    put(folder, "again.txt", "text 3")
    put(folder, "new.txt", "text 9")
    put(folder, "other.md", "text 10")
    assert Counter(r.sha256 for r in run().collect()) == Counter({sha(f"text {i}"): 1 for i in (0, 1, 2, 3, 4, 9)})


def test_a_failed_run_neither_loses_nor_repeats(spark, tmp_path):
    folder, out, state, poison = (str(tmp_path / x) for x in ("in", "out", "state", "poison"))
    os.mkdir(folder)
    for i in range(9):
        put(folder, f"{i}.txt", f"text {i % 8}")
    put(str(tmp_path), "poison", "on")

    @F.udf(StringType())
    def fragile(content):
        if os.path.exists(poison) and bytes(content) == b"text 5":
            raise ValueError("a bad file")
        return bytes(content).decode()

    run = lambda: ingest.ingested(ingest.files(spark, folder, "*.txt", 1).select("sha256", fragile("content").alias("text")), out, state)
    with pytest.raises(Exception, match="a bad file"):
        run()
    os.remove(poison)
    assert Counter(r.text for r in run().collect()) == Counter(f"text {i}" for i in range(8))
    assert run().count() == 8


def decided(events, limit, window):
    held, out = {}, {}
    for k, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        d = held.setdefault(k, deque())
        while d and d[0] < t - window:
            d.popleft()
        out[i] = len(d) < limit
        if out[i]:
            d.append(t)
    return out


def test_limiter_stream_in_event_time(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.choice([1, 1, 1, 2, 3]), i, 1000.0 + rng.randrange(0, 400)) for i in range(600)]
    # Three batches by time, out of order by up to 20 seconds; then rows far too late; then one that closes all buckets.
    came = [min(2, int((e[2] - 1000 + rng.uniform(0, 20)) // 140)) for e in events]
    batches = [[e for e, at in zip(events, came, strict=True) if at == n] for n in range(3)]
    late = [(1, 9000 + i, 1005.0) for i in range(4)]
    batches += [late, [(7, 9999, 9000.0)], [(7, 9998, 9000.0)]]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "k int, id int, s double").selectExpr("k", "id", "timestamp_seconds(s) AS ts")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(max((os.path.join(tmp_path, "in", f) for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")), key=os.path.getmtime), (1000 + n, 1000 + n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema("k int, id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        limited = limits.limiter_stream(stream, "k", "ts", "id", 3, 10.0, "30 seconds", wait=True)
        query = limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert dict(got) == decided(events, 3, 10.0) and len(got) == len(events)
