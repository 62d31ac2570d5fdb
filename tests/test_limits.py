"""Keyed state over skewed events: one key's events come in many batches, none of them gathered in one frame."""

from collections import deque

from quarry.streaming import limits


def test_a_hot_key_passes_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = [(1 if i % 3 else i % 5, 300 - i, float((i * 37) % 211)) for i in range(300)] + [(None, 900 + i, float(i)) for i in range(20)]
        frame = spark.createDataFrame(events, "k int, id int, s double").selectExpr("k", "id", "timestamp_seconds(s) AS ts")
        limited = {r.id: r.allowed for r in limits.sliding_limiter(frame, "k", "ts", "id", 3, 10.0).collect()}
        cached = {r.id: r.hit for r in limits.within_ttl(frame, "k", "ts", "id", 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, filled, allowed, hit = {}, {}, {}, {}
    for k, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        d = held.setdefault(k, deque())
        while d and d[0] < t - 10:
            d.popleft()
        allowed[i] = len(d) < 3
        if allowed[i]:
            d.append(t)
        hit[i] = k in filled and t - filled[k] < 10
        if not hit[i]:
            filled[k] = t
    assert (limited, cached) == (allowed, hit)


def test_no_key_is_gathered(spark):
    frame = spark.createDataFrame([(1, 1, 1.0)], "k int, id int, s double").selectExpr("k", "id", "timestamp_seconds(s) AS ts")
    for out in (limits.sliding_limiter(frame, "k", "ts", "id", 3, 10.0), limits.within_ttl(frame, "k", "ts", "id", 10)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan
