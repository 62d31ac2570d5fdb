"""Stateful operators over keyed event streams: sliding-window limiter, latest answer per key, sessions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def admit(times: list[float], limit: int, window: float, held: deque | None = None) -> tuple[list[bool], deque]:
    """Which events (in order) a limiter admits. Refused events leave no trace, so a count over a range won't do.

    An event counts until it is older than the window; one exactly a window old still does."""
    held = deque() if held is None else held
    out = []
    for t in times:
        while held and held[0] < t - window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def in_order(events: DataFrame, key: str, ts: str, id_col: str, flag: str, decide) -> DataFrame:
    """(key, id, flag) with decide(times, state) -> (flags, state) run over each key's events in order of (time, id).

    Spark sorts, with spill; a key's events pass in Arrow batches and only its state is carried from one to the next,
    so a key of any size takes the memory of a batch.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_col)}
    timed = events.select(key, id_col, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    rows = timed.repartition(key).sortWithinPartitions(F.col(key), F.col("at").asc_nulls_last(), F.col(id_col).asc_nulls_last())

    def run(batches):
        last, state = object(), None
        for batch in batches:
            keys, times, flags, start = [None if pd.isna(k) else k for k in batch[key].tolist()], batch["at"].tolist(), [], 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                decided, state = decide(times[start:end], state if keys[start] == last else None)
                flags += decided
                last, start = keys[start], end
            yield batch[[key, id_col]].assign(**{flag: flags})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, {flag} boolean")


def sliding_limiter(events: DataFrame, key: str, ts: str, id_col: str, limit: int, window: float) -> DataFrame:
    """(key, id, allowed) over a bounded table; a key's state is its last `limit` admitted times."""
    return in_order(events, key, ts, id_col, "allowed", lambda times, held: admit(times, limit, window, held))


class _Admission(StatefulProcessor):
    """Decides a key's events in order of time. They are put into state by bucket of time and the part of a batch that
    they came in, and leave it bucket after bucket, so that only a bucket's events are in memory: with wait once the
    watermark has passed the bucket, else at the end of their micro-batch."""

    def __init__(self, id_col: str, id_kind: str, limit: int, window: float, bucket: float, wait: bool):
        self.id_col, self.id_kind, self.limit, self.window, self.bucket, self.wait = id_col, id_kind, limit, window, bucket, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>")
        self.parts = handle.getMapState("parts", "bucket bigint", "n int")
        self.waiting = handle.getMapState("waiting", "bucket bigint, part int", f"times array<double>, ids array<{self.id_kind}>")

    def decided(self, key, bucket: int):
        events = []
        for part in range(self.parts.getValue((bucket,))[0]):
            events += zip(*self.waiting.getValue((bucket, part)), strict=True)
            self.waiting.removeKey((bucket, part))
        self.parts.removeKey((bucket,))
        events.sort()
        held = deque(self.held.get()[0]) if self.held.exists() else deque()
        allowed, held = admit([at for at, _ in events], self.limit, self.window, held)
        self.held.update((list(held),))
        self.handle.registerTimer(int((max(held, default=0.0) + self.window) * 1000) + 1)
        return pd.DataFrame({"key": key[0], self.id_col: [i for _, i in events], "allowed": allowed})

    def handleInputRows(self, key, rows, timerValues):
        touched = set()
        for frame in rows:
            for bucket, part in frame.groupby((frame["at"] // self.bucket).astype("int64")):
                bucket = int(bucket)
                n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
                if not n and self.wait:
                    self.handle.registerTimer(int((bucket + 1) * self.bucket * 1000))
                self.waiting.updateValue((bucket, n), (part["at"].tolist(), part[self.id_col].tolist()))
                self.parts.updateValue((bucket,), (n + 1,))
                touched.add(bucket)
        for bucket in () if self.wait else sorted(touched):
            yield self.decided(key, bucket)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        for bucket in sorted(b for (b,) in self.parts.keys() if (b + 1) * self.bucket <= passed):
            yield self.decided(key, bucket)
        if self.held.exists() and max(self.held.get()[0], default=0.0) + self.window < passed:
            self.held.clear()

    def close(self) -> None:
        pass


def limiter_stream(
    events: DataFrame, key: str, ts: str, id_col: str, limit: int, window: float, delay: str = "10 minutes", bucket: float = 1.0, wait: bool = False
) -> DataFrame:
    """(key, id, allowed) over a stream. Events may come up to `delay` late; later ones are left out.

    Events of one micro-batch are decided in order of time, at its end. With wait an event is decided when the watermark
    has passed its bucket of `bucket` seconds, so that the answer is sliding_limiter()'s however events arrive, and the
    last ones wait for later events. State is a key's admitted times within the window, dropped once the watermark has
    passed them by a window, and its undecided events. The state store must be RocksDB, which is set on the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_col)}
    timed = events.select(key, id_col, F.col(ts).cast("timestamp").alias("time")).withWatermark("time", delay)
    timed = timed.withColumn("at", F.unix_micros("time") / 1e6)
    admission = _Admission(id_col, kinds[id_col], limit, window, bucket, wait)
    found = timed.groupBy(key).transformWithStateInPandas(admission, f"key {kinds[key]}, {id_col} {kinds[id_col]}, allowed boolean", "append", "eventTime")
    return found.withColumnRenamed("key", key)


def cache_key(*parts: Column) -> Column:
    """Thirty-two digits over the parts of a cached answer's identity, questions in lower case and single blanks."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def latest(writes: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest write of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return writes.withColumn("__n", place).where("__n = 1").drop("__n")


def last_n(events: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return events.withColumn("place", place).where(F.col("place") <= n)


def within_ttl(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """events with hit: whether a value read less than `seconds` after the key's last refill is served from memory.

    A refill happens at a miss, so hits are decided per key in order.
    """

    def decide(times, filled):
        hits = []
        for t in times:
            hits.append(filled is not None and t - filled < seconds)
            filled = filled if hits[-1] else t
        return hits, filled

    return in_order(events, key, ts, tie, "hit", decide)
