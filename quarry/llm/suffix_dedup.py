"""Exact removal of repeated byte strings, by a logarithmic family of sparse suffix arrays.

A text's suffixes are sampled at anchors: the leftmost k-mer of least hash in each window of `length` bytes. Equal
windows have equal anchors at equal distances, so repeated strings meet where suffixes begin with the same k-mer.

1.  Every text gives its anchors: the k-mer's hash, the run of windows that share the anchor, and a hash of the bytes
    that the run covers (its context). k-mers that occur once are settled.
2.  Contexts that occur twice are repeated as a whole. Where a k-mer has several contexts, one text of each distinct
    context goes to the shard of its k-mer.
3.  A k-mer with more than SHARD distinct contexts is sorted in several shards: its contexts are cut by their windows'
    distance to the anchor, and each part is dealt by all the bytes that the windows of its distances have in common,
    a longer prefix than the k-mer. Parts that are still large are cut again, until a part is one distance and its
    bytes are one window.
4.  In a shard, contexts come in batches. A batch gets a suffix array (its suffixes from the anchors on, sorted),
    which is merge-scanned with the suffixes of its k-mers in every existing level; levels of equal size merge, so
    that a context is merged logarithmically often. In a scan, common prefixes of neighbours and hashes of the bytes
    before the anchors, then these bytes, tell which windows occur twice.
5.  The repeated windows join the occurrences of their contexts, and each distinct text loses the bytes that they
    cover. What a text has lost joins its copies as a few numbers.

SuffixIndex keeps anchors and texts of earlier batches of documents as levels in tables, which merge by size too.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from quarry.llm.common import table, written
from quarry.llm.hashing import Prefixes, mix

LENGTH, KMER = 200, 32
#: Contexts of a batch, and batches after which a family is given up at the next k-mer.
BATCH, BATCHES = 1024, 4
#: Distinct contexts of a k-mer that are sorted in one shard, and parts into which the distances of more are cut.
SHARD, PARTS = 1024, 4
SLICE = 1 << 21


def sampled(data: np.ndarray, sums: Prefixes, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, kmer: int = KMER):
    """Anchors of texts that lie side by side in data: (first window, windows, anchor, k-mer hash) arrays.

    begin and end delimit the texts; windows never cross them. Every window belongs to exactly one anchor.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return empty
    at = np.arange(len(data) - kmer + 1)
    code = sums.spans(at, at + kmer)
    width = length - kmer + 1
    least, reach = code, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(code) - width + 1], least[width - reach :])
    inside = np.zeros(len(data) + 1, np.int32)
    long_ = end - begin >= length
    inside[begin[long_]] = 1
    inside[end[long_] - length + 1] -= 1
    valid = np.cumsum(inside)[: len(least)] > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    change[begin[long_]] = True
    edge = np.append(np.flatnonzero(change), len(least))
    first, last = edge[:-1][valid[edge[:-1]]], edge[1:][valid[edge[:-1]]] - 1
    if not len(first):
        return empty
    anchor = np.empty(len(first), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(code, width)
    for i in range(0, len(first), 4096):
        part = slice(i, i + 4096)
        anchor[part] = first[part] + (view[first[part]] == least[first[part], None]).argmax(1)
    # The least k-mer may come again within a run of windows: then the windows behind it belong to the next one.
    again = np.flatnonzero(anchor < last)
    if len(again):
        keep = np.ones(len(first), bool)
        keep[again] = False
        rows = [(first[keep], last[keep], anchor[keep])]
        for r in again:
            a, b = first[r], last[r]
            where = a + np.flatnonzero(code[a : b + width] == least[a])
            start = np.concatenate([[a], where[:-1] + 1])
            some = start <= b
            rows.append((start[some], np.minimum(where[some], b), where[some]))
        first, last, anchor = (np.concatenate(x) for x in zip(*rows))
    return first, last - first + 1, anchor, code[anchor]


def context_hash(sums: Prefixes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """64 bits of a context: its bytes, its number of windows and where its anchor lies."""
    h = sums.spans(first, first + count - 1 + length)
    return mix(h + (count << 20 | anchor - first).astype(np.uint64)).astype(np.int64)


def anchored(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, kmer: int = KMER):
    """sampled() with the context's hash: (first window, windows, anchor, k-mer hash, context hash).

    More than SLICE bytes, which are one text then, are read in parts that overlap by a window less a byte. A run of
    windows ends at a part's border; the index finds what its halves share with other contexts.
    """
    if len(data) <= SLICE:
        parts = [(0, data, begin, end)]
    else:
        parts = []
        for c in range(0, max(1, len(data) - length + 1), SLICE):
            part = data[c : c + SLICE + length - 1]
            parts.append((c, part, np.array([0]), np.array([len(part)])))
    found = []
    for c, part, b, e in parts:
        sums = Prefixes(part)
        first, count, anchor, code = sampled(part, sums, b, e, length, kmer)
        found.append((first + c, count, anchor + c, code, context_hash(sums, first, count, anchor, length)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _slices(batch, text_at: int):
    """Parts of a batch with about SLICE bytes of text each: (rows, joined bytes, begins, ends)."""
    column = batch.column(text_at)
    start, held, raw = 0, 0, []
    for i in range(batch.num_rows + 1):
        data = column[i].as_py() or b"" if i < batch.num_rows else b""
        if raw and (i == batch.num_rows or held + len(data) > SLICE):
            size = np.array(list(map(len, raw)))
            end = np.cumsum(size)
            yield batch.slice(start, i - start), np.frombuffer(b"".join(raw), np.uint8), end - size, end
            start, held, raw = i, 0, []
        raw.append(data)
        held += len(data)


def _anchors(texts: DataFrame, length: int, kmer: int) -> DataFrame:
    """(kh, ch, t1, t2, i0, n) of every anchor of texts (t1, t2, raw)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, begin, end in _slices(batch, 2):
                first, count, _, code, ch = anchored(data, begin, end, length, kmer)
                owner = np.searchsorted(end, first, "right")
                t1, t2 = (np.asarray(part.column(i))[owner] for i in (0, 1))
                columns = (code.astype(np.int64), ch, t1, t2, (first - begin[owner]).astype(np.int32), count.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kh", "ch", "t1", "t2", "i0", "n"])

    return texts.mapInArrow(run, "kh long, ch long, t1 long, t2 int, i0 int, n int")


class Level:
    """A sparse suffix array: contexts sorted by k-mer and then by their bytes from the anchor on."""

    def __init__(self, rows: list[tuple[bytes, bytes, int, int, int]]):
        self.rows = rows  # (k-mer and bytes from the anchor, bytes before it, entry, least and most distance)

    @classmethod
    def of(cls, rows) -> Level:
        return cls(sorted(rows))

    def merged(self, other: Level) -> Level:
        return Level(sorted(self.rows + other.rows))  # two sorted runs: the sort merges them

    def like(self, other: Level) -> Level:
        """The suffixes that begin with a k-mer of the other level."""
        heads = {r[0][:8] for r in other.rows}
        low, high = bisect_left(self.rows, (min(heads),)), bisect_left(self.rows, (max(heads) + b"\xff" * 400,))
        return Level([r for r in self.rows[low:high] if r[0][:8] in heads])

    def __len__(self) -> int:
        return len(self.rows)


class Family:
    """The levels of one shard, and which windows of its contexts have been found twice."""

    def __init__(self, length: int = LENGTH, kmer: int = KMER):
        self.length, self.span = length, length - kmer
        self.levels: dict[int, Level] = {}
        self.twice = np.zeros((0, self.span + 1), bool)  # by entry and distance from window start to anchor

    def add(self, rows: list[tuple[bytes, bytes, int, int, int]]) -> None:
        """Index a batch of new entries: scan it, scan it against each level's suffixes of the same k-mers, and merge
        levels of equal size."""
        most = max(r[2] for r in rows) + 1
        if most > len(self.twice):
            more = np.zeros((max(most, 2 * len(self.twice)) - len(self.twice), self.span + 1), bool)
            self.twice = np.concatenate([self.twice, more])
        new = Level.of(rows)
        self.scan(new)
        for level in self.levels.values():
            near = level.like(new)
            if near:
                self.scan(new.merged(near))
        height = 0
        while height in self.levels:
            new = new.merged(self.levels.pop(height))
            height += 1
        self.levels[height] = new

    def scan(self, level: Level) -> None:
        """Mark the windows that two entries of a level share."""
        rows = level.rows
        if len(rows) < 2:
            return
        size = self.length + 8
        suffix = np.frombuffer(b"".join(r[0][:size].ljust(size, b"\0") for r in rows), np.uint8).reshape(-1, size)
        reach = np.minimum(np.array([len(r[0]) for r in rows]), size)
        prior = np.frombuffer(b"".join(r[1].rjust(self.span, b"\0") for r in rows), np.uint8).reshape(-1, self.span)
        entry, least, most = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
        same = suffix[1:] == suffix[:-1]
        common = np.where(same.all(1), size, same.argmin(1))
        common = np.minimum(common, np.minimum(reach[1:], reach[:-1])) - 8  # under 0: another k-mer
        code = np.zeros(len(rows), np.uint64)
        group = np.zeros(len(rows), np.int64)
        for a in range(self.span + 1):
            if a:
                code = mix(code + prior[:, self.span - a].astype(np.uint64) + np.uint64(1))
            use = np.flatnonzero((least <= a) & (a <= most))
            if len(use) < 2:
                continue
            group[1:] = np.cumsum(common < self.length - a)
            key = mix(code[use] + group[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            key, use = key[order], use[order]
            pair = np.flatnonzero(key[1:] == key[:-1])
            if len(pair):
                x, y = use[pair], use[pair + 1]
                sure = (group[x] == group[y]) & (prior[x, self.span - a :] == prior[y, self.span - a :]).all(1)
                self.twice[entry[x[sure]], a] = self.twice[entry[y[sure]], a] = True


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


def _shards(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """(kh, ch, s, e): the runs of repeated windows of each context (kh, ch, n, a, ctx), shard by shard.

    A task reads its contexts sorted by k-mer and gives up its family between two k-mers, so that it holds
    BATCHES * BATCH + SHARD contexts at most.
    """

    def run(batches):
        import pyarrow as pa

        family, entries, rows = Family(length, kmer), [], []

        def found():
            if rows:
                family.add(rows)
            out = []
            for (kh, ch, n, a), flags in zip(entries, family.twice):
                out += [(kh, ch, s, e) for s, e in _ranges(flags[a - n + 1 : a + 1][::-1])]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["kh", "ch", "s", "e"])

        for batch in batches:
            for kh, ch, n, a, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                if len(entries) >= BATCHES * BATCH and kh != entries[-1][0]:
                    yield found()
                    family, entries, rows = Family(length, kmer), [], []
                head = (kh + (1 << 63)).to_bytes(8, "big")
                rows.append((head + ctx[a:], ctx[:a], len(entries), a - n + 1, a))
                entries.append((kh, ch, n, a))
                if len(rows) >= BATCH:
                    family.add(rows)
                    rows = []
        yield found()

    dealt = contexts.select("kh", "ch", "n", "a", "ctx").repartition("kh").sortWithinPartitions("kh")
    return dealt.mapInArrow(run, "kh long, ch long, s int, e int")


def _parts(contexts: DataFrame, length: int) -> DataFrame:
    """(pkh, pch, o, kh, ch, lo, hi, n, a, ctx): the contexts (kh, ch, lo, hi, n, a, ctx), whose windows have distances
    lo to hi - 1, cut into PARTS by distance. o is the place of the part's first window; kh is a hash of the bytes
    that all windows of the part's distances share."""

    def code(data: bytes, *numbers: int) -> int:
        salt = b"".join((x % 2**64).to_bytes(8, "little") for x in numbers)
        return int.from_bytes(hashlib.blake2b(salt + data, digest_size=8).digest(), "little", signed=True)

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        names = ["pkh", "pch", "o", "kh", "ch", "lo", "hi", "n", "a", "ctx"]
        for batch in batches:
            out = []
            for kh, ch, lo, hi, n, a, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                edges = sorted({lo + (hi - lo) * i // PARTS for i in range(PARTS + 1)})
                for low, high in zip(edges, edges[1:]):
                    least, most = max(a - n + 1, low), min(a, high - 1)
                    if least <= most:
                        o, count = a - most, most - least + 1
                        part = ctx[o : o + count - 1 + length]
                        common = ctx[a - low : a + length - high + 1]
                        out.append((kh, ch, o, code(common, kh, low, high), code(part, count, most), low, high, count, most, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    schema = "pkh long, pch long, o int, kh long, ch long, lo int, hi int, n int, a int, ctx binary"
    return contexts.select("kh", "ch", "lo", "hi", "n", "a", "ctx").mapInArrow(run, schema)


def _sized(contexts: DataFrame) -> DataFrame:
    """contexts with m, how many distinct ones their k-mer (or longer prefix) has."""
    m = contexts.groupBy("kh").agg(F.count("*").alias("m")).select(F.struct("kh").alias("key"), "m")
    return contexts.withColumn("key", F.struct("kh")).join(m, "key").drop("key")


def _repeated(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """(kh, ch, s, e): runs of windows of distinct contexts (kh, ch, lo, hi, n, a, ctx, m) that another one holds too."""
    found = _shards(contexts.where(F.col("m").between(2, SHARD)), length, kmer)
    large = contexts.where(F.col("m") > SHARD)
    if not large.limit(1).count():
        return found
    parts = written(_parts(large, length), "parts")
    row = F.struct("lo", "hi", "n", "a", "ctx")
    apart = parts.groupBy("kh", "ch").agg(F.count("*").alias("c"), F.first(row).alias("r")).select("kh", "ch", "c", "r.*")
    apart = written(_sized(apart), "parts")
    whole = apart.where("c > 1").select("kh", "ch", F.lit(0).alias("s"), (F.col("n") - 1).alias("e"))
    runs = _repeated(apart, length, kmer).unionByName(whole)
    held = parts.select("pkh", "pch", "o", F.struct("kh", "ch").alias("key"))
    up = held.join(runs.select(F.struct("kh", "ch").alias("key"), "s", "e"), "key")
    up = up.select(F.col("pkh").alias("kh"), F.col("pch").alias("ch"), (F.col("s") + F.col("o")).alias("s"), (F.col("e") + F.col("o")).alias("e"))
    return found.unionByName(written(up, "part-runs"))


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, kmer: int) -> DataFrame:
    """(kh, ch, lo, hi, n, a, ctx): the bytes of wanted contexts, from one text of each key (t1, t2)."""
    asked = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("i0", "kh", "ch")).alias("asked"))
    joined = texts.dropDuplicates(["t1", "t2"]).join(asked, ["t1", "t2"]).select("asked", "raw")

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part, data, begin, end in _slices(batch, 1):
                first, count, anchor, _, _ = anchored(data, begin, end, length, kmer)
                at = dict(zip(first.tolist(), range(len(first))))
                out = []
                for base, asked_ in zip(begin.tolist(), part.column(0).to_pylist()):
                    for x in asked_:
                        i = at[base + x["i0"]]
                        f, n = int(first[i]), int(count[i])
                        out.append((x["kh"], x["ch"], 0, length - kmer + 1, n, int(anchor[i]) - f, data[f : f + n - 1 + length].tobytes()))
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["kh", "ch", "lo", "hi", "n", "a", "ctx"])

    return joined.mapInArrow(run, "kh long, ch long, lo int, hi int, n int, a int, ctx binary")


def repeated_windows(anchors: DataFrame, texts: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """(t1, t2, s, e): for each text key, runs of starts (first, last) of windows that also start elsewhere.

    texts has t1, t2 (the key: equal for equal texts) and raw (binary) of the texts that anchors (from _anchors) come
    from; rows that repeat a key are further texts.
    """
    kinds = anchors.groupBy("kh").agg(F.count("*").alias("c"), F.min("ch").alias("low"), F.max("ch").alias("high")).where("c > 1")
    shared = written(
        anchors.withColumn("key", F.struct("kh"))
        .join(kinds.select(F.struct("kh").alias("key"), (F.col("low") == F.col("high")).alias("one")), "key").drop("key"),
        "anchors",
    )
    kept = written(
        shared.where("not one").groupBy("kh", "ch").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "i0")).alias("at")),
        "contexts",
    )
    wanted = kept.select("kh", "ch", "at.t1", "at.t2", "at.i0")
    bytes_ = written(_sized(_contexts(texts, wanted, length, kmer)), "context-bytes")
    partial = _repeated(bytes_, length, kmer).groupBy("kh", "ch").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    known = kept.select("kh", "ch", (F.col("c") > 1).alias("all")).join(partial, ["kh", "ch"], "left")
    mixed = (
        shared.where("not one").withColumn("key", F.struct("kh", "ch"))
        .join(known.select(F.struct("kh", "ch").alias("key"), "all", "runs"), "key")
        .withColumn("whole", F.array(F.struct(F.lit(0).alias("s"), (F.col("n") - 1).alias("e"))))
        .select("t1", "t2", "i0", F.explode(F.when(F.col("all"), F.col("whole")).otherwise(F.col("runs"))).alias("r"))
        .select("t1", "t2", (F.col("i0") + F.col("r.s")).alias("s"), (F.col("i0") + F.col("r.e")).alias("e"))
    )
    return shared.where("one").select("t1", "t2", F.col("i0").alias("s"), (F.col("i0") + F.col("n") - 1).alias("e")).unionByName(mixed)


def removed_mask(size: int, runs: list[tuple[int, int]], length: int) -> np.ndarray:
    """Bytes that the windows of the runs cover."""
    step = np.zeros(size + 1, np.int32)
    for s, e in runs:
        step[s] += 1
        step[e + length] -= 1
    return np.cumsum(step)[:size] > 0


def _keyed(docs: DataFrame, text_col: str) -> tuple[Column, Column, Column]:
    """t1, t2 and raw of a text (null as empty)."""
    text = F.coalesce(text_col, F.lit(""))
    return F.xxhash64(text).alias("t1"), F.octet_length(text).alias("t2"), text.cast("binary").alias("raw")


def _without(docs: DataFrame, runs: DataFrame, keep: list[str], text_col: str, length: int, with_text: bool) -> DataFrame:
    """docs without the windows of runs (t1, t2, s, e). Each distinct text is cut once; its rows meet the result."""
    fields = [StructField("kept", BinaryType())] * with_text + [
        StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
        StructField("kept_sha256", StringType()),
    ]
    keep = [c for c in keep if c not in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    t1, t2, raw = _keyed(docs, text_col)
    lost = runs.groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    joined = docs.select(t1, t2, raw).dropDuplicates(["t1", "t2"]).join(lost, ["t1", "t2"], "left").select("t1", "t2", "raw", "runs")
    schema = StructType([StructField("t1", LongType()), StructField("t2", IntegerType()), *fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for raw, found in zip(batch.column(2), batch.column(3)):
                raw = raw.as_py()
                runs_ = [(x["s"], x["e"]) for x in found.as_py() or ()]
                gone = removed_mask(len(raw), runs_, length)
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if runs_ else raw
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
                rows.append((left, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)][0 if with_text else 1 :]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [f.name for f in schema])

    cut = joined.mapInArrow(run, schema).select(F.struct("t1", "t2").alias("__key"), *[F.col(f.name).alias(f"__{f.name}") for f in fields])
    # Joined by a struct, so that both sides are dealt anew and Spark may split the rows of a text with many copies.
    own = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], t1, t2).withColumn("__key", F.struct("t1", "t2"))
    out = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)] + [F.col(f"__{f.name}").alias(f.name) for f in fields]
    return own.join(cut, "__key").select(*out)


def suffix_dedup(docs: DataFrame, keep: list[str], text_col: str = "text", length: int = LENGTH, kmer: int = KMER, with_text: bool = True) -> DataFrame:
    """The columns `keep` of docs with kept (binary, the remaining bytes, if with_text), n_bytes, n_removed, n_spans
    (long) and kept_sha256: every byte goes that a string of `length` bytes covers which also starts anywhere else.

    Whole texts are read as UTF-8, a very long one in overlapping parts. Defined cases: a null text is empty; texts
    under `length` bytes lose nothing; repeated rows count as occurrences, so long repeated texts vanish wholly;
    overlapping occurrences within a text count. Columns outside keep aren't read; the names above are replaced. Texts
    are told apart by a 64-bit hash with their length, k-mers and contexts by 64 bits each (a context within its
    k-mer); wholly equal contexts are settled by these hashes, others by their bytes. An empty table gives an empty
    result.
    """
    t1, t2, raw = _keyed(docs, text_col)
    texts = docs.select(t1, t2, raw).where(F.col("t2") >= length)
    runs = repeated_windows(_anchors(texts, length, kmer), texts, length, kmer)
    return _without(docs, runs, keep, text_col, length, with_text)


class SuffixIndex:
    """An index that outlives a batch of documents: levels of anchors and texts in tables under a shared folder.

    dedup() takes a batch, cuts what it shares with itself or with any level, and adds it as a level; the two smallest
    levels merge as long as the larger one is under twice the other, so a text is rewritten logarithmically often.
    Which levels are valid is an appended table; the newest version counts, and an interrupted call leaves the last.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, kmer: int = KMER):
        self.spark, self.folder, self.length, self.kmer = spark, folder.rstrip("/"), length, kmer
        self.version, self.levels = 0, []
        try:
            state = spark.read.schema("version long, rows long, path string").parquet(f"{self.folder}/state")
            newest = state.agg(F.max("version")).first()[0]
        except AnalysisException:  # a new index
            newest = None
        if newest is not None:
            self.version = newest
            self.levels = sorted((r["rows"], r["path"]) for r in state.where(F.col("version") == newest).collect())

    def _read(self, path: str, what: str) -> DataFrame:
        kinds = {"anchors": "kh long, ch long, t1 long, t2 int, i0 int, n int", "texts": "t1 long, t2 int, raw binary"}
        return self.spark.read.schema(kinds[what]).parquet(f"{path}/{what}")

    def _write(self, anchors: DataFrame, texts: DataFrame) -> tuple[int, str]:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        texts.write.parquet(f"{path}/texts")
        anchors.write.parquet(f"{path}/anchors")
        return self._read(path, "anchors").count(), path

    def dedup(self, docs: DataFrame, keep: list[str], text_col: str = "text", with_text: bool = True) -> DataFrame:
        """suffix_dedup() of a batch, where strings of earlier batches count as occurrences too."""
        t1, t2, raw = _keyed(docs, text_col)
        fresh = docs.select(t1, t2, raw).where(F.col("t2") >= self.length)
        new = self._write(_anchors(fresh, self.length, self.kmer), fresh)
        mine, texts = self._read(new[1], "anchors"), self._read(new[1], "texts")
        kmers, anchors = mine.select("kh").distinct(), mine
        for _, path in self.levels:
            old = self._read(path, "anchors").join(kmers, "kh", "left_semi")
            anchors, texts = anchors.unionByName(old), texts.unionByName(self._read(path, "texts"))
        runs = repeated_windows(anchors, texts, self.length, self.kmer)
        runs = written(runs.join(fresh.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi"), "runs")
        out = _without(docs, runs, keep, text_col, self.length, with_text)
        self.levels = sorted([*self.levels, new])
        while len(self.levels) > 1 and self.levels[1][0] < 2 * max(1, self.levels[0][0]):
            (_, a), (_, b), *rest = self.levels
            both = [self._read(a, x).unionByName(self._read(b, x)) for x in ("anchors", "texts")]
            self.levels = sorted([*rest, self._write(*both)])
        self.version += 1
        rows = [(self.version, n, path) for n, path in self.levels]
        self.spark.createDataFrame(rows, "version long, rows long, path string").coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)
