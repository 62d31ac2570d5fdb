"""Near-duplicate classes by DartMinHash.

Signatures. A text is a weighted set: its five-word shingles with their counts. The plane of weight and rank over a
shingle is cut into regions, strips of the weight axis that double in width. A hash throws the darts of a Poisson
process into each region, the same for every text that has the shingle; a dart counts for the texts whose weight it
doesn't exceed. Darts under the text's rank limit are kept, hashed to one of BANDS * ROWS coordinates, and each
coordinate keeps its earliest dart. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. Equal bands make candidates.

Links. Copies collapse once they are signed, by a hash of the text. Pairs within a band's bucket are never emitted: each bucket
links to its hub, the member with the most bucket mates, and these few pairs are verified exactly, text against text.
Buckets whose members are in one class by then are done. In the others, members of different classes are compared in
blocks of about BLOCK rows inside tasks: first without texts, by an upper bound of their similarity that shingle counts
by bin give; then the texts of members that have a partner left meet and are verified. Only links that join classes
leave the task. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from quarry.llm.common import map_texts, sliced, table, written
from quarry.llm.components import components
from quarry.llm.hashing import cells_of, mix, shingle_codes, shingles, weights_of

SIMILARITY, WIDTH = 0.8, 5
#: A pair at the similarity misses all bands with probability (1 - 0.8 ** 6) ** 36 = 2e-5.
BANDS, ROWS = 36, 6
#: Bins of shingle counts, which bound a pair's similarity; a text of more shingles than MOST has no bins and no bound.
BINS, MOST = 256, 65_535
#: Rows of a block, and pairs of a hub that one group verifies.
BLOCK, PAIRS = 1024, 512
_GOLD, _STRIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def throw(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The earliest dart (64 bits) in each of k coordinates for each weighted set, of elements (owner, code, weight > 0)."""
    total = np.bincount(owner, weight, minlength=texts)
    darts = np.zeros((texts, k), np.uint64)
    todo = np.flatnonzero(total > 0)
    limit = np.where(total > 0, k * (np.log(k) + 4) / np.where(total > 0, total, 1), 0)
    # Regions: [0, 1), [1, 2), [2, 4), [4, 8) and so on of the weight axis, as far as the weight goes.
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(int)
    at = np.repeat(np.arange(len(code)), regions)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(nth > 0, 2.0 ** np.maximum(nth - 1, 0), 0.0)
    size = np.maximum(low, 1.0)
    owners, own = owner[at], weight[at]
    codes = np.where(nth > 0, mix(code[at] + nth.astype(np.uint64) * _STRIDE), code[at])
    while len(todo):
        place = np.full(texts, -1)
        place[todo] = np.arange(len(todo))
        mine = np.flatnonzero(place[owners] >= 0)
        row, h0, most, low_, size_, own_ = place[owners[mine]], codes[mine], limit[owners[mine]], low[mine], size[mine], own[mine]
        rank = np.zeros(len(row))
        best = np.full(len(todo) * k, np.inf)
        thrown = []
        turn = 0
        while len(row):
            turn += 1
            h = mix(h0 + np.uint64(turn * int(_GOLD) % 2**64))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / size_
            inside = rank < most
            row, h0, most, low_, size_, own_, rank, h = (x[inside] for x in (row, h0, most, low_, size_, own_, rank, h))
            h = mix(h + _GOLD)
            hit = np.ones(len(h), bool)
            part = np.flatnonzero(low_ + size_ > own_)
            height = low_[part] + size_[part] * (mix(h[part] + _STRIDE) >> np.uint64(11)).astype(float) * 2.0**-53
            hit[part] = height < own_[part]
            to, by, dart = row[hit] * k + (h[hit] % np.uint64(k)).astype(np.int64), rank[hit], h[hit]
            np.minimum.at(best, to, by)
            thrown.append((to, by, dart))
        out = np.zeros(len(todo) * k, np.uint64)
        for to, by, dart in thrown:
            first = by == best[to]
            out[to[first]] = dart[first]
        darts[todo] = out.reshape(len(todo), k)
        empty = np.isinf(best.reshape(len(todo), k)).any(1)
        todo = todo[empty]  # a coordinate without a dart: throw further
        limit[todo] *= 2
    return darts


def dart_signatures(texts: list[str], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(some, darts): which texts have a shingle, and their earliest darts."""
    return _signatures(*shingle_codes(texts, width), len(texts), bands * rows)


def _signatures(owner: np.ndarray, code: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(owner, minlength=texts) > 0, throw(*weights_of(owner, code), texts, k)


def bin_counts(texts: list[str], width: int = WIDTH) -> list[bytes | None]:
    """How many shingles of each text fall in each bin, as 16-bit numbers; None for a text of more than MOST."""
    return _bins(*shingle_codes(texts, width), len(texts))


def _bins(owner: np.ndarray, code: np.ndarray, texts: int) -> list[bytes | None]:
    owner, cell = cells_of(owner, code)
    at = owner * BINS + (cell % np.uint64(BINS)).astype(np.int64)
    counts = np.bincount(at, minlength=texts * BINS).reshape(texts, BINS)
    return [None if n > MOST else c.astype(np.uint16).tobytes() for c, n in zip(counts, counts.sum(1))]


def _signed(docs: DataFrame) -> DataFrame:
    def run(texts):
        shingled = shingle_codes(texts, WIDTH)
        some, darts = _signatures(*shingled, len(texts), BANDS * ROWS)
        code = np.zeros((len(texts), BANDS), np.uint64)
        for i in range(ROWS):
            code = mix(code * _GOLD + darts[:, i::ROWS])
        code = mix(code + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
        return {"bands": [c if s else [] for c, s in zip(code, some)], "bins": _bins(*shingled, len(texts))}

    fields = [StructField("bands", ArrayType(LongType())), StructField("bins", BinaryType())]
    return map_texts(docs, ["k"], "text", fields, run, rows=384, most=1 << 20)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts (k, text) whose weighted Jaccard similarity of shingles reaches `similarity`.

    Pairs are grouped by b, a frequent b over as many groups as it has PAIRS pairs, so that each group holds one text b
    and meets the texts a one after another.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("groups")).where("groups > 1")
    dealt = pairs.withColumn("key", F.struct("b")).join(groups.select(F.struct("b").alias("key"), "groups"), "key", "left")
    salted = dealt.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("groups", F.lit(1))).cast("int").alias("salt"))
    left = salted.join(texts.withColumnRenamed("k", "a"), "a").select("b", "salt", "a", "text")
    right = (
        salted.select("b", "salt").distinct().join(texts.withColumnRenamed("k", "b"), "b")
        .select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    )

    def run(batches):
        import pyarrow as pa

        key = target = None
        for batch in batches:
            for part, found in sliced(batch, 3, 256, 1 << 21):
                owner, cell = shingles(found, WIDTH)
                edge = np.searchsorted(owner, np.arange(len(found) + 1))
                keep_a, keep_b = [], []
                groups = zip(*(part.column(i).to_pylist() for i in (0, 1, 2)))
                for i, (b, salt, a) in enumerate(groups):
                    own = cell[edge[i] : edge[i + 1]]
                    if a is None:
                        key, target = (b, salt), own.copy()
                        continue
                    if key != (b, salt):
                        raise ValueError(f"text {b} is missing before its pairs")
                    shared = len(np.intersect1d(own, target, assume_unique=True))
                    if shared >= similarity * (len(own) + len(target) - shared) - 1e-9 and shared:
                        keep_a.append(a)
                        keep_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    sides = right.unionByName(left).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return sides.mapInArrow(run, "a long, b long")


def partners(x: int, band: int, other: np.ndarray, label: np.ndarray, bands: np.ndarray, bins: list, similarity: float) -> np.ndarray:
    """Which of the other rows x may be linked to: of another class, left to this band (the first one that the two
    share), and with an upper bound of the similarity that reaches it."""
    other = other[label[other] != label[x]]
    other = other[(bands[other] == bands[x]).argmax(1) == band]
    if bins[x] is None or not len(other):
        return other
    own = np.frombuffer(bins[x], np.uint16).astype(np.int64)
    keep = np.ones(len(other), bool)
    known = np.array([bins[y] is not None for y in other])
    if known.any():
        counts = np.frombuffer(b"".join(bins[y] for y in other[known]), np.uint16).reshape(-1, BINS).astype(np.int64)
        shared = np.minimum(counts, own).sum(1)
        keep[known] = shared >= similarity * (own.sum() + counts.sum(1) - shared) - 1e-9
    return other[keep]


def _grouped(batches, width: int):
    """((bucket, i, j, band), rows) of Arrow batches that are sorted by these four columns."""
    key, rows = None, []
    for batch in batches:
        for *group, row in zip(*(batch.column(n).to_pylist() for n in range(4)), zip(*(batch.column(n).to_pylist() for n in range(4, width)))):
            if tuple(group) != key:
                if rows:
                    yield key, rows
                key, rows = tuple(group), []
            rows.append(row)
    if rows:
        yield key, rows


_ROW = ("bh", "i", "j", "band", "k", "label", "block", "bands", "bins")
_ROW_TYPES = "bh long, i int, j int, band int, k long, label long, block int, bands array<long>, bins binary"


def _meeting(rows, i: int, j: int):
    """(x, those that x meets) of a group, with the group's labels and bands."""
    label = np.array([r[1] for r in rows], np.int64)
    block = np.array([r[2] for r in rows])
    bands = np.array([r[3] for r in rows], np.int64)
    there = np.flatnonzero(block == j)
    return label, bands, ((x, there if i != j else there[there > x]) for x in np.flatnonzero(block == i))


def _with_partner(grouped: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of each group that have a partner in it."""

    def run(batches):
        import pyarrow as pa

        for key, rows in _grouped(batches, len(_ROW)):
            found = np.zeros(len(rows), bool)
            label, bands, meeting = _meeting(rows, key[1], key[2])
            for x, there in meeting:
                near = partners(x, key[3], there, label, bands, [r[4] for r in rows], similarity)
                found[near] = True
                found[x] |= len(near) > 0
            if found.any():
                out = [(*key, *rows[n]) for n in np.flatnonzero(found)]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(types)], list(_ROW))

    return grouped.select(*_ROW).mapInArrow(run, _ROW_TYPES)


def _across(grouped: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between different classes of one group, verified in the task by the texts.

    A link joins its classes for the rest of the task, so a group gives fewer links than it has rows.
    """

    def links(key, rows):
        cells: dict[int, np.ndarray] = {}
        own = lambda n: cells[n] if n in cells else cells.setdefault(n, shingles([rows[n][5]], WIDTH)[1])
        label, bands, meeting = _meeting(rows, key[1], key[2])
        for x, there in meeting:
            for y in partners(x, key[3], there, label, bands, [r[4] for r in rows], similarity):
                if label[y] == label[x]:
                    continue
                shared = len(np.intersect1d(own(x), own(y), assume_unique=True))
                if shared >= similarity * (len(own(x)) + len(own(y)) - shared) - 1e-9:
                    label[label == label[y]] = label[x]
                    yield rows[x][0], rows[y][0]

    def run(batches):
        import pyarrow as pa

        for key, rows in _grouped(batches, len(_ROW) + 1):
            if found := list(links(key, rows)):
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return grouped.select(*_ROW, "text").mapInArrow(run, "a long, b long")


def near_dup_labels(texts: DataFrame) -> DataFrame:
    """(k, label) of the texts (k long, text string; equal texts have equal k) that have a near-duplicate.

    label is the smallest k of the class. Texts that aren't in the result are alone in their class.
    """
    signed = written(
        _signed(texts).groupBy("k").agg(F.first("bands").alias("bands"), F.first("bins").alias("bins")), "signatures"
    )
    in_band = signed.select("k", F.posexplode("bands").alias("band", "bh"))
    sizes = in_band.groupBy("bh").agg(F.count("*").alias("n")).where("n > 1")
    mates = written(in_band.join(sizes.withColumn("key", F.struct("bh")).drop("bh"), F.struct("bh") == F.col("key")).drop("key"), "buckets")
    fame = mates.groupBy("k").agg(F.sum("n").alias("fame"))
    famed = mates.select("bh", "k").join(fame, "k")
    hubs = famed.groupBy("bh").agg(F.max(F.struct("fame", "k")).alias("top")).select(
        F.struct("bh").alias("key"), F.col("top.k").alias("b")
    )
    to_hub = (
        mates.select(F.struct("bh").alias("key"), F.col("k").alias("a")).join(hubs, "key")
        .where("a <> b").select("a", "b").distinct()
    )
    known = written(texts.dropDuplicates(["k"]).join(fame.select("k"), "k", "left_semi"), "texts")
    links = written(verified(to_hub, known), "links")
    labels = components(links)
    # Buckets with several classes: compare their members across classes.
    classed = mates.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    mixed = (
        classed.groupBy("bh").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high").select(F.struct("bh").alias("key"))
    )
    open_ = (
        classed.withColumn("key", F.struct("bh")).join(mixed, "key", "left_semi").drop("key")
        .join(signed.select("k", "bands", "bins"), "k")
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        open_.withColumn("block", F.pmod(F.xxhash64("k"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j", "band")
    )
    left = written(_with_partner(dealt), "partners").join(known, "k")
    more = written(_across(left.repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j", "band")), "links")
    if not more.limit(1).count():
        return labels.select(F.col("node").alias("k"), "label")
    linked = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").union(more)
    return components(linked).select(F.col("node").alias("k"), "label")


def near_dup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id_col with class_id, the smallest id of its near-duplicate class, and __k, its text's hash.

    Defined cases: equal texts are in one class, texts without a word too if they are equal. A null text counts as
    empty. A text of 1 to 4 words has one shingle; texts of any length are read whole. Null ids keep their rows and never name a class unless it has no
    other id. Repeated rows give repeated rows. Other columns aren't read; an empty table gives an empty result.
    Texts are told apart by a 64-bit hash.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    labels = near_dup_labels(keyed.select("k", "text"))
    members = keyed.select("id", "k").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    names = members.groupBy("label").agg(F.min("id").alias("class_id")).withColumn("key", F.struct("label")).drop("label")
    return members.join(names, F.struct("label") == F.col("key")).select(F.col("id").alias(id_col), "class_id", F.col("k").alias("__k"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each near-duplicate class the row of the smallest id (nulls last).

    Where equal rows share that id and text one of them stays; where only the text differs, the one of smaller hash.
    All columns pass through. The other cases are those of near_dup_classes.
    """
    # The input's columns travel as one struct, so that no name of theirs meets one of these.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k"))
    labels = near_dup_labels(keyed.select("k", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text")))
    members = keyed.select(F.col("row")[id_col].alias("id"), "k").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k"))).alias("best")
    stay = members.groupBy("label").agg(best).select("best.k", "best.id")
    # A text's hash names at most one row to keep, so the rows that are left repeat each other.
    rows = keyed.join(stay, "k").where(F.col("row")[id_col].eqNullSafe(F.col("id"))).dropDuplicates(["k"])
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
