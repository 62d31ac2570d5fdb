"""Exact dedup against history: a minimal perfect hash over the distinct digests of all earlier documents.

Texts become SHA-256 digests of their normalised bytes and digests are counted before they travel. History's distinct
digests are dealt to shards of a bounded size; each shard gets a minimal perfect hash (levels of bits: a key takes the
first level where no other key has its place, its slot is the number of bits before) whose slots hold the full digest
and the locator of the winner. A batch's distinct digests are looked up shard by shard and the slot's digest is compared
byte for byte, as a perfect hash gives a slot to strangers too; digests that history doesn't hold are groups of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WS_CLASS, table, written

#: Digests a shard holds on average; a shard is one task's unit.
SHARD = 1 << 15
#: Bits a key on each level.
ROOM = 2
#: A group of more than one in HEAVY of all rows meets its rows by broadcast: at most HEAVY digests can be so large.
HEAVY = 1024

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key, four words of 64 bits, on a level."""
    x = (words[:, level % 4] + np.uint64(level)) * _MULTIPLY
    x ^= words[:, (level + 1) % 4] >> np.uint64(17)
    x ^= x >> np.uint64(32)
    x *= _MULTIPLY
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct keys; other keys get some slot or -1."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.before = np.concatenate([[0], np.cumsum(self.bits)])

    @classmethod
    def over(cls, words: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(words):
            size = ROOM * len(words) + 1
            place = _places(words, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            words, level = words[~alone[place]], level + 1
        return cls(sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, words: np.ndarray) -> np.ndarray:
        slot = np.full(len(words), -1, np.int64)
        left, start = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            place = start + _places(words[left], level, size)
            found = self.bits[place]
            slot[left[found]] = self.before[place[found]]
            left, start = left[~found], start + size
        return slot


def _digests(column) -> np.ndarray:
    """(n, 32) bytes of an Arrow column of digests."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)


def _whole(table, name: str):
    """A column of an Arrow table as one array."""
    column = table[name].combine_chunks()
    return column if not hasattr(column, "chunks") else column.chunk(0)


def _build(rows):
    """One shard's row of the index from its distinct digests."""
    import pyarrow as pa

    digests = _digests(rows["digest"])
    made = PerfectHash.over(_words(digests))
    order = np.argsort(made.slots(_words(digests)))
    one = pa.array([0, len(order)], pa.int32())
    return pa.table(
        {
            "shard": rows["shard"].slice(0, 1),
            "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
            "bits": pa.array([made.packed()], pa.binary()),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.ListArray.from_arrays(one, _whole(rows, "winner").take(pa.array(order))),
            "copies": pa.ListArray.from_arrays(one, _whole(rows, "copies").take(pa.array(order))),
        }
    )


def _look_up(batch, shard):
    """The groups of one shard: what history holds, with the batch's rows of it, and what only the batch holds."""
    import pyarrow as pa

    if not batch.num_rows:  # nothing to look up: history's slots as they are
        held = _whole(shard, "winners").flatten()
        digests = np.frombuffer(shard["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        return pa.table({"digest": pa.array(map(bytes, digests), pa.binary()), "held": held, "fresh": pa.nulls(len(held), held.type), "copies": _whole(shard, "copies").flatten()})
    mine, ours, counts = _digests(batch["digest"]), _whole(batch, "winner"), _whole(batch, "copies").to_numpy()
    if not shard.num_rows:
        return pa.table({"digest": _whole(batch, "digest"), "held": pa.nulls(len(ours), ours.type), "fresh": ours, "copies": _whole(batch, "copies")})
    digests = np.frombuffer(shard["digests"][0].as_py(), np.uint8).reshape(-1, 32)
    slot = PerfectHash(shard["sizes"][0].as_py(), shard["bits"][0].as_py()).slots(_words(mine))
    member = slot >= 0
    member[member] = (digests[slot[member]] == mine[member]).all(axis=1)  # a stranger's slot holds another digest
    # The batch's row of each slot, -1 where it has none; then the batch's own digests.
    row = np.full(len(digests), -1, np.int64)
    row[slot[member]] = np.flatnonzero(member)
    own = np.flatnonzero(~member)
    row = np.concatenate([row, own])
    held = pa.concat_arrays([_whole(shard, "winners").flatten(), pa.nulls(len(own), ours.type)])
    copies = np.concatenate([_whole(shard, "copies").flatten().to_numpy(), np.zeros(len(own), np.int64)])
    copies[row >= 0] += counts[row[row >= 0]]
    return pa.table(
        {
            "digest": pa.array([*map(bytes, digests), *map(bytes, mine[own])], pa.binary()),
            "held": held,
            "fresh": ours.take(pa.array(np.where(row >= 0, row, 0), mask=row < 0)),
            "copies": pa.array(copies, pa.int64()),
        }
    )


def normalised(text: Column) -> Column:
    """Each run of blanks as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+", " ")


def located(docs: DataFrame, id_col: str, text_col: str, earlier: Column, keep: list[str]) -> DataFrame:
    """(row, digest, at, earlier): the columns to keep as one struct, the text's digest and the row's locator `at`,
    which orders rows by id (nulls last) and by place."""
    return docs.select(
        F.struct(*keep).alias("row"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.struct(F.col(id_col).isNull().alias("lacking"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place")).alias("at"),
        F.coalesce(earlier, F.lit(False)).alias("earlier"),
    )


def counted(rows: DataFrame) -> DataFrame:
    """(digest, winner, copies): the least locator and the count of each digest, summed up before the shuffle."""
    return rows.groupBy("digest").agg(F.min("at").alias("winner"), F.count("*").alias("copies"))


def history_index(groups: DataFrame, shards: int) -> DataFrame:
    """A row a shard over history's distinct digests (digest, winner, copies): the perfect hash and its slots."""
    kind = groups.schema["winner"].dataType.simpleString()
    schema = f"shard long, sizes array<long>, bits binary, digests binary, winners array<{kind}>, copies array<long>"
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, schema)


def merged_groups(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, held, fresh, copies): every digest of history or the batch, with the winner that each has of it."""
    kind = batch.schema["winner"].dataType.simpleString()
    left = batch.withColumn("shard", _shard(shards)).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInArrow(_look_up, f"digest binary, held {kind}, fresh {kind}, copies long")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def exact_dedup(docs: DataFrame, earlier: Column, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shard: int = SHARD) -> DataFrame:
    """The columns `keep` of docs (all of them by default) with keep_id (id_col's type), group_size (long), kept (boolean) and text_sha256 (hex).

    Texts are equal when they are after each run of ASCII blanks has become one blank. Rows for which `earlier` holds
    are history and go into the index; the others are the batch that is looked up in it. The row of the least id stays,
    whichever part it is in.

    Defined cases: a null text is an empty one; a null `earlier` is false; null ids come after all others, so that
    keep_id is null only where a group has no id; of rows with equal ids and texts exactly one stays. keep_id,
    group_size, kept and text_sha256 replace columns of these names and all others pass through. Texts of any length are
    hashed whole in one row. An empty table, history or batch gives the result of what is left. Texts count as equal
    when their 256-bit digests are.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = written(located(docs, id_col, text_col, earlier, keep or [id_col]), "dedup-rows")
    slim = rows.select("digest", "at", "earlier")
    history, batch = written(counted(slim.where("earlier")), "dedup-history"), written(counted(slim.where("not earlier")), "dedup-batch")
    shards = max(1, -(-max(history.count(), batch.count()) // shard))
    index = written(history_index(history, shards), "dedup-index")
    met = merged_groups(batch, index, shards)
    winner = F.array_min(F.array_compact(F.array("held", "fresh")))
    groups = written(met.select("digest", winner.alias("winner"), "copies"), "dedup-groups")
    bound = max(1, rows.count() // HEAVY)
    heavy = groups.where(F.col("copies") > bound)
    # A very large group's rows stay where they are; the others shuffle by digest, `bound` rows a key at most.
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    columns = ["row", "digest", "at", "winner", "copies"]
    large = marked.where(F.col("winner").isNotNull()).select(*columns)
    rest = marked.where(F.col("winner").isNull()).drop("winner", "copies")
    small = rest.join(groups.where(F.col("copies") <= bound), "digest").select(*columns)
    new = {
        "keep_id": F.col("winner.id"), "group_size": F.col("copies"), "kept": F.col("at") == F.col("winner"),
        "text_sha256": F.lower(F.hex("digest")),
    }
    return large.unionAll(small).select(*[f"row.{c}" for c in keep], *[v.alias(k) for k, v in new.items()])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, of which those with an id in the lower half of the range are history."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    earlier = F.col("doc_id") <= ((low or 0) + (high or 0)) // 2
    return exact_dedup(docs, earlier, keep=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13_SQL = r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
"""
