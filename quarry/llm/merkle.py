"""Merkle manifests of a dataset: a tree of digests a group, a tree over the groups, and a proof for every row.

Partial parents gather indexed child digests while a task streams its sorted nodes; the arity a parent must reach follows
from its group's size, and a parent that reaches it becomes an event for the level above at once, so a task resolves
whole subtrees in one pass. Children of parents that end unresolved are the frontier: only they are dealt again, by an
ancestor a few levels up. Resolved parents keep their children as reverse links, from which proofs go down the tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc32_mod, fold_ascii, table, written
from quarry.llm.ordering import numbered

FAN = 16
#: Levels that a frontier climbs in one round: an ancestor's nodes, at most FAN ** CLIMB, meet in one task.
CLIMB = 3

_STEP = "struct<left:string,right:string>"
_NODE = "grp string, of long, level int, idx long, digest string, children array<string>, deal long, first long"
_COLUMNS = [field.split()[0] for field in _NODE.split(", ")]


@dataclass
class Manifest:
    """nodes: (grp, of, level, idx, digest, children) of every parent. proofs: the rows' leaves with subroot, root and
    path, the steps (left, right) that surround a digest at each level."""

    nodes: DataFrame
    proofs: DataFrame


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (hex) of the values in order: `-` for null, else the UTF-8 byte count, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with a path's steps."""
    return F.aggregate(path, leaf, lambda held, step: F.sha2(F.concat(step["left"], held, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def height(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves until one node remains."""
    up = 0
    while leaves > 1:
        leaves, up = -(-leaves // fan), up + 1
    return up


def climb(fan: int):
    """The task that gathers children into parents, for nodes sorted by group and first leaf.

    A level has one open parent at a time: when a child of another one comes, the open one's missing children aren't in
    this task, and those it has join the frontier.
    """

    def run(batches):
        import pyarrow as pa

        long, text = pa.int64(), pa.string()
        kinds = (text, long, pa.int32(), long, text, pa.list_(text), long, long)
        schema = pa.schema(list(zip(_COLUMNS, kinds, strict=True)))
        out: list[tuple] = []
        open_: dict[int, tuple[int, list[tuple[int, str]]]] = {}
        group, of, tall = None, 0, 0

        def wait(level: int) -> None:
            parent, children = open_.pop(level)
            top = ((level - 1) // CLIMB + 1) * CLIMB
            for idx, digest in children:
                out.append((group, of, level - 1, idx, digest, None, idx // fan ** (top - level + 1), idx * fan ** (level - 1)))

        def event(level: int, idx: int, digest: str) -> None:
            while level < tall:
                parent, up = idx // fan, level + 1
                if up in open_ and open_[up][0] != parent:
                    wait(up)
                children = open_.setdefault(up, (parent, []))[1]
                children.append((idx, digest))
                if len(children) < min(fan, -(-of // fan**level) - parent * fan):
                    return
                del open_[up]
                below = [d for _, d in children]
                digest = hashlib.sha256("".join(below).encode()).hexdigest()
                out.append((group, of, up, parent, digest, below, 0, 0))
                level, idx = up, parent

        def taken():
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return rows

        for batch in batches:
            for grp, size, level, idx, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if grp != group:
                    for up in sorted(open_):
                        wait(up)
                    group, of, tall = grp, size, height(size, fan)
                event(level, idx, digest)
                if len(out) >= 4096:
                    yield taken()
        for up in sorted(open_):
            wait(up)
        if out:
            yield taken()

    return run


def _tree(leaves: DataFrame, tall: int, fan: int) -> DataFrame:
    """All parents over leaves (grp, of, at, leaf)."""
    columns = ["grp", "of", "level", "idx", "digest"]
    work = leaves.sortWithinPartitions("grp", "at").select("grp", "of", F.lit(0).alias("level"), F.col("at").alias("idx"), F.col("leaf").alias("digest"))
    parents = None
    for _ in range(1 + -(-tall // CLIMB)):
        met = written(work.mapInArrow(climb(fan), _NODE), "merkle-nodes")
        done = met.where(F.col("children").isNotNull()).select(*columns, "children")
        parents = done if parents is None else parents.unionAll(done)
        work = met.where(F.col("children").isNull()).repartition("grp", "deal").sortWithinPartitions("grp", "first").select(*columns)
    return parents


def _paths(leaves: DataFrame, seeds: DataFrame, parents: DataFrame, tall: int, fan: int) -> DataFrame:
    """leaves with the path to the root and what seeds (grp, of, path, ...) say of the group, going down from its top."""
    said = [c for c in seeds.columns if c not in ("of", "path")]
    levels = sum((F.when(F.col("of") > fan**i, 1).otherwise(0) for i in range(tall)), F.lit(0))
    tops = seeds.withColumn("level", levels).withColumn("idx", F.lit(0).cast("long"))
    below = None
    for level in range(tall, 0, -1):
        here = tops.where(F.col("level") == level).select(*said, "idx", "path")
        here = here if below is None else here.unionAll(below)
        met = here.join(parents.where(F.col("level") == level).select("grp", "idx", "children"), ["grp", "idx"])
        if level > 1:
            slots = met.select(*said, "idx", "path", "children", F.posexplode("children").alias("slot", "child"))
            below = slots.select(*said, (F.col("idx") * fan + F.col("slot")).alias("idx"), _longer(F.col("slot"), fan).alias("path"))
    single = tops.where(F.col("level") == 0).select(*said, "idx", "path", F.lit(None).cast("array<string>").alias("children"))
    runs = single if not tall else single.unionByName(met)
    slot = (F.col("at") % fan).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(_longer(slot, fan))
    up = leaves.withColumn("idx", F.floor(F.col("at") / fan))
    return up.join(runs, ["grp", "idx"]).withColumn("path", path).drop("idx", "children")


def _longer(slot: Column, fan: int) -> Column:
    """The path with the siblings of a slot of `children` before it."""
    left, right = F.slice("children", F.lit(1), slot), F.slice("children", slot + 2, F.lit(fan))
    step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
    return F.concat(F.array(step), F.col("path"))


def merkle_manifest(leaves: DataFrame, group_col: str, order_col: str, leaf_col: str = "leaf", fan: int = FAN) -> Manifest:
    """A Merkle tree over each group's leaves and one over the groups' subroots, with a proof for every row.

    Within a group leaves ascend by order_col (nulls first), equal ones by their digest; every `fan` consecutive nodes
    (a last run has fewer, even one) become the SHA-256 of their digests until one is left, a lone leaf itself. Groups
    ascend by their text's bytes (null first, apart from the empty text). leaf_col holds hex digests.

    Defined cases: null groups are one group; repeated rows are leaves of their own; a null leaf counts as an empty
    text; an empty table has no nodes, proofs or root. The proofs have the columns of leaves and subroot, root, path, which
    replace columns of these names. Tasks hold one open parent a level; paths meet leaves once per
    run of `fan`.
    """
    # The input's columns travel as one struct, so that no name of theirs meets one of these.
    keyed = leaves.select(
        F.struct(*leaves.columns).alias("row"),
        # A group's key has a mark before its text, so that null (the bare empty text) comes before all.
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
        F.col(order_col).alias("key"), F.coalesce(leaf_col, F.lit("")).alias("leaf"),
    )
    rows = numbered(keyed, "grp", [F.col("key").asc_nulls_first(), F.col("leaf")], "merkle-leaves")
    placed = rows.select("grp", "of", "at", "leaf")
    biggest, groups = placed.where("at = 0").agg(F.coalesce(F.max("of"), F.lit(0)), F.count("*")).first()
    tall, wide = height(biggest, fan), height(groups, fan)
    nodes = _tree(placed, tall, fan)
    levels = sum((F.when(F.col("of") > fan**i, 1).otherwise(0) for i in range(tall)), F.lit(0))
    subroots = nodes.where(F.col("level") == levels).select("grp", "digest").unionAll(placed.where("of = 1").select("grp", "leaf"))
    over = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf")), "grp", [F.col("name")], "merkle-subroots")
    top = _tree(over, wide, fan)
    crown = top.where(F.col("level") == wide).select("grp", "of", F.col("digest").alias("root")) if wide else over.select("grp", "of", F.col("leaf").alias("root"))
    above = _paths(over.drop("of"), crown.withColumn("path", F.array().cast(f"array<{_STEP}>")), top, wide, fan)
    sizes = placed.where("at = 0").select("grp", "of")
    seeds = above.select(F.col("name").alias("grp"), "path", "root", F.col("leaf").alias("subroot")).join(sizes, "grp")
    seeds = written(seeds, "merkle-seeds")
    proofs = _paths(rows.drop("key", "leaf"), seeds, nodes, tall, fan)
    proofs = proofs.select(*[f"row.{c}" for c in leaves.columns if c not in ("subroot", "root", "path")], "subroot", "root", "path")
    return Manifest(nodes.unionAll(top.withColumn("grp", F.lit(None).cast("string"))), proofs)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of documents by source, their proofs, and what the proofs say where every fifth text is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    tampered = F.when(crc32_mod("doc_id", 5) == 0, leaf(fold_ascii(F.col("text"))))
    leaves = written(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered")), "merkle-digests")
    proofs = merkle_manifest(leaves, "source", "doc_id").proofs
    out = proofs.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "leaf")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"
)


def _oracle(group_levels: int = 7, source_levels: int = 4) -> str:
    """The tree level by level: 16 ** group_levels documents a source and 16 ** source_levels sources at most."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    fields = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({' || '.join([*fields, field('text')])}) AS leaf,
      CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN sha256({' || '.join([*fields, field(lower)])}) END AS bad FROM documents)""",
      "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
      "n0 AS (SELECT g, i, n, leaf AS d FROM a0)"]

    def levels(prefix: str, count: int) -> None:
        for k in range(1, count + 1):
            sql.append(f"""{prefix}{k} AS (SELECT g, i // 16 AS i, ceil(any_value(n) / 16)::BIGINT AS n, CASE WHEN any_value(n) = 1 THEN any_value(d)
              ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {prefix}{k - 1} GROUP BY g, i // 16)""")

    levels("n", group_levels)
    sql.append(f"m0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM n{group_levels})")
    levels("m", source_levels)
    left, folds = "a0", []
    shift = lambda at, k: f"({at} // {16**k})"
    for prefix, at, count, key in (("n", "i", group_levels, "t.g"), ("m", "j", source_levels, "''")):
        if prefix == "m":
            sql.append(f"b0 AS (SELECT t.*, m.i AS j, m.d AS subroot FROM {left} t JOIN m0 m ON m.name = t.g)")
            left = "b0"
        for k in range(count):
            at_k, new = shift("t." + at, k), f"{'p' if prefix == 'n' else 'q'}{k}"
            sql.append(f"""{new}_s AS (SELECT g, i // 16 AS run, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {prefix}{k} GROUP BY g, i // 16)""")
            sql.append(f"""{new} AS (SELECT t.*, CASE WHEN s.n = 1 THEN '-' ELSE array_to_string(s.ds[:{at_k} % 16], '') END AS l_{new},
              CASE WHEN s.n = 1 THEN '' ELSE array_to_string(s.ds[{at_k} % 16 + 2:], '') END AS r_{new}
              FROM {left} t JOIN {new}_s s ON s.g = {key} AND s.run = {at_k} // 16)""")
            left = new
            folds.append(new)
    steps = "list_value(" + ", ".join(f"l_{x}" for x in folds) + ")"
    rights = "list_value(" + ", ".join(f"r_{x}" for x in folds) + ")"
    proof = " || ".join(f"replace(l_{x}, '-', '') || r_{x}" for x in folds)
    sql.append(f"""folded AS (SELECT *, list_reduce(list_concat([{{'l': coalesce(bad, leaf), 'r': ''}}], list_transform(list_zip({steps}, {rights}),
      lambda z: {{'l': z[1], 'r': z[2]}})), lambda a, s: CASE WHEN s.l = '-' THEN a ELSE {{'l': sha256(s.l || a.l || s.r), 'r': ''}} END).l AS folded_root,
      sha256({proof}) AS proof_sha256 FROM {left})""")
    return "WITH " + ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, m.d AS root, proof_sha256, folded_root, folded_root = m.d AS verified FROM folded, m{source_levels} m"""


OP11_SQL = _oracle()
