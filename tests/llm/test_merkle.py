import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm.merkle import folded, height, leaf_digest, merkle_manifest, op11_merkle_manifest, proof_digest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    """All levels of a tree of 16, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def brute(rows):
    """rows: (key, group, leaf). Counter of (key, group, leaf, subroot, root, proof)."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        trees[g] = levels([leaf or "" for _, leaf in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = Counter()
    for n, g in enumerate(names):
        for at, (key, leaf) in enumerate(groups[g]):
            path = steps(trees[g], at) + steps(top, n)
            proof = h(*[d for left, right in path for d in (*left, *right)])
            out[key, g, leaf, trees[g][-1][0], top[-1][0], proof] += 1
    return out


def frame(spark, rows, parts=7):
    made = [(k, g, leaf, "x", 1, "y", "z") for k, g, leaf in rows]
    return spark.createDataFrame(made, "key long, name string, leaf string, grp string, at int, path string, __row string").repartition(parts)


def test_every_size_null_groups_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = []
    for n, size in enumerate([1, 2, 15, 16, 17, 32, 33, 256, 257, 300, 700]):
        group = [None, "", "=", "é", "a", "B"][n] if n < 6 else f"g{n}"
        rows += [(rng.randrange(size * 2), group, h(str(rng.randrange(size)))) for _ in range(size)]
    rows += [(None, "a", h("q")), (None, "a", h("r")), (3, "lone", None)]
    rows += [(1, f"many{i}", h(str(i))) for i in range(40)]
    rng.shuffle(rows)
    made = merkle_manifest(frame(spark, rows), "name", "key")
    got = made.proofs.withColumn("proof", proof_digest(F.col("path"))).withColumn("back", folded(F.col("path"), F.coalesce("leaf", F.lit(""))))
    found = got.collect()
    assert Counter((r.key, r.name, r.leaf, r.subroot, r.root, r.proof) for r in found) == brute(rows)
    assert all(r.back == r.root for r in found)
    assert {(r.grp, r["at"], r["__row"]) for r in found} == {("x", 1, "z")}


def test_one_row_one_group_and_an_empty_table(spark):
    one = merkle_manifest(frame(spark, [(1, "a", h("x"))]), "name", "key").proofs.first()
    assert (one.subroot, one.root, list(one.path)) == (h("x"), h("x"), [])
    single = [(i, "a", h(str(i))) for i in range(600)]
    got = merkle_manifest(frame(spark, single), "name", "key").proofs.select("key", "name", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("p"))
    assert Counter(map(tuple, got.collect())) == brute(single)
    empty = merkle_manifest(frame(spark, []), "name", "key")
    assert empty.proofs.count() == 0 and empty.nodes.count() == 0


def test_heights():
    assert [height(n) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]


def test_leaves_and_tampering_over_odd_documents(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"text É{i}" + "A" * (i % 3), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i if i % 4 else None) for i in range(60)]
    rows += [(100, "", "", "", 0), (101, "Ab" * 500_000, "de", "s1", 1_000_000), (None, "No id", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_merkle_manifest(spark, str(tmp_path)).collect()}
    lower = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    want = {k[0]: k for k in brute([(r[0], r[3], leaf(r, r[1])) for r in rows])}
    for r in rows:
        out = got[r[0]]
        assert (out.doc_id, r[3], out.leaf, out.subroot, out.root, out.proof_sha256) == want[r[0]]
        hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None and r[1] != r[1].translate(lower)
        assert out.verified == (not hurt) == (out.folded_root == out.root)
    assert {v.verified for v in got.values()} == {True, False}


def test_leaf_digest_of_nulls(spark):
    got = spark.createDataFrame([(None, "é")], "a long, b string").select(leaf_digest([F.col("a"), F.col("b")])).first()[0]
    assert got == h("-", "2:é")
