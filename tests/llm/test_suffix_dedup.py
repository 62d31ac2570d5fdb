import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import suffix_dedup as sd
from quarry.llm.hashing import Prefixes

SF = "/root/testdata/sf0.001"


def brute(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha) of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sd.suffix_dedup(docs, ["doc_id"], with_text=False, **options).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)]


def test_documents_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert run(spark, texts) == brute(texts)


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (8, 30, 60, 200)]
    texts = []
    for _ in range(n):
        t = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randrange(1, len(p))] + prose(rng.randrange(0, 30))
        texts.append(t)
    texts += ["a" * 700, "ab" * 400, "a" * 199, "a" * 200, "a" * 200, None, "", "x" * 199 + "y", passages[3], passages[3] + "!"]
    return texts


@pytest.mark.parametrize("shard,batch,parts", [(1024, 1024, 4), (3, 1024, 4), (2, 5, 2), (1024, 7, 4)])
def test_planted_passages_by_every_way(spark, monkeypatch, shard, batch, parts):
    monkeypatch.setattr(sd, "SHARD", shard)
    monkeypatch.setattr(sd, "BATCH", batch)
    monkeypatch.setattr(sd, "PARTS", parts)
    texts = planted(shard + batch)
    assert run(spark, texts) == brute(texts)


def test_a_kmer_with_thousands_of_contexts(spark):
    rng = random.Random(5)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line = noise(190)
    texts = [noise(60) + line + noise(60) for _ in range(5000)]
    texts += [noise(40) + texts[7][30:260] + noise(40), texts[9][50:280], noise(20) + line + texts[11][250:] + "z"]
    assert run(spark, texts) == brute(texts)


def test_a_long_text_is_read_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    long_ = noise(60_000)
    texts = [long_, long_[16_200:16_700] + noise(100), noise(30) + long_[49_000:49_300], "a" * 40_000, noise(500)]
    monkeypatch.setattr(sd, "SLICE", 1 << 14)
    data = np.frombuffer(long_.encode(), np.uint8)
    first, count, *_ = sd.anchored(data, np.array([0]), np.array([len(data)]))
    assert sorted(i for f, n in zip(first, count) for i in range(f, f + n)) == list(range(len(data) - 199))
    assert run(spark, texts) == brute(texts)


def test_index_over_batches(spark, tmp_path):
    texts = planted(11, 50)
    batches = [texts[:30], texts[30:36], texts[36:42], texts[42:48], texts[48:], [None, ""]]
    seen = []
    for i, batch in enumerate(batches):
        index = sd.SuffixIndex(spark, str(tmp_path / "index"))  # opened anew: the levels are in tables
        assert index.version == i
        docs = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string")
        got = sorted(index.dedup(docs, ["doc_id"], with_text=False).collect(), key=lambda r: r.doc_id)
        seen += batch
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(seen)[-len(batch) :]
    assert 1 <= len(index.levels) < len(batches)


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_family_finds_the_same_at_any_batch_size(batch):
    rng = random.Random(9)
    length, kmer = 20, 4
    base = "".join(rng.choice("ab") for _ in range(60))
    texts = [base[rng.randrange(20) :] + "".join(rng.choice("ab") for _ in range(30)) for _ in range(40)]
    rows, owner = [], []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for f, n, a, kh in zip(*sd.sampled(data, Prefixes(data), np.array([0]), np.array([len(data)]), length, kmer)):
            ctx = t.encode()[f : f + n - 1 + length]
            rows.append((int(kh).to_bytes(8, "big") + ctx[a - f :], ctx[: a - f], len(rows), int(a - f - n + 1), int(a - f)))
            owner.append((t, int(f), int(n)))
    family = sd.Family(length, kmer)
    for i in range(0, len(rows), batch):
        family.add(rows[i : i + batch])
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for (t, f, n), row, flags in zip(owner, rows, family.twice):
        for a in range(row[3], row[4] + 1):
            assert flags[a] == (count[t[f + row[4] - a :][:length]] > 1)
    if batch < 50:
        assert all(len(x) <= batch * 2**h for h, x in family.levels.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=4))
def test_every_window_has_one_anchor_within_it(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum(list(map(len, raw)), dtype=np.int64) if raw else np.zeros(0, np.int64)
    begin = end - np.array(list(map(len, raw)), np.int64)
    first, count, anchor, _ = sd.sampled(data, Prefixes(data), begin, end, 20, 4)
    starts = np.sort(np.concatenate([np.arange(f, f + n) for f, n in zip(first, count)] or [np.zeros(0, int)]))
    assert starts.tolist() == [b + i for b, r in zip(begin, raw) for i in range(len(r) - 19)]
    assert ((first + count - 1 <= anchor) & (anchor - first <= 16)).all()


def test_repeated_ids_nulls_and_clashing_names(spark):
    long_ = " ".join(map(str, range(200)))
    rows = [(1, long_, 5), (1, long_, 5), (None, long_ + "z", 6), (2, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = sd.suffix_dedup(docs, ["doc_id", "n_bytes"]).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == [
        (0, len(long_) + 1, len(long_), b"z"), (1, len(long_), len(long_), b""), (1, len(long_), len(long_), b""), (2, 0, 0, b""),
    ]
    assert sd.suffix_dedup(docs.limit(0), ["doc_id"]).count() == 0
