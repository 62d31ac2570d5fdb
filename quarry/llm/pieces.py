"""SentencePiece encoding and decoding of whole columns, by suffix-array matching.

The distinct segments (a run of blanks and what follows it up to the next blank or line end; no piece crosses such a
border) of a batch are concatenated, INDEXED characters at a time, and indexed by a suffix array. Every piece's
occurrence range is found by binary search, the resulting edges are sorted by position and relaxed from left to right.
For a byte-pair model an edge is accepted where its piece may stand behind the last piece of the text before it: no
merge across their border would have come first. Exactly one edge per position passes, which makes the result equal to merging pair by pair.

A segment of over LONG bytes (text without blanks) is cut into parts that are relaxed side by side, each from somewhat
before its start. What may follow at a place depends on no more than the last pieces before it, so a part whose pieces
agree with those of the part before it over the longest piece's length is right from there on; one that doesn't agree
is relaxed again from where the part before it ended.

The model file is read on the driver; executors get its tables with the task.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from quarry.llm.common import map_texts, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, END = "▁", 0xFF  # the mark that stands for a blank; a byte that UTF-8 never has
NONE = np.int64(1) << 40
#: Segments that a worker keeps with their ids, ids that it keeps, and slots of its table of piece pairs.
SEGMENTS_KEPT, IDS_KEPT, PAIR_SLOTS = 400_000, 1 << 23, 1 << 21
#: Characters of new segments that are indexed together; their edges take some hundred bytes a character.
INDEXED = 1 << 17
#: Bytes of a long segment, of its parts, and by how much a part begins early.
LONG, PART, EARLY = 8192, 2048, 256
_SEGMENT = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


def merge_all(symbols: list[str], rank: dict[str, int], trace: dict[int, tuple[str, str]] | None = None) -> list[str]:
    """Pair merging as such: always the adjacent pair of the best rank, the leftmost of equals. trace gets the last
    merge. It splits the model's pieces when a model is loaded; texts are encoded by their edges."""
    parts: list[str | None] = list(symbols)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[int, int, str, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts) and (r := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i] + parts[j], j))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, whole, j = heapq.heappop(heap)
        if parts[i] is None or right[i] != j or parts[j] is None or parts[i] + parts[j] != whole:
            continue
        if trace is not None:
            trace[0] = (parts[i], parts[j])
        parts[i], parts[j] = whole, None
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [p for p in parts if p is not None]


@dataclass
class PieceModel:
    """Tables of a byte-pair model with byte fallback, a blank in front and no other normalisation."""

    ids: np.ndarray  # of the pieces that can occur
    size: np.ndarray  # their bytes
    words: np.ndarray  # their bytes as big-endian 64-bit words, and masks of the same form
    masks: np.ndarray
    single: np.ndarray  # one character
    byte_id: np.ndarray
    rank: dict[str, int]
    id_of: dict[str, int]
    right: np.ndarray  # by id: the piece and its last parts, outermost first; -1 beyond
    left: np.ndarray
    right_parent: np.ndarray  # rank of the merge that ended such a part
    left_parent: np.ndarray
    merge_keys: np.ndarray  # open-addressed table of pairs of ids, and the rank of their merge
    merge_rank: np.ndarray
    piece_bytes: np.ndarray  # of all ids, concatenated
    piece_at: np.ndarray
    kept: dict = field(default_factory=dict, repr=False)  # number of each segment that a worker knows
    kept_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)
    kept_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)
    pair_keys: np.ndarray | None = field(default=None, repr=False)
    pair_good: np.ndarray | None = field(default=None, repr=False)

    def forget(self) -> None:
        self.kept, self.kept_ids, self.kept_counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __getstate__(self):
        """Without what a process has found out by encoding."""
        none = {"kept": {}, "kept_ids": np.zeros(0, np.int32), "kept_counts": np.zeros(0, np.int64)}
        return self.__dict__ | none | {"pair_keys": None, "pair_good": None}


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def load(path: str) -> PieceModel:
    """Read a model file. Raises ValueError for a kind of model that this encoder doesn't reproduce exactly."""
    import sentencepiece

    try:
        from sentencepiece import sentencepiece_model_pb2 as proto
    except ImportError as missing:
        raise ValueError("the model's description can't be read") from missing
    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm, kind = model.normalizer_spec, model.trainer_spec
    if kind.model_type != 2 or not kind.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only byte-pair models with byte fallback and without normalisation are supported")
    if not norm.add_dummy_prefix or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
        raise ValueError("only models with a blank in front are supported")
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type == 4 for p in model.pieces) or any("\n" in s and len(s) > 1 or BLANK in s.lstrip(BLANK) for s in normal):
        raise ValueError("pieces across blanks or lines are not supported")
    order = {s: n for n, s in enumerate(sorted({-score for _, score in normal.values()}))}
    rank = {p: order[-score] for p, (_, score) in normal.items()}
    id_of = {p: i for p, (i, _) in normal.items()}
    split, usable = {}, []
    for p in normal:
        trace: dict = {}
        if len(p) == 1 or merge_all(list(p), rank, trace) == [p]:
            usable.append(p)
            if len(p) > 1:
                split[p] = trace[0]

    def spine(p: str, side: int) -> list[str]:
        out = [p]
        while out[-1] in split:
            out.append(split[out[-1]][side])
        return out

    count = len(model.pieces)
    spines = {p: (spine(p, 0), spine(p, 1)) for p in usable}
    deep = max(len(s) for pair in spines.values() for s in pair)
    tables = [np.full((count, deep), -1, np.int32) for _ in "lr"]
    parents = [np.full((count, deep), NONE, np.int64) for _ in "lr"]
    for p, pair in spines.items():
        for side, parts in enumerate(pair):
            tables[side][id_of[p], : len(parts)] = [id_of[x] for x in parts]
            parents[side][id_of[p], 1 : len(parts)] = [rank[x] for x in parts[:-1]]
    pairs = {
        id_of[p[:n]] << 32 | id_of[p[n:]]: rank[p]
        for p in normal for n in range(1, len(p)) if p[:n] in id_of and p[n:] in id_of
    }
    slots = 1 << (4 * len(pairs)).bit_length()
    keys, ranks = np.full(slots + 64, -1, np.int64), np.zeros(slots + 64, np.int64)
    for key, at in zip(pairs, _slot(np.array(list(pairs), np.int64), slots)):
        while keys[at] >= 0:
            at += 1
        keys[at], ranks[at] = key, pairs[key]
    raw = [p.encode() for p in usable]
    size = np.array(list(map(len, raw)))
    n = -(-int(size.max()) // 8)
    words = np.frombuffer(b"".join(x.ljust(8 * n, b"\0") for x in raw), ">u8").astype(np.uint64).reshape(-1, n)
    masks = np.frombuffer(b"".join((b"\xff" * len(x)).ljust(8 * n, b"\0") for x in raw), ">u8").astype(np.uint64).reshape(-1, n)
    byte_id, texts = np.zeros(256, np.int64), []
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_id[int(p.piece[1:-1], 16)] = i
        texts.append(bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"")
    return PieceModel(
        np.array([id_of[p] for p in usable]), size, words, masks, np.array([len(p) == 1 for p in usable]), byte_id, rank, id_of,
        tables[1], tables[0], parents[1], parents[0], keys, ranks, np.frombuffer(b"".join(texts), np.uint8),
        np.concatenate([[0], np.cumsum(list(map(len, texts)))]),
    )


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, word): suffixes sorted by their first `depth` bytes (or more), by doubling; word holds each position's
    eight bytes. data must end with eight bytes beyond the last suffix of interest."""
    n = len(data) - 8
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | data[i : i + n]
    order = np.argsort(word)
    sorted_ = word[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
    width = 8
    while width < depth:
        key = rank << np.int64(32)
        key[:-width] += rank[width:]
        order = np.argsort(key)
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
        width *= 2
    return order, word


def ranges(model: PieceModel, order: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one place in the suffix array of each piece's occurrences, by binary search."""
    padded = np.concatenate([word, np.zeros(8 * model.words.shape[1], np.uint64)])

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(model.ids), np.int64), np.full(len(model.ids), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            at = order[mid]
            less = np.zeros(len(open_), bool)
            tied = np.ones(len(open_), bool)
            for k in range(model.words.shape[1]):
                got, want = padded[at + 8 * k] & model.masks[open_, k], model.words[open_, k]
                less |= tied & (got < want)
                tied &= got == want
            less = less | tied if after else less
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    return bound(False), bound(True)


def _may_follow(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves the pieces a and b side by side: no merge of a last part of a with a first part of b
    ranks before both the merge that took up the one and the merge that took up the other (the left one wins ties)."""
    if model.pair_keys is None:
        model.pair_keys, model.pair_good = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
    key = a.astype(np.int64) << 32 | b
    slot = _slot(key, PAIR_SLOTS)
    good = model.pair_good[slot]
    new = np.flatnonzero(model.pair_keys[slot] != key)
    if len(new):
        _, once, back = np.unique(key[new], return_index=True, return_inverse=True)
        at = new[once]
        left, right = a[at], b[at]
        bad = np.zeros(len(at), bool)
        slots = len(model.merge_keys) - 64
        for i in range(model.right.shape[1]):
            rows = np.flatnonzero(model.right[left, i] >= 0)
            if not len(rows):
                break
            for j in range(model.left.shape[1]):
                rows = rows[model.left[right[rows], j] >= 0]
                if not len(rows):
                    break
                pair = model.right[left[rows], i].astype(np.int64) << 32 | model.left[right[rows], j]
                where = _slot(pair, slots)
                open_ = np.arange(len(rows))
                while len(open_):
                    have = model.merge_keys[where[open_]]
                    hit = open_[have == pair[open_]]
                    m = model.merge_rank[where[hit]]
                    r = rows[hit]
                    bad[r] |= (m < model.right_parent[left[r], i]) & (m <= model.left_parent[right[r], j])
                    open_ = open_[(have >= 0) & (have != pair[open_])]
                    where[open_] += 1
        model.pair_keys[slot[at]], model.pair_good[slot[at]] = key[at], ~bad
        good[new] = ~bad[back]
    return good


def _last_pieces(model: PieceModel, raw: list[bytes], known: np.ndarray | None = None):
    """(begin, length, last, reach): for each place behind a segment's start the last piece (id, -1 for none) of the
    text up to there, and its bytes. Segments lie side by side, `begin` is where each starts.

    known gives the last pieces at the first places of a single segment whose true start lies further back.
    """
    length = np.array(list(map(len, raw)))
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    data = np.frombuffer(bytes([END]).join(raw) + bytes([END]) * 9, np.uint8)
    order, word = suffix_array(data, int(model.size.max()))
    low, high = ranges(model, order, word)
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    at = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(piece))]
    size = model.size[piece]
    one = model.single[piece]
    cover = np.bincount(at[one], minlength=len(data)) - np.bincount(at[one] + size[one], minlength=len(data))
    bare = np.flatnonzero((np.cumsum(cover)[: len(data)] == 0) & (data != END))
    # Bytes of characters that no piece holds are edges of their own, which merge with nothing.
    start = np.concatenate([at, bare])
    size = np.concatenate([size, np.ones(len(bare), np.int64)])
    code = np.concatenate([model.ids[piece], model.byte_id[data[bare]]])
    plain = np.concatenate([np.ones(len(at), bool), np.zeros(len(bare), bool)])
    stop = start + size
    head = np.repeat(begin, length + 1)[start]
    step = stop - head
    longest = int(length.max())
    by_step = np.argsort(step.astype(np.uint16) if longest < 1 << 16 else step, kind="stable")
    start, stop, code, plain = start[by_step], stop[by_step], code[by_step], plain[by_step]
    fresh = (start == head[by_step]) & (known is None)
    cuts = np.searchsorted(step[by_step], np.arange(1, longest + 2))
    last = np.full(len(data) + 1, -1, np.int64)
    behind_plain = np.zeros(len(data) + 1, bool)
    reach = np.zeros(len(data) + 1, np.int32)
    if known is not None:
        last[: len(known)] = known
        behind_plain[: len(known)] = (known >= 0) & ~np.isin(known, model.byte_id)
        cuts = cuts[len(known) - 1 :]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        s, c, p = start[a:b], code[a:b], plain[a:b]
        before = last[s]
        good = fresh[a:b].copy()
        known = ~good & (before >= 0)
        good |= known & ~(p & behind_plain[s])
        ask = np.flatnonzero(known & p & behind_plain[s])
        good[ask] = _may_follow(model, before[ask], c[ask])
        e = stop[a:b][good]
        last[e], behind_plain[e], reach[e] = c[good], p[good], e - s[good]
    return begin, length, last, reach


def _relax(model: PieceModel, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the ids of all segments one after another; none is empty."""
    begin, length, last, reach = _last_pieces(model, [s.encode("utf-8", "replace") for s in segments])
    # Walk back from each segment's end, all segments at once.
    place = begin + length
    live = np.flatnonzero(length > 0)
    found, whose = [], []
    while len(live):
        here = place[live]
        if (last[here] < 0).any():
            raise ValueError("a segment has no encoding")
        found.append(last[here])
        whose.append(live)
        place[live] = here - reach[here]
        live = live[place[live] > begin[live]]
    found, whose = np.concatenate(found)[::-1], np.concatenate(whose)[::-1]
    by = np.argsort(whose, kind="stable")
    return found[by].astype(np.int32), np.bincount(whose, minlength=len(segments))


def _relax_long(model: PieceModel, segment: str) -> np.ndarray:
    """The ids of one long segment, part by part. Its tables take some seven bytes a byte."""
    raw = segment.encode("utf-8", "replace")
    deep = int(model.size.max())

    def border(at: int) -> int:
        """The start of the character at a place."""
        while at > 0 and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return max(at, 0)

    cuts = sorted({border(c) for c in range(0, len(raw), PART)})
    parts = [(border(c - EARLY) if c else 0, c, e) for c, e in zip(cuts, [*cuts[1:], len(raw)])]
    last, reach = np.full(len(raw) + 1, -1, np.int32), np.zeros(len(raw) + 1, np.uint16)
    together = max(1, INDEXED // (PART + EARLY))
    for i in range(0, len(parts), together):
        some = parts[i : i + together]
        begin, _, found, back = _last_pieces(model, [raw[s:e] for s, _, e in some])
        for b, (s, c, e) in zip(begin, some):
            own, size = found[b : b + e - s + 1], back[b : b + e - s + 1]
            if c and not (c - s >= deep and (own[c - s - deep + 1 : c - s + 1] == last[c - deep + 1 : c + 1]).all()):
                s = border(c - deep)
                _, _, own, size = _last_pieces(model, [raw[s:e]], last[s : c + 1])
            last[c + 1 : e + 1], reach[c + 1 : e + 1] = own[c - s + 1 : e - s + 1], size[c - s + 1 : e - s + 1]
    out, at, which, step = array("i"), len(raw), memoryview(last), memoryview(reach)
    while at > 0:
        if which[at] < 0:
            raise ValueError("a segment has no encoding")
        out.append(which[at])
        at -= step[at]
    return np.frombuffer(out, np.int32)[::-1]


def encode_segments(model: PieceModel, segments: list[str]) -> None:
    """Add the ids of segments that aren't known yet to what the model has kept."""
    plain = [s for s in segments if len(s) <= LONG // 4]
    long_ = [s for s in segments if len(s) > LONG // 4]
    size = np.cumsum([len(s) for s in plain])
    cuts = np.searchsorted(size, np.arange(INDEXED, size[-1], INDEXED), "right") if plain else np.zeros(0, np.int64)
    cuts = np.unique([0, *cuts, len(plain)]).astype(int)
    done = [_relax(model, plain[a:b]) for a, b in zip(cuts, cuts[1:])]
    ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in done)])
    counts = np.concatenate([np.zeros(0, np.int64), *(x for _, x in done)])
    apart = [_relax_long(model, s) for s in long_]
    counts = np.concatenate([counts, np.array(list(map(len, apart)), np.int64)])
    base = len(model.kept_counts)
    model.kept_ids = np.concatenate([model.kept_ids, ids, *apart])
    model.kept_counts = np.concatenate([model.kept_counts, counts])
    model.kept.update(zip([*plain, *long_], range(base, base + len(plain) + len(long_))))


def encode(model: PieceModel, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts. An empty text has none."""
    cut = [_SEGMENT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
    new = set().union(*cut).difference(model.kept)
    if len(model.kept) + len(new) > SEGMENTS_KEPT or len(model.kept_ids) > IDS_KEPT:
        model.forget()
        new = set().union(*cut)
    if new:
        encode_segments(model, list(new))
    which = np.fromiter(map(model.kept.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
    begin = np.cumsum(model.kept_counts) - model.kept_counts
    counts = model.kept_counts[which]
    total = np.concatenate([[0], np.cumsum(counts)])
    ids = model.kept_ids[np.repeat(begin[which] - total[:-1], counts) + np.arange(total[-1])]
    edge = total[np.concatenate([[0], np.cumsum(list(map(len, cut)))]).astype(np.int64)]
    return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]


def decode(model: PieceModel, ids: np.ndarray) -> bytes:
    """UTF-8 of the ids' text: pieces side by side, the mark as a blank, the blank in front taken off."""
    if not len(ids):
        return b""
    begin, size = model.piece_at[ids], np.diff(model.piece_at)[ids]
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    out = model.piece_bytes[at].tobytes()
    return out[1:] if out[:1] == b" " else out


def encode_texts(docs: DataFrame, model: PieceModel, keep: list[str], text_col: str = "text", with_ids: bool = True, most: int = 1 << 22) -> DataFrame:
    """The columns `keep` of docs with ids (array<int>, if with_ids), n_tokens long, ids_sha256 (of the ids as
    little-endian 32-bit integers), decoded_sha256 (of the text that decoding gives) and round_trip boolean.

    Whole texts are encoded, very long ones and those without a blank too; a task works on about `most` characters, or
    one text, at a time. Defined cases: a null or empty text has no ids, decodes to the empty text and makes the
    round trip; a text with the character U+2581 doesn't, as the model takes it for a blank. Repeated rows are encoded
    alike; columns outside keep aren't read; an empty table gives an empty result.
    """
    fields = [StructField("ids", ArrayType(IntegerType()))] * with_ids + [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()), StructField("round_trip", BooleanType()),
    ]
    names = [c for c in keep if c not in {f.name for f in fields}]

    def run(texts):
        ids = encode(model, texts)
        back = [decode(model, x) for x in ids]
        return {
            "ids": ids,
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
            "round_trip": [x == t.encode("utf-8", "replace") for x, t in zip(back, texts)],
        }

    return map_texts(docs, names, text_col, fields, run, rows=max(1, most >> 10), most=most)


def decode_ids(tokens: DataFrame, model: PieceModel, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` of tokens with text, decoded from ids_col; null where the ids are null."""
    from pyspark.sql.types import StructType

    names = [c for c in keep if c != "text"]
    schema = StructType([tokens.schema[c] for c in names] + [StructField("text", StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [
                None if x is None else decode(model, np.array(x, np.int64)).decode("utf-8", "replace")
                for x in batch.column(len(names)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*names, "text"])

    return tokens.select(*names, ids_col).mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), load(model_path), ["doc_id"])
