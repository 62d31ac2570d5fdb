"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams of its letters, hashed into a fixed number of buckets. The model averages the
buckets' embeddings and applies a linear softmax; it is trained on the driver by stochastic gradient descent in numpy,
on a bounded sample (SAMPLE texts in all, or LEAST of each of more than 40 languages) that executors have already reduced to bucket counts. As the softmax is
linear, embedding and weights fold into one score table, which executors sum over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField

from quarry.llm.common import crc32_mod, drawn, map_texts, table

BUCKETS, WIDTH, GRAMS, SEED = 1 << 13, 16, (3, 4), 5
#: Texts for training and calibration together, shared equally by the languages, and texts that a language has at
#: least (if it occurs as often). A text comes to the driver as at most BUCKETS pairs of a bucket and a share.
SAMPLE, LEAST = 2400, 60
#: A prediction is rejected under the smallest confidence at which the calibration texts reach this precision.
PRECISION = 0.98
CHUNK = 1 << 19
#: Languages that are learned at most, the most frequent ones; it bounds the labelled rows and the model.
LANGUAGES = 256
_LETTER = r"\p{L}"
_FOLD = bytes(
    b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)  # ASCII letters in lower case, other ASCII as blanks


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last n - 1."""
    size = len(data) - n + 1
    code = np.full(size, n, np.uint32)
    for i in range(n):
        code *= np.uint32(0x01000193)
        code += data[i : i + size]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(19)).astype(np.int32)


def folded(text: str) -> bytes:
    return b" " + text.encode("utf-8", "replace").translate(_FOLD) + b" "


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    data, out = np.frombuffer(folded(text), np.uint8), np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK + max(GRAMS) - 1]
        for n in GRAMS:
            if len(part) >= n:
                out += np.bincount(grams(part, n)[:CHUNK], minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # a row for each bucket: its embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean score of a text's n-grams. Short texts are summed together, a long one in pieces."""
        out = np.zeros((len(texts), len(self.languages)))
        todo: list[int] = []
        held = 0
        data = [folded(t) for t in texts]
        for i, x in enumerate(data):
            todo.append(i)
            held += len(x)
            if held >= CHUNK or i == len(data) - 1:
                if len(todo) == 1:
                    counts = bucket_counts(texts[i])
                    out[i] = counts @ self.scores / max(1, counts.sum())
                else:
                    out[todo] = self._together([data[j] for j in todo])
                todo, held = [], 0
        return out + self.bias

    def _together(self, data: list[bytes]) -> np.ndarray:
        joined = np.frombuffer(b"".join(data), np.uint8)
        lengths = np.array(list(map(len, data)))
        ends = np.cumsum(lengths)
        total = np.zeros((len(data), len(self.languages)))
        count = np.zeros(len(data))
        for n in GRAMS:
            found = grams(joined, n)
            keep = np.maximum(lengths - n + 1, 0)
            owner = np.repeat(np.arange(len(data)), keep)
            start = np.repeat(ends - lengths - np.concatenate([[0], np.cumsum(keep)[:-1]]), keep)
            picked = found[np.arange(len(owner)) + start]
            for c in range(len(self.languages)):
                total[:, c] += np.bincount(owner, self.scores[picked, c], len(data))
            count += keep
        return total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, confidence) of each text; texts without a letter come as empty ones and are `und`."""
        p = softmax(self.logits(texts) / self.temperature)
        some = np.array([bool(t) for t in texts], bool)
        best = p.argmax(1)
        return (
            [self.languages[b] if s else "und" for b, s in zip(best, some)],
            np.where(some, p[np.arange(len(p)), best], 0.0),
        )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 12, batch: int = 32, rate: float = 0.25):
    """Stochastic gradient descent with per-parameter step sizes on rows (class, buckets, shares)."""
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.1, (WIDTH, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen = [np.full_like(x, 1e-8) for x in (embed, weights, bias)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = [rows[i] for i in order[start : start + batch]]
            x = np.zeros((len(part), BUCKETS), np.float32)
            for row, (_, at, share) in zip(x, part):
                row[at] = share
            mean = x @ embed
            error = softmax(mean @ weights + bias)
            error[np.arange(len(part)), [c for c, _, _ in part]] -= 1
            error /= len(part)
            steps = (x.T @ (error @ weights.T), mean.T @ error, error.sum(0))
            for value, step, total in zip((embed, weights, bias), steps, seen):
                total += step * step
                value -= rate * step / np.sqrt(total)
    return (embed @ weights).astype(np.float64), bias.astype(np.float64)


def calibrate(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log loss, and the rejection threshold, on texts that training has not seen."""
    if not len(truth):
        return 1.0, 0.0
    at = np.arange(len(truth))
    loss = lambda t: -np.log(softmax(logits / t)[at, truth] + 1e-12).mean()
    best = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(logits / best)
    top, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-top)
    precise = np.flatnonzero(np.cumsum(right[order]) / (at + 1) >= PRECISION)
    return best, float(top[order][precise[-1]]) if len(precise) else 1.0


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel | None:
    """Fit on a sample of the rows that learn admits, of the LANGUAGES most frequent languages (equal ones by name),
    drawn by a hash of the id. Rows without a letter teach nothing."""
    named = {id_col: "id", lang_col: "lang", text_col: "text"}
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(_LETTER), F.lit(False)))
    known = known.select(*[F.col(c).alias(n) for c, n in named.items()])
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    some = drawn(known, "lang", "id", counts, max(LEAST, SAMPLE // len(counts)))

    def reduce(texts):
        at, share = [], []
        for t in texts:
            c = bucket_counts(t)
            found = np.flatnonzero(c)
            at.append(found.astype(np.int32).tobytes())
            share.append((c[found] / max(1, c.sum())).astype(np.float32).tobytes())
        return {"buckets": at, "shares": share}

    fields = [StructField("buckets", BinaryType()), StructField("shares", BinaryType())]
    rows = map_texts(some, ["lang", "__rank"], "text", fields, reduce).collect()
    rows.sort(key=lambda r: (r["lang"], r["__rank"]))
    languages = sorted({r["lang"] for r in rows})
    ready = [
        (
            languages.index(r["lang"]), np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32),
            r["__rank"] % 5 == 0,
        )
        for r in rows
    ]
    held = [r for r in ready if r[3]]
    table_, bias = train([r[:3] for r in ready if not r[3]] or [r[:3] for r in held], len(languages))
    model = LanguageModel(languages, table_, bias, 1.0, 0.0)
    logits = np.array([share @ table_[at] + bias for _, at, share, _ in held]).reshape(len(held), len(languages))
    model.temperature, model.threshold = calibrate(logits, np.array([r[0] for r in held], int))
    return model


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred string, score double (calibrated probability, 0 to 1), rejected boolean.

    Whole texts are read. Defined cases: a null text or one without a letter (Unicode category L, as in fit()) is `und`
    with score 0 and rejected; without a model everything is. A text shorter than an n-gram has the model's bias alone. A tie goes to the
    first language by name. Repeated rows are predicted alike; columns outside keep are not read.
    """
    names = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]

    def run(texts):
        lang, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
        limit = model.threshold if model else 1.0
        return {"lang_pred": lang, "score": score, "rejected": [x == "und" or s < limit for x, s in zip(lang, score)]}

    lettered = "lettered"
    while lettered in docs.columns:
        lettered += "_"
    able = docs.withColumn(lettered, F.when(F.col(text_col).rlike(_LETTER), F.col(text_col)))
    return map_texts(able, names, lettered, fields, run)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = crc32_mod("doc_id", 4)
    found = identify(docs, fit(docs, rest != 2), ["doc_id"])
    held = F.coalesce(rest == 2, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
