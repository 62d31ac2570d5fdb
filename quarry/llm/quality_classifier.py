"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

One pass over the texts writes a dozen statistics a document. Everything else works on that small table: each
partition sums its normal equations, Spark adds the sums cell by cell, and the driver solves one system of a fixed
size. Raw scores of a second fold are counted in a fixed number of bins, from which the isotonic curve is fitted.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from quarry.llm.common import crc32_mod, map_texts, table, written

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "marks", "stops", "bangs", "symbols", "wide", "distinct_words",
    "top_word", "short_words", "line_length", "repeated_lines",
)
FEATURES, SIGMA, RIDGE, SEED, BINS = 128, 2.5, 1e-4, 11, 2048


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((256, 7), np.float64)
    for b in range(256):
        c = chr(b)
        kinds[b] = (
            "A" <= c <= "Z", c.isdigit() and b < 128, b < 128 and c.isprintable() and not c.isalnum() and c != " ",
            c in ".,;:?", c == "!", c in "#*$%&|<>", 0x80 <= b < 0xC0,
        )
    return kinds


_CLASSES = _byte_classes()


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text. An empty text gives zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for row, text in zip(out, texts):
        words = text.split()
        if not words:
            continue
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        shares = np.bincount(data, minlength=256) @ _CLASSES / len(data)
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        lengths = list(map(len, words))
        row[:] = (
            np.log1p(len(words)), sum(lengths) / len(words), *shares, len(counts) / len(words),
            max(counts.values()) / len(words), sum(n <= 3 for n in lengths) / len(words),
            np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
        )
    return out


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def run(texts):
        return {"__stats": list(statistics(texts))}

    return map_texts(docs, keep, text_col, [StructField("__stats", ArrayType(FloatType()))], run)


@dataclass
class QualityModel:
    """Everything that scoring needs; a few kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.weights + self.offsets)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence that is closest in weighted squares."""
    blocks: list[list[float]] = []  # level, weight, length
    for v, w in zip(values, weights):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _stats_batches(batches):
    for batch in batches:
        if batch.num_rows:
            stats = batch.column("__stats")
            yield batch, np.asarray(stats.flatten(), np.float64).reshape(batch.num_rows, len(STATISTICS))


def fit(labelled: DataFrame) -> QualityModel | None:
    """Fit on rows (stats, y 0/1, fold 0 for the ridge fit or 1 for calibration); None without usable rows."""
    k = len(STATISTICS)
    first = labelled.where("fold = 0")
    sums = first.agg(
        F.count("*").alias("n"),
        *[F.avg(F.get("__stats", F.lit(i))).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.get("__stats", F.lit(i))).alias(f"s{i}") for i in range(k)],
    ).first()
    if not sums["n"]:
        return None
    rng = np.random.default_rng(SEED)
    scale = np.array([sums[f"s{i}"] for i in range(k)])
    model = QualityModel(
        np.array([sums[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0),
        rng.normal(0, 1 / SIGMA, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1),
        np.zeros(1), np.zeros(1),
    )
    size = FEATURES + 2  # the features, a constant and the label: the last column holds Z'y
    low, high = np.triu_indices(size)

    def equations(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch, stats in _stats_batches(batches):
            y = np.asarray(batch.column("y"), np.float64)
            z = np.hstack([model.features(stats), y[:, None]])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(total[low, high])], ["cell", "v"])

    cells = first.select("__stats", "y").mapInArrow(equations, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    gram = np.zeros((size, size))
    for cell, v in cells.collect():  # a fixed number of cells
        gram[low[cell], high[cell]] = gram[high[cell], low[cell]] = v
    n, m = sums["n"], FEATURES + 1
    penalty = RIDGE * n * np.eye(m)
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(gram[:m, :m] + penalty + 1e-9 * np.eye(m), gram[:m, m])

    def binned(batches):
        import pyarrow as pa

        seen = np.zeros((2, BINS), np.int64)
        for batch, stats in _stats_batches(batches):
            at = np.clip(((model.raw(stats) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
            seen[0] += np.bincount(at, minlength=BINS)
            seen[1] += np.bincount(at, np.asarray(batch.column("y"), np.float64), BINS).astype(np.int64)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bin", "n", "good"])

    bins = (
        labelled.where("fold = 1").select("__stats", "y").mapInArrow(binned, "bin int, n long, good long")
        .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    )
    if not bins:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    n = np.array([b["n"] for b in bins], float)
    good = np.array([b["good"] for b in bins], float)
    prior = good.sum() / n.sum()
    model.knots = (np.array([b["bin"] for b in bins]) + 0.5) * 2 / BINS - 0.5
    model.levels = isotonic((good + prior) / (n + 1), n + 1)
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    fold: Column,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The columns `keep` of docs (id_col among them) with score double (0 to 1) and predicted int (score >= 0.5).

    learn (a condition on keep) admits rows to training; fold gives 0 (ridge fit) or 1 (calibration). Labels join by
    id_col; the largest label counts where an id repeats.

    Defined cases: a null or empty text has zero statistics and is scored like any other. Null labels and ids teach
    nothing. Without a usable label every score is 0.5; with one class only, the curve is that class's share.
    Repeated rows are scored alike. Columns outside keep are not read; an empty table gives an empty result.
    """
    names = [c for c in keep if c not in ("score", "predicted")]
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("__y"))
    )
    stats = written(with_statistics(docs, names, text_col), "statistics")
    taught = stats.where(learn).join(marks, id_col).select("__stats", F.col("__y").alias("y"), fold.alias("fold"))
    model = fit(taught)
    schema = StructType(
        [docs.schema[c] for c in names] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )

    def run(batches):
        import pyarrow as pa

        for batch, x in _stats_batches(batches):
            score = model.score(x) if model else np.full(len(x), 0.5)
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
            )

    return stats.mapInArrow(run, schema)


def learn_rule(id_col: str = "doc_id") -> tuple[Column, Column]:
    """Rows that may teach, and their fold: remainder 0 fits, remainder 2 calibrates, remainder 1 is held out."""
    rest = crc32_mod(id_col, 3)
    return rest != 1, F.when(rest == 0, 0).otherwise(1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn, fold = learn_rule()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), learn, fold, ["doc_id"])
    held = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
