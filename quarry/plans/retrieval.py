"""Retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as ev
from quarry.operators import retrieval as rt
from quarry.plans.core import ORACLE_SQL, query

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def questions(t):
    """The query set: every term of each document whose id is divisible by 100."""
    return t("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), rt.tokens(F.col("text")).alias("terms"))


def _bm25_sql(columns: dict[str, float], k: int, tail: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, unnest({_TOKENS.format(c)}) AS term, {w}::DOUBLE AS w FROM documents" for c, w in columns.items()
    )
    size = " + ".join(f"len({_TOKENS.format(c)})" for c in columns)
    return f"""
WITH questions AS (SELECT doc_id AS qid, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM documents WHERE doc_id % 100 = 0),
parts AS ({parts}),
tf AS (SELECT doc_id, term, sum(w) AS tf FROM parts WHERE term IN (SELECT term FROM questions) GROUP BY ALL),
dl AS (SELECT doc_id, {size} AS dl FROM documents),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END AS idf,
  avgdl FROM df, totals),
scores AS (SELECT qid, doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN idf USING (term) JOIN dl USING (doc_id) JOIN questions USING (term) GROUP BY qid, doc_id),
bm25 AS (SELECT qid, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores) WHERE rank <= {k})
{tail}"""


_OUT = "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25"


@query(_bm25_sql({"text": 1.0}, 40, _OUT))
def bm25_top40(t):
    return rt.bm25(t("documents"), questions(t), {"text": 1.0}).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql({"text": 1.0, "source": 4.0, "lang": 1.5}, 40, _OUT))
def bm25_weighted_columns(t):
    found = rt.bm25(t("documents"), questions(t), {"text": 1.0, "source": 4.0, "lang": 1.5})
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def vectors(t):
    """The query set: every row whose id is divisible by 100."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COSINE = f"""cosine AS (SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS qid, e.vec_id, {_DOT.format("e.embedding", "q.embedding")} AS score
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 40)"""


@query(f"WITH {_COSINE} SELECT qid, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM cosine")
def cosine_top40(t):
    return rt.cosine_topk(t("embeddings"), vectors(t)).select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


@query(f"""SELECT q.vec_id AS qid, e.vec_id, round({_DOT.format("e.embedding", "q.embedding")}, 5) AS score
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label = 1
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format("e.embedding", "q.embedding")} DESC, e.vec_id) <= 10""")
def cosine_filtered(t):
    return rt.cosine_topk(t("embeddings").where("label = 1"), vectors(t), 10).select("qid", "vec_id", F.round("score", 5).alias("score"))


@query(f"""SELECT vec_id, round(sqrt({_DOT.format("embedding", "embedding")}), 4) AS norm,
round(embedding[1]::DOUBLE / sqrt({_DOT.format("embedding", "embedding")}), 5) AS first FROM embeddings""")
def unit_vectors(t):
    return t("embeddings").select(
        "vec_id", F.round(F.sqrt(rt.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"),
        F.round(F.get(rt.normalized(F.col("embedding")), F.lit(0)), 5).alias("first"),
    )


_HYBRID = f""", {_COSINE},
fused AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
  SELECT qid, doc_id, rank FROM bm25 UNION ALL SELECT qid, vec_id, rank FROM cosine) GROUP BY qid, doc_id),
boosted AS (SELECT f.qid, f.doc_id, score + CASE WHEN d.lang = a.lang THEN 0.02::DOUBLE ELSE 0.0 END AS total
  FROM fused f JOIN documents d USING (doc_id) LEFT JOIN documents a ON a.doc_id = f.qid)
SELECT qid, doc_id, round(total, 6) AS total, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 9) DESC, doc_id) AS rank FROM boosted) WHERE rank <= 8"""


@query(_bm25_sql({"text": 1.0}, 40, _HYBRID))
def hybrid_retrieval(t):
    """BM25 and cosine lists, fused by reciprocal ranks, boosted by the question's language, best eight."""
    lexical = rt.bm25(t("documents"), questions(t), {"text": 1.0})
    near = rt.cosine_topk(t("embeddings"), vectors(t)).select("qid", F.col("vec_id").alias("doc_id"), "rank")
    fused = rt.rrf(lexical, near).join(t("documents").select("doc_id", "lang"), "doc_id")
    fused = fused.join(t("documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("asked_lang")), "qid", "left")
    own = F.col("lang") == F.col("asked_lang")
    out = rt.boosted(fused, F.lit("ask"), F.lit(""), F.array().cast("array<string>"), own)
    best = rt.ranked(out.withColumn("score", F.round("total", 9)), 8, "doc_id")
    return best.select("qid", "doc_id", F.round("total", 6).alias("total"), "rank")


@query(f"WITH {_COSINE} SELECT qid, label, max(round(score, 5)) AS best, min(rank) AS first_rank, count(*) AS n FROM cosine JOIN embeddings USING (vec_id) GROUP BY qid, label")
def group_best(t):
    found = rt.cosine_topk(t("embeddings"), vectors(t)).join(t("embeddings").select("vec_id", "label"), "vec_id")
    best = rt.grouped_best(found, "label", "vec_id")
    first = found.select("qid", F.col("vec_id").alias("first_id"), "rank")
    return best.join(first, ["qid", "first_id"]).select(
        "qid", "label", F.round("best", 5).alias("best"), F.col("rank").cast("long").alias("first_rank"), F.size("ids").cast("long").alias("n")
    )


@query("""WITH first AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
dims AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM first, range(1, 65) r(i) GROUP BY label, i),
norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM dims GROUP BY label),
pairs AS (SELECT a.label AS label, b.label AS other, sum(a.x * b.x) / any_value(na.norm * nb.norm) AS score
  FROM dims a JOIN dims b USING (i) JOIN norms na ON na.label = a.label JOIN norms nb ON nb.label = b.label
  WHERE a.label <> b.label GROUP BY a.label, b.label)
SELECT label, other, round(score, 3) AS score FROM pairs
QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, other) <= 5""")
def centroid_related(t):
    near = rt.related(rt.centroids(t("embeddings"), "label", "vec_id"), "label")
    return near.select(F.col("qid").alias("label"), "other", F.round("score", 3).alias("score"))


@query(f"""WITH {_COSINE} SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY late, rank) AS INTEGER) AS pos FROM (
SELECT c.*, CASE WHEN label % 2 = 1 AND sum(label % 2) OVER (PARTITION BY qid ORDER BY rank) > 3 THEN 1 ELSE 0 END AS late
FROM cosine c JOIN embeddings USING (vec_id))""")
def stray_demotion(t):
    found = rt.cosine_topk(t("embeddings"), vectors(t)).join(t("embeddings").select("vec_id", "label"), "vec_id").withColumnRenamed("rank", "pos")
    return rt.demoted(found, F.col("label") % 2 == 1).select("qid", "vec_id", "pos")


@query(f"""WITH {_COSINE} SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank > 16 THEN 1 ELSE 0 END,
CASE WHEN rank <= 16 THEN label + 20 * (CASE WHEN label = 3 THEN 0.02 ELSE 0.0 END) END DESC NULLS LAST, rank) AS INTEGER) AS pos
FROM cosine JOIN embeddings USING (vec_id)""")
def rerank_head(t):
    found = rt.cosine_topk(t("embeddings"), vectors(t)).join(t("embeddings").select("vec_id", "label"), "vec_id").withColumnRenamed("rank", "pos")
    boost = F.when(F.col("label") == 3, 0.02).otherwise(0.0)
    return rt.reranked_head(found, F.col("label").cast("double"), boost).select("qid", "vec_id", "pos")


@query()
def diversify(t):
    """Caps and token budget over the BM25 list; a fold, tested against a plain loop."""
    docs = t("documents").select("doc_id", "source", "lang", F.size(F.split("text", r"\s+")).alias("n_words"))
    found = rt.bm25(t("documents"), questions(t), {"text": 1.0}).join(docs, "doc_id")
    rows = found.select(
        "qid", F.col("rank").alias("pos"), F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.col("source").alias("clause"),
        F.lit(False).alias("is_list"), "n_words",
    )
    return rt.diversified(rows)


@query(f"""WITH {_COSINE}, truth AS (SELECT q.vec_id AS qid, e.vec_id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
ranks AS (SELECT t.qid, min(c.rank) AS rank FROM truth t LEFT JOIN cosine c ON c.qid = t.qid AND c.vec_id = t.vec_id AND c.rank <= 10 GROUP BY t.qid)
SELECT count(*) AS n, round_even(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_at_5,
round_even(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 3) AS mrr_at_10,
round_even(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 3) AS hit_at_1 FROM ranks""")
def ranking_metrics(t):
    found = rt.cosine_topk(t("embeddings"), vectors(t)).withColumnRenamed("vec_id", "id")
    a = vectors(t).join(t("embeddings").select(F.col("vec_id").alias("qid"), "label"), "qid").select("qid", "label")
    truth = a.join(t("embeddings").select(F.col("vec_id").alias("id"), "label"), "label").where("qid <> id").select("qid", "id")
    return ev.ranking_metrics(ev.hit_ranks(found, truth))


#: Earlier names of the same plans.
for _plan in (
    bm25_top40, bm25_weighted_columns, cosine_top40, cosine_filtered, hybrid_retrieval, group_best, stray_demotion, rerank_head,
    ranking_metrics,
):
    query(ORACLE_SQL[_plan.__name__], f"{_plan.__name__}_whole")(_plan)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN value END) AS p50,
min(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END) AS p95 FROM s GROUP BY event_type""")
def percentile_nearest(t):
    out = ev.nearest_rank(t("events"), ["event_type"], "value")
    return out.select("event_type", "p50", "p95")


@query("""WITH s AS (SELECT round(n_chars / 1000.0::DOUBLE, 3) AS score, quality = 1 AS answerable FROM documents JOIN labels USING (doc_id)),
th AS (SELECT DISTINCT round_even(score, 2) AS t FROM s UNION SELECT unnest([-8.0, -6.0, -4.0, -2.0, 0.0])),
r AS (SELECT t, count(*) FILTER (WHERE score < t AND NOT answerable) * 1.0::DOUBLE / count(*) FILTER (WHERE NOT answerable) AS refusal,
count(*) FILTER (WHERE score < t AND answerable) * 1.0::DOUBLE / count(*) FILTER (WHERE answerable) AS false_refusal FROM th, s GROUP BY t)
SELECT t AS threshold, round(refusal, 6) AS refusal, round(false_refusal, 6) AS false_refusal,
round(refusal - 2 * greatest(0, false_refusal - 0.1) - 0.5 * false_refusal, 6) AS score FROM r""")
def threshold_sweep(t):
    scores = t("documents").join(t("labels"), "doc_id").select(
        F.round(F.col("n_chars") / 1000.0, 3).alias("score"), (F.col("quality") == 1).alias("answerable")
    )
    out = ev.threshold_sweep(scores)
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("refusal", "false_refusal", "score")])


@query("""SELECT source, count(*) AS n, round_even(count(*) FILTER (WHERE quality = 0) * 1.0::DOUBLE / count(*), 3) AS refused,
round_even(count(*) FILTER (WHERE toxic = 1) * 1.0::DOUBLE / nullif(count(*) FILTER (WHERE quality = 1), 0), 3) AS false_rate
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def refusal_rates(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("source").agg(
        F.count("*").alias("n"), ev.ratio(F.count_if(F.col("quality") == 0), F.count("*")).alias("refused"),
        ev.ratio(F.count_if(F.col("toxic") == 1), F.count_if(F.col("quality") == 1)).alias("false_rate"),
    )
