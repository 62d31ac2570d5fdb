"""Queries over product lists, protected spans and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import protect as pr
from quarry.operators import products as pd
from quarry.plans.core import query
from quarry.sources import manifest as mf

@query("SELECT doc_id, text AS back FROM documents")
def protect_round_trip(t):
    """restore(protect(text)) is the text."""
    held = t("documents").select("doc_id", pr.protect(F.col("text"), [r"\b[Tt]he\b", r"\d+"]).alias("p"))
    return held.select("doc_id", pr.restore(F.col("p.text"), F.col("p.spans")).alias("back"))


_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN regexp_replace(w, 's$', '') ELSE w END"


@query(f"""WITH q AS (SELECT * FROM (VALUES (0, ['red', 'widget']), (1, ['blue', 'bolt']), (2, ['steel'])) v(qid, words)),
p AS (SELECT p_partkey, p_name, list_distinct(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: {_STEM})) AS stems FROM part),
s AS (SELECT qid, p_partkey, p_name, len(list_intersect(stems, words)) AS o, len(words) AS n, len(stems) AS m FROM p, q),
sc AS (SELECT *, CASE WHEN o * 1.0::DOUBLE / n >= 0.7 THEN o * 1.0::DOUBLE / n + 0.5 * o / m ELSE 0 END AS score FROM s)
SELECT qid, p_partkey, p_name, round(score, 6) AS score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, p_name DESC, p_partkey DESC) <= 3""")
def product_probe(t):
    none = F.array().cast("array<string>")
    asked = t("part").sparkSession.createDataFrame([(0, ["red", "widget"]), (1, ["blue", "bolt"]), (2, ["steel"])], "qid int, words array<string>")
    found = pd.product_probe(asked.withColumn("extra", none).withColumn("context", none), t("part"), "p_name", "p_partkey")
    return found.select("qid", "p_partkey", "p_name", F.round("score", 6).alias("score"))


@query("""SELECT 0 AS qid, p_name FROM (SELECT DISTINCT p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])widgets?([^a-z0-9]|$)')) ORDER BY p_name LIMIT 2""")
def product_suggestions(t):
    asked = t("part").sparkSession.createDataFrame([(0, ["widget"])], "qid int, words array<string>")
    return pd.suggestions(asked, t("part"), "p_name")




@query("SELECT source AS file, initcap_title AS title, true AS needs_review FROM (SELECT DISTINCT source, upper(source[1]) || lower(source[2:]) AS initcap_title FROM documents) WHERE source NOT IN ('src0', 'src1')")
def manifest_drafts(t):
    files = t("documents").select(F.col("source").alias("file")).distinct()
    return mf.drafts(files, files.where("file IN ('src0', 'src1')"))
