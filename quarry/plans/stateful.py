"""Stateful queries and page sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.plans.core import query
from quarry.sources import pages as pg
from quarry.streaming import ingest as ing
from quarry.streaming import limits as lim
from quarry.tables import shared_dir


@query()
def sliding_limiter(t):
    """Refused events leave no trace; tested against a plain loop."""
    return lim.sliding_limiter(t("events"), "user_id", "ts", "event_id", 3, 6 * 3600.0)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def answer_cache_upsert(t):
    return lim.latest(t("events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def newest_per_key(t):
    return lim.last_n(t("events"), "user_id", "ts", "event_id", 8).select("user_id", "event_id")


@query()
def ttl_cache(t):
    """Hits depend on the refills before them; tested against a plain loop."""
    return lim.within_ttl(t("events"), "user_id", "ts", "event_id", 12 * 3600)


@query("SELECT event_id, substr(sha256(event_type || chr(31) || CAST(user_id AS VARCHAR) || chr(31) || 'v1'), 1, 32) AS key FROM events")
def answer_cache_key(t):
    return t("events").select("event_id", lim.cache_key(F.col("event_type"), F.col("user_id").cast("string"), F.lit("v1")).alias("key"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(t):
    return t("pages").select("page_id", pg.raw_title(F.col("html")).alias("title"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""")
def page_links(t):
    return pg.links(t("pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#:]*\\.)?example\\.com([/?#:]|$)')")
def host_allowlist(t):
    return pg.allowed(t("pages"), ["example.com"]).select("page_id", "host")


@query("""SELECT page_id, lower(html) LIKE '%<html%' OR lower(html) LIKE '%<!doctype%' AS is_page, strlen(html) <= 20971520 AS small FROM pages""")
def page_check(t):
    return t("pages").select("page_id", pg.looks_like_page(F.col("html")).alias("is_page"), (F.octet_length("html") <= pg.MAX_BYTES).alias("small"))


@query()
def page_blocks(t):
    """Headed clauses of pages; tested against known pages."""
    return pg.clauses(t("pages"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, length(coalesce(text, ''))::INTEGER AS chars FROM documents")
def ingested_texts(t):
    """The documents' table as a stream of its files into a table that takes each text once; run twice, as a restart."""
    docs = t("documents")
    spark, out, state = docs.sparkSession, _folder(docs.sparkSession, "ingested"), _folder(docs.sparkSession, "ingest-state")
    folder, file = docs.inputFiles()[0].rsplit("/", 1)  # the table is a folder of files, or one file beside others
    glob = "*" if folder.endswith(".parquet") else file
    for _ in range(2):
        stream = ing.rows(spark, folder, docs.schema, F.col("text"), glob).select("sha256", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
        taken = ing.ingested(stream, out, state)
    return taken
