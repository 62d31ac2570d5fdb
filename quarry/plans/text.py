"""Identifier, cleaning, sentence and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import cleaning as cl
from quarry.functions import sentences as st
from quarry.operators import chunking as ch
from quarry.operators import lines as ln
from quarry.plans.core import query


@query("""WITH l AS (SELECT p_brand AS doc_id, p_partkey % 4 + 1 AS page, p_partkey AS k, unnest(['Head of ' || p_brand, p_name || ' ' || p_partkey, 'Page ' || (p_partkey % 4 + 1), p_type || ' x@y.in on 1.2.3.4']) AS text FROM part),
key AS (SELECT *, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS key FROM l), pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
again AS (SELECT doc_id, key FROM key JOIN pages USING (doc_id) GROUP BY doc_id, key, pages HAVING pages >= 2 AND count(DISTINCT page) >= greatest(2, ceil(pages * 0.5)))
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE (doc_id, key) IN (SELECT (doc_id, key) FROM again) OR text LIKE 'Page %' OR text LIKE '%x@y.in%') AS removed FROM key GROUP BY doc_id""")
def strip_repeated_lines(t):
    page = F.col("p_partkey") % 4 + 1
    texts = F.array(F.concat(F.lit("Head of "), "p_brand"), F.concat_ws(" ", "p_name", "p_partkey"), F.concat(F.lit("Page "), page), F.concat("p_type", F.lit(" x@y.in on 1.2.3.4")))
    lines = t("part").select(F.col("p_brand").alias("doc_id"), page.alias("page"), F.explode(texts).alias("text"))
    return ln.stripped(lines).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("removed").alias("removed"))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"
_COST = f"CAST(floor({_WORDS} * 1.3::DOUBLE) AS INTEGER) + 1"


@query(f"SELECT doc_id, {_COST.format('text')} AS tokens FROM documents")
def approx_token_counts(t):
    return t("documents").select("doc_id", st.approx_tokens(F.col("text")).alias("tokens"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')) AS emails,
count(*) FILTER (WHERE regexp_matches(line, '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b')) AS addresses,
count(*) FILTER (WHERE regexp_matches(line, '(?i)\\b(licen[cs]ed to|supplied by|downloaded by|downloaded on|for internal use|single user licence|simulated licence line|printed by|purchased by)\\b')) AS marks
FROM l GROUP BY doc_id""")
def line_kinds(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = lambda p: F.count_if(F.col("line").rlike(p))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n"), hit(cl.EMAIL).alias("emails"), hit(cl.IP_ADDRESS).alias("addresses"), hit(cl.WATERMARK).alias("marks")
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT regexp_replace(lower(trim(line)), '\\d+', '#', 'g') AS key, count(DISTINCT doc_id) AS n FROM l
WHERE trim(line) <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3""")
def repeated_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    keys = lines.select("doc_id", cl.repeat_key(F.col("line")).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n >= 3")


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) - length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[\\x{0}-\\x{24F}]', '', 'g')) AS latin,
length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[\\x{0}-\\x{24F}]', '', 'g')) AS rest FROM documents""")
def script_counts(t):
    n = cl.script_counts(F.col("text"))
    return t("documents").select("doc_id", n["latin"].cast("long").alias("latin"), (n["devanagari"] + n["kannada"] + n["other"]).cast("long").alias("rest"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_exact(t):
    return t("documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS ord, array_to_string(w[i * 269 + 1 : i * 269 + 269], ' ') AS chunk
FROM w, LATERAL (SELECT unnest(range((len(w) + 268) // 269)) AS i)""")
def chunk_hard_split(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("w") / ch.CUT_WORDS).cast("int") - 1))
    cut = t("documents").withColumn("w", words).where(F.size("w") > 0).select("doc_id", "w", F.explode(starts).alias("ord"))
    return cut.select("doc_id", "ord", F.array_join(F.slice("w", F.col("ord") * ch.CUT_WORDS + 1, ch.CUT_WORDS), " ").alias("chunk"))


@query()
def chunk_pack(t):
    """Greedy packing depends on order; tested against its rules and a known case."""
    docs = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return ch.chunks(docs, ["doc_id"])


@query("""SELECT substr(sha256(array_to_string(list_append(list(h ORDER BY g), 'v1'), ',')), 1, 16) AS fingerprint
FROM (SELECT substr(g, 1, 3) AS g, sha256(array_to_string(list(g || h ORDER BY g || h), ',')) AS h FROM (
SELECT substr(s, 1, 6) AS g, sha256(array_to_string(list(s ORDER BY s), ',')) AS h FROM (SELECT sha256(text) AS s FROM documents) GROUP BY 1) GROUP BY 1)""")
def corpus_fingerprint(t):
    return ch.fingerprint(t("documents").select(F.sha2("text", 256).alias("sha256")), "v1")


@query("SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0')")
def incremental_missing(t):
    done = t("documents").where("source = 'src0'").select(F.sha1("text").alias("text_hash")).distinct()
    return ch.missing(t("documents"), done).select(F.md5("text").alias("text_md5"))


