"""Queries over the smaller steps; inputs derive from the tables, expected values from the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import cleaning as cl
from quarry.functions import identifiers as idn
from quarry.operators import chunking as ch
from quarry.operators import details as de
from quarry.operators import retrieval as rt
from quarry.operators import structure as st
from quarry.plans.core import query
from quarry.plans.patterns import _pick, _sql, key, number, pick, rows, size, year

c, s = F.concat, F.lit


@query("""WITH p AS (SELECT p_partkey, p_name, CAST(p_partkey % 900 + 100 AS VARCHAR) AS n, CAST(p_partkey % 60 + 1960 AS VARCHAR) AS y FROM part)
SELECT p_partkey, 'IS ' || n || ' ' || (length(p_name) + 2) || ' ' || (length(p_name) + 5 + length(n)) || '|IS 7' || n || ':' || y || ' ' || (length(p_name) + 5 + length(n) + 5) || ' ' || (length(p_name) + 5 + length(n) + 5 + 5 + length(n) + 4) AS got FROM p""")
def number_spans(t):
    spans = idn.number_spans(c("p_name", s(" IS "), number(), s(" and IS 7"), number(), s(":"), year()))
    return rows(t, F.array_join(F.transform(spans, lambda x: F.concat_ws(" ", x["number"], x["start"], x["end"])), "|"))


@query(_sql(_pick("true", "true", "false", "false")))
def number_matches(t):
    found = pick(c(s("IS "), number(), s(" (Part 2):"), year()), c(s("IS "), number(), s(":"), year()), c(s("IS "), number(), s("1")), "none")
    return rows(t, idn.number_matches(found, c(s("IS "), number())))


@query(_sql(_pick("true", "false", "false")))
def broken_devanagari(t):
    return rows(t, cl.is_broken_devanagari(pick(c(s("मा@न#क$ संख्या "), size()), c(s("मानक संख्या "), size()), F.col("p_name"))))


@query("""WITH l AS (SELECT p_brand AS doc_id, p_size % 3 AS page, p_partkey % (2 + p_size % 3) = 0 AS bad FROM part)
SELECT doc_id, CAST(page AS INTEGER) AS page, count(*) FILTER (WHERE bad) > 0.5 * count(*) AS garbled FROM l GROUP BY doc_id, page""")
def garbled_pages(t):
    line = F.when(key() % (F.col("p_size") % 3 + 2) == 0, c(s("ªvÈa ¶ÆbÐ ªªªª "), number())).otherwise(c(s("plain words of "), "p_name"))
    lines = t("part").select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 3).cast("int").alias("page"), line.alias("text"))
    return st.garbled_pages(lines)


@query(_sql(_pick("true", "false", "true")))
def unreadable_lines(t):
    return rows(t, st.unreadable(pick(c(s("मानक संख्या भारतीय "), size()), F.col("p_name"), c(s("ªvÈa ¶ÆbÐ "), number()))))


@query("""WITH q AS (SELECT o_orderkey AS qid, o_custkey % 25 AS base, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1990 + o_orderkey % 30 AS INTEGER) END AS year FROM orders),
st AS (SELECT s_suppkey AS id, s_nationkey AS base, CASE WHEN s_suppkey % 4 = 0 THEN 'catalogue' ELSE 'standard' END AS kind, CAST(1990 + s_suppkey % 30 AS INTEGER) AS year FROM supplier)
SELECT q.qid, q.base, q.year, st.id FROM q LEFT JOIN st USING (base) QUALIFY row_number() OVER (PARTITION BY q.qid, q.base ORDER BY coalesce(q.year = st.year, false) DESC, kind = 'catalogue', st.year DESC NULLS LAST, id) = 1""")
def find_standards(t):
    o = F.col("o_orderkey")
    asked = t("orders").select(o.alias("qid"), (F.col("o_custkey") % 25).alias("base"), F.when(o % 3 == 0, (o % 30 + 1990).cast("int")).alias("year"))
    k = F.col("s_suppkey")
    known = t("supplier").select(k.alias("id"), F.col("s_nationkey").cast("long").alias("base"), F.when(k % 4 == 0, "catalogue").otherwise("standard").alias("kind"), (k % 30 + 1990).cast("int").alias("year"))
    return de.find_standards(asked, known)


@query(_sql(_pick("'requirements'", "'compare'", "'ask'")))
def rewritten_intents(t):
    return rows(t, de.rewritten_intent(pick("ask", "compare", "ask"), c(pick("testing of ", "testing of ", "colours of "), "p_name")))


@query(_sql("CASE WHEN p_partkey % 3 = 0 THEN 'x|y' WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'o|a|b|c' ELSE 'a|b|o|c' END ELSE '' END"))
def merged_scopes(t):
    explicit = F.when(key() % 3 == 0, F.array(s("x"), s("y"))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("p_size") % 2 == 0, "o")
    return rows(t, F.array_join(de.merged_scope(explicit, key() % 2 == 0, own, F.array(*map(F.lit, "abocd"))), "|"))


@query("""SELECT o_orderkey AS qid, CAST(i - 1 AS INTEGER) AS place, n_name AS slug, n_nationkey AS id FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS i FROM orders) JOIN nation ON n_nationkey = (o_orderkey * i) % 40""")
def scope_rows(t):
    names = t("nation").select(F.col("n_name").alias("slug"), F.col("n_nationkey").alias("id"))
    keys = t("orders").select(F.col("o_orderkey").alias("qid"), F.explode(F.array(s(1), s(2), s(3))).alias("i"))
    wide = keys.join(t("nation"), F.col("n_nationkey") == (F.col("qid") * F.col("i")) % 40, "left")
    scopes = wide.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n_name", s("unknown")).alias("name")))), lambda x: x["name"]).alias("slugs"))
    return de.scope_rows(scopes, names)


@query(_sql(_pick("'IS ' || n", "'DEMO-' || n")))
def number_phrases(t):
    return rows(t, de.number_phrase(pick("IS", "DEMO"), number()))


@query(_sql("'helmet glass/safety ' || CASE WHEN p_partkey % 2 = 0 THEN 'visor' ELSE 'lamp' END"))
def product_stems(t):
    found = de.product_terms(F.array(s("Helmets"), s("glass"), s("standards"), s("of")), F.array(s("safety helmets"), pick("visors", "Lamps")), F.array(s("standard")))
    got = t("part").select("p_partkey", found.alias("f"))
    return got.select("p_partkey", c(F.array_join("f.own", " "), s("/"), F.array_join("f.extra", " ")).alias("got"))


_STEMS = "list_distinct(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN regexp_replace(w, 's$', '') ELSE w END))"


@query(f"""WITH p AS (SELECT p_partkey, p_name, {_STEMS} AS st FROM part), v AS (SELECT *, len(list_intersect(st, ['red', 'widget'])) AS a, len(list_intersect(st, ['blue'])) AS b, len(st) AS m FROM p),
m AS (SELECT *, greatest(CASE WHEN a / 2.0 >= 0.7 THEN a / 2.0::DOUBLE + 0.5 * a / m ELSE 0 END, CASE WHEN b >= 0.7 THEN b + 0.5 * b / m ELSE 0 END) AS best FROM v)
SELECT p_partkey, round(CASE WHEN best > 0 AND contains(lower(p_name), 'blue bolt') THEN best + 0.3 ELSE best END, 6)::DOUBLE AS got FROM m""")
def product_matches(t):
    from quarry.operators.products import stems

    none = F.array().cast("array<string>")
    variants = F.array(F.array(s("red"), s("widget")), F.array(s("blue")))
    return rows(t, F.round(de.product_match(F.col("p_name"), stems(F.col("p_name")), variants, none, none, F.array(s("blue bolt"))), 6))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN '{"a": ' || o_custkey || '}' END AS payload FROM orders""")
def cached_answers(t):
    k = F.col("o_orderkey")
    payload = F.when(F.col("o_custkey") % 2 == 0, c(s('{"a": '), "o_custkey", s("}"))).otherwise("{broken")
    cache = t("orders").where(k % 3 == 0).select(k.alias("key"), payload.alias("payload"))
    return de.cached_answers(t("orders").select(k.alias("key")), cache)


@query(_sql(_pick("'{\"n\": ' || n || ', \"x\": {}}'", "'{\"n\": ' || n || '}'", "NULL", "NULL")))
def json_replies(t):
    return rows(t, de.json_in(pick(c(s('Here: ```json\n{"n": '), number(), s(', "x": {}}\n``` done')), c(s('<think>{"no": 1}</think>{"n": '), number(), s("}")), F.col("p_name"), "{broken")))


@query(_sql(_pick("'demo/pdf/f' || n || '.PDF'", "'raw/f' || n || '.pdf'", "'public/f' || n || '.pdf'", "NULL")))
def source_paths(t):
    return rows(t, de.source_path(pick("synthetic_demo", "standard", "order", "standard"), c(s("f"), number(), pick(".PDF", ".pdf", ".pdf", ".html"))))


@query(_sql(_pick("NULL", "'empty'", "'not a PDF file'", "NULL")))
def pdf_faults(t):
    return rows(t, de.pdf_fault(pick(c(s("%PDF-1.7 "), "p_name"), "", F.col("p_name"), c(F.col("p_type"), s(" %PDF-1.4"))).cast("binary")))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def unparsed_files(t):
    files = t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    cache = files.where("doc_id % 3 = 0").select(c(F.substring("sha256", 1, 16), s("-v2")).alias("name")).distinct()
    return de.unparsed(files, cache, "v2").select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 100 = 7)")
def pruned_vectors(t):
    stored = t("embeddings").select("vec_id", F.sha1(F.col("label").cast("string")).alias("text_hash"))
    return de.pruned_vectors(stored, stored.where("vec_id % 100 = 7")).select("vec_id")


@query("SELECT s_suppkey AS id, p_name AS product FROM supplier JOIN part ON s_suppkey % 50 = p_partkey % 50 WHERE p_partkey < 500")
def mentioned_by(t):
    base = lambda k: c(s("IS "), (k % 50 + 100).cast("string"))
    known = t("supplier").select(F.col("s_suppkey").alias("id"), base(F.col("s_suppkey")).alias("base"))
    listed = t("part").where("p_partkey < 500").select(c(s("see "), base(key()), s(" : "), year()).alias("number"), F.col("p_name").alias("product"))
    return de.mentioned_by(known, listed)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND contains(lower(o_orderpriority), 'g')")
def filtered_requirements(t):
    r = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("modality"), F.col("o_orderpriority").alias("topic"), F.col("o_orderpriority").alias("sentence"))
    return de.filtered_requirements(r, ("F", "P"), ("1-URGENT", "2-HIGH"), "G").select("o_orderkey")


_ANSWERS = "SELECT conv_id AS qid, arg_min(text, turn) AS summary, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS points FROM conversations GROUP BY conv_id"


def answers(t):
    texts = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return t("conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("summary"), texts("user").alias("points"), F.array().cast("array<string>").alias("gaps"))


@query(f"""WITH a AS ({_ANSWERS}) SELECT qid, 'summary' AS part, summary AS text FROM a WHERE summary <> '' UNION ALL
SELECT * FROM (SELECT qid, 'p' || (generate_subscripts(points, 1) - 1) AS part, unnest(points) AS text FROM a) WHERE text <> ''""")
def translation_parts(t):
    return de.parts_of(answers(t))


@query(f"""WITH a AS ({_ANSWERS}) SELECT qid, 'T: ' || summary AS summary, coalesce(array_to_string(list_transform(points, lambda x, i: CASE WHEN i = 1 THEN 'T: ' || x ELSE x END), '|'), '') AS points FROM a""")
def translated_answers(t):
    own = answers(t)
    done = de.parts_of(own).where("part in ('summary', 'p0')").withColumn("text", c(s("T: "), "text"))
    return de.rejoined(own, done).select("qid", "summary", F.array_join("points", "|").alias("points"))


@query("""SELECT 'f' || p_partkey AS file, CASE p_partkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'catalogue' ELSE 'guidance' END AS kind,
CASE WHEN p_size % 2 = 0 THEN 'M' || p_size ELSE 'D' || p_size END AS number, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE 'f' || p_partkey END AS title FROM part""")
def library_rows(t):
    z = F.col("p_size")
    files = t("part").select(
        c(s("f"), key()).alias("file"), pick("is", "list", "page").alias("doc_type"), F.when(z % 2 == 0, c(s("M"), size())).alias("manifest_number"), c(s("D"), size()).alias("detected_number"),
        F.when(z % 3 == 0, F.col("p_name")).alias("manifest_title"), F.when(z % 3 == 1, F.col("p_type")).alias("detected_title"),
    )
    return de.library_rows(files, {"is": "standard", "list": "catalogue"})


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS total FROM part")
def listed_totals(t):
    return de.with_total(t("part"), ["p_brand"]).select("p_partkey", "total")


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS ord, CASE i WHEN 0 THEN 'The ' || p_name || ' shall be clean and dry.' ELSE 'Tests of ' || p_type || ' should be made.' END AS sentence,
CASE i WHEN 0 THEN 'shall' ELSE 'should' END AS modality FROM part, (VALUES (0), (2)) v(i) WHERE p_size % 3 <> 0""")
def extracted_requirements(t):
    kind = F.when(F.col("p_size") % 3 == 0, "foreword").otherwise("requirement")
    text = c(s("The "), "p_name", s(" shall be clean and dry. It was made by hand once. Tests of "), "p_type", s(" should be made."))
    clauses = t("part").select("p_partkey", kind.alias("kind"), s("standard").alias("doc"), text.alias("text"))
    return ch.requirements(clauses, ["p_partkey"], "text", "kind", "doc")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS got FROM part")
def requirement_chunks(t):
    own = c(s("The  "), "p_name", s(" shall hold\n"), "p_type")
    wanted = F.when(key() % 3 == 2, "nowhere at all").otherwise(F.regexp_replace(own, r"\s+", " "))
    sentences = t("part").select(key().alias("clause"), s(0).alias("sid"), wanted.alias("sentence"))
    other = s("Another chunk of text.")
    both = F.when(key() % 3 == 0, F.array(own, own)).otherwise(F.array(other, own))
    pieces = t("part").select(key().alias("clause"), F.posexplode(both).alias("ord", "chunk"))
    return ch.linked_chunks(sentences, pieces, "clause").select(F.col("clause").alias("p_partkey"), F.col("chunk_ord").alias("got"))


@query("""SELECT p_partkey, '| Product | No |' || chr(10) || '|---|---|' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '| ' || p_name || ' | 1 |' ELSE chr(10) || '| ' || p_name || ' | 1 |' || chr(10) || '| other thing | 2 |' END AS got FROM part""")
def trimmed_rows(t):
    text = c(s("| Product | No |\n|---|---|\n| "), "p_name", s(" | 1 |\n| other thing | 2 |"))
    words = F.when(key() % 2 == 0, F.array(F.lower("p_name"))).otherwise(F.array(s("absent")))
    return rows(t, rt.trimmed_rows(text, words))
