"""Queries over ranked passages, questions, comparison and structure; passages and questions derive from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import answers as an
from quarry.operators import evaluation as ev
from quarry.operators import search as se
from quarry.operators import structure as st
from quarry.plans.core import query

KINDS = ("scope", "front", "foreword", "terminology", "requirement", "test_method", "table", "marking", "list")
_LIST = ", ".join(f"'{k}'" for k in KINDS)
#: Passages of 37 questions: every document is one, with a kind, scores and a place in its question's list.
_CTX = f"""ctx AS (SELECT doc_id % 37 AS qid, doc_id AS id, lang AS std, [{_LIST}][CAST(doc_id % 9 AS INTEGER) + 1] AS kind,
  CASE WHEN doc_id % 37 % 4 = 0 OR doc_id % 5 = 0 THEN NULL ELSE (n_chars % 1000) / 100.0::DOUBLE END AS rerank,
  (n_chars % 97) / 97.0::DOUBLE AS vec, doc_id % 11 AS lex_rank, source, text, n_chars,
  row_number() OVER (PARTITION BY doc_id % 37 ORDER BY doc_id) AS pos FROM documents)"""


def passages(t):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 9 + 1).cast("int"))
    none = (F.col("doc_id") % 37 % 4 == 0) | (F.col("doc_id") % 5 == 0)
    return t("documents").select(
        (F.col("doc_id") % 37).alias("qid"), F.col("doc_id").alias("id"), F.col("lang").alias("std"), kind.alias("kind"),
        F.when(~none, (F.col("n_chars") % 1000) / F.lit(100.0)).alias("rerank"), ((F.col("n_chars") % 97) / F.lit(97.0)).alias("vec"),
        (F.col("doc_id") % 11).alias("lex_rank"), "source", "text", "n_chars",
        F.row_number().over(Window.partitionBy(F.col("doc_id") % 37).orderBy("doc_id")).alias("pos"),
    )


_PARTS = """parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT doc_id,
  string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '([.;]) ([A-Z(•])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents)),
run AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) + greatest(i - 2, 0) AS before FROM parts),
stop AS (SELECT doc_id, min(i) AS i FROM run WHERE i > 1 AND before + length(part) > 320 GROUP BY doc_id),
excerpts AS (SELECT r.doc_id, left(string_agg(part, ' ' ORDER BY r.i), 320) AS excerpt FROM run r LEFT JOIN stop s USING (doc_id)
  WHERE s.i IS NULL OR r.i < s.i GROUP BY r.doc_id)"""


@query(f"WITH {_PARTS} SELECT doc_id, excerpt FROM excerpts")
def first_sentences(t):
    return t("documents").select("doc_id", an.first_sentences(F.col("text")).alias("excerpt"))


@query("""SELECT doc_id, CASE WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) <= 600 THEN trim(text, chr(32) || chr(9) || chr(10) || chr(13))
ELSE regexp_replace(left(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 600), ' [^ ]*$', '') || ' …' END AS snippet FROM documents""")
def snippets(t):
    return t("documents").select("doc_id", an.snippet(F.col("text")).alias("snippet"))


@query(f"""WITH {_CTX}, w AS (SELECT *, max(rerank) OVER (PARTITION BY qid) AS top, max(vec) OVER (PARTITION BY qid) AS best FROM ctx)
SELECT qid, id FROM w WHERE CASE WHEN top IS NOT NULL THEN rerank IS NULL OR rerank >= top - 3 OR kind = 'list'
ELSE vec >= best - 0.07::DOUBLE OR lex_rank <= 2 OR kind = 'list' END""")
def strong_context(t):
    return an.strong_context(passages(t), an.DISCOVER_MARGIN, keep_lists=True).select("qid", "id")


_ABOUT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(an.ABOUT)) + " ELSE 7 END"


@query(f"""WITH {_CTX}, lists AS (SELECT qid, id, 0 AS part, pos FROM ctx WHERE kind = 'list' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 3),
marked AS (SELECT *, n_chars % 3 = 0 AS rel, min(pos) OVER (PARTITION BY qid, std) AS first FROM ctx WHERE kind <> 'list'),
each_std AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY qid, std ORDER BY kind IN ('marking', 'packing', 'sampling', 'annex'), {_ABOUT}, pos) = 1),
kept AS (SELECT * FROM (SELECT *, bool_or(rel) OVER (PARTITION BY qid) AS any_rel, row_number() OVER (PARTITION BY qid ORDER BY first) AS spot FROM each_std) WHERE rel OR (NOT any_rel AND spot = 1)),
both_parts AS (SELECT * FROM lists UNION ALL SELECT qid, id, 1, first FROM kept)
SELECT qid, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS place FROM both_parts) WHERE place <= 6""")
def one_per_standard(t):
    return an.one_per_standard(passages(t), F.col("n_chars") % 3 == 0)


_LOC = """CASE WHEN number LIKE 'Front%' OR number = '' THEN '' WHEN number LIKE 'Table%' THEN 'Table' WHEN number LIKE 'Annex%' THEN number
WHEN number LIKE '§%' THEN CASE WHEN manual OR heading = '' THEN 'Section ' || substr(number, 2) ELSE heading END
WHEN regexp_matches(number, '^Q[0-9]+$') THEN CASE WHEN heading <> '' THEN 'FAQ: ' || heading ELSE 'FAQ ' || substr(number, 2) END ELSE 'Clause ' || number END"""
_NUMBERS = "['Front', 'Table 2', 'Annex B', '§3.1', 'Q7', '5.2', '']"


@query(f"""WITH r AS (SELECT p_partkey, {_NUMBERS}[CAST(p_partkey % 7 AS INTEGER) + 1] AS number, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS heading,
p_size % 2 = 0 AS manual, p_size AS a, p_size + p_partkey % 2 AS b, p_name FROM part)
SELECT p_partkey, concat_ws(' · ', 'Bureau', nullif(p_name, ''), nullif({_LOC}, ''), CASE WHEN a = b THEN 'Page ' || a ELSE 'Pages ' || a || '–' || b END) AS label FROM r""")
def source_labels(t):
    number = F.element_at(F.array(*map(F.lit, ("Front", "Table 2", "Annex B", "§3.1", "Q7", "5.2", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    heading = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    where = an.location(number, heading, F.col("p_size") % 2 == 0)
    first, last = F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey") % 2).cast("string")
    return t("part").select("p_partkey", an.source_label(F.lit("Bureau"), F.col("p_name"), where, an.pages(first, last)).alias("label"))


@query(f"""WITH {_PARTS}, {_CTX}, shown AS (SELECT * FROM ctx WHERE pos <= 6)
SELECT qid, id, CASE WHEN kind = 'list' AND text LIKE 'Product: %' THEN substr(text, 10) ELSE std || ' — ' || source || ': ' || excerpt END AS point,
CASE WHEN NOT (contains(text, '|---') OR contains(text, '| ---')) AND kind <> 'list' THEN excerpt END AS quote
FROM shown JOIN excerpts ON doc_id = id""")
def extractive_points(t):
    few = passages(t).where("pos <= 6")
    point = an.point_text(F.col("kind"), F.col("text"), F.col("std"), F.col("source"))
    return few.select("qid", "id", point.alias("point"), an.point_quote(F.col("kind"), F.col("text")).alias("quote"))


@query("""WITH q AS (SELECT conv_id AS qid, turn AS pos, text AS question FROM conversations WHERE role = 'user')
SELECT conv_id AS qid, bool_or(turn <= 3 AND (turn % 5 = 0 OR (turn % 2 = 1 AND ((regexp_matches(text, '(?i)\\b(apply|application|get a bis|grant of licen[cs]e)\\b') AND contains(lower('Product Certification ' || text), 'product certification'))
 OR (regexp_matches(text, '(?i)\\b(complain\\w*|grievance|fake isi|misuse)\\b') AND (contains(lower('Product Certification ' || text), 'consumer') OR contains(lower('Product Certification ' || text), 'complaint')))
 OR (regexp_matches(text, '(?i)\\b(hallmark\\w*|huid|jewell?ery)\\b') AND contains(lower('Product Certification ' || text), 'hallmark'))
 OR (regexp_matches(text, '(?i)\\b(lab|labs|laborator\\w*|get (my )?product tested)\\b') AND (contains(lower('Product Certification ' || text), 'laborator') OR contains(lower('Product Certification ' || text), 'lab '))))))
 AND NOT regexp_matches(text, '(?i)\\b(fines?|penalt\\w*|punish\\w*|jail|imprison\\w*|prosecut\\w*|prices?|cost of|how much does|rate of)\\b')) AS possible
FROM conversations GROUP BY conv_id""")
def possible_match(t):
    rows = t("conversations").select(
        F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.when(F.col("turn") % 2 == 1, "page").otherwise("list").alias("kind"),
        F.col("text").alias("question"), F.concat(F.lit("Product Certification "), "text").alias("title"), (F.col("turn") % 5 == 0).alias("product_hit"),
    )
    return an.possible_match(rows)


@query("""WITH rows_ AS (SELECT o_custkey AS qid, o_orderkey AS pos, o_orderkey AS id, o_orderstatus = 'F' AS denotified, o_orderkey % 3 = 0 AS matches FROM orders),
first AS (SELECT qid, arg_min(id, pos) AS id, arg_min(denotified, pos) AS denotified FROM rows_ WHERE matches GROUP BY qid),
a AS (SELECT c_custkey AS qid, ['answer', 'answer', 'clarification', 'insufficient_evidence', 'answer'][CAST(c_custkey % 5 AS INTEGER) + 1] AS answer_type,
 c_custkey % 7 <> 0 AS product_question, c_nationkey > 2 AS has_standard, CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'denotified' WHEN 2 THEN 'no' END AS status FROM customer)
SELECT a.qid, f.id AS row_id, CASE WHEN answer_type = 'insufficient_evidence' THEN 'not_found' WHEN answer_type = 'clarification' THEN NULL
WHEN product_question AND has_standard THEN CASE
 WHEN NOT coalesce(f.denotified, false) AND coalesce(status, '') <> 'denotified' AND (coalesce(status, '') = 'yes' OR f.denotified = false) THEN 'compulsory'
 WHEN coalesce(f.denotified, false) OR coalesce(status, '') = 'denotified' THEN 'not_compulsory' ELSE 'standard_only' END ELSE 'info' END AS verdict
FROM a LEFT JOIN first f USING (qid)""")
def verdicts(t):
    rows = t("orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").alias("denotified"), (F.col("o_orderkey") % 3 == 0).alias("matches"),
    )
    key = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("answer", "answer", "clarification", "insufficient_evidence", "answer")))
    asked = t("customer").select(
        key.alias("qid"), F.element_at(kinds, (key % 5 + 1).cast("int")).alias("answer_type"), (key % 7 != 0).alias("product_question"),
        (F.col("c_nationkey") > 2).alias("has_standard"), F.when(key % 4 == 0, "yes").when(key % 4 == 1, "denotified").when(key % 4 == 2, "no").alias("status"),
    )
    return an.verdicts(asked, rows).select("qid", "row_id", "verdict")


@query("""WITH v AS (SELECT l_orderkey AS qid, 's' || l_suppkey AS slug, l_returnflag AS why, 0 AS part, l_linenumber AS pos FROM lineitem WHERE l_linenumber <= 2),
r AS (SELECT l_orderkey AS qid, 's' || l_suppkey AS slug, NULL AS why, 1 AS part, l_linenumber AS pos FROM lineitem WHERE l_returnflag <> 'A'),
once AS (SELECT * FROM (SELECT * FROM v UNION ALL SELECT * FROM r) QUALIFY row_number() OVER (PARTITION BY qid, slug ORDER BY part, pos, why) = 1)
SELECT qid, slug, why, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, pos, slug) AS place FROM once) WHERE place <= 8""")
def merged_standards(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("qid"), F.concat(F.lit("s"), "l_suppkey").alias("slug"), F.col("l_returnflag").alias("why"), F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_returnflag") == "A", "guide").otherwise("standard").alias("kind"),
    )
    return an.merged_standards(rows.where("pos <= 2"), rows)


_FLAGS = "n_chars % 2 = 0 AS gate_passed, n_chars % 3 = 0 AS possible, doc_id % 11 = 0 AS cached, doc_id % 4 <> 0 AS drafter"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'out_of_scope' ELSE 'ask' END AS intent, doc_id % 13 = 0 AS needs, {_FLAGS},
CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'insufficient_evidence' ELSE 'answer' END AS draft, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (n_chars % 100) / 10.0::DOUBLE END AS top FROM documents)
SELECT doc_id, CASE WHEN intent = 'out_of_scope' THEN intent WHEN needs THEN 'clarification' WHEN NOT gate_passed AND NOT possible THEN 'insufficient_evidence' WHEN cached THEN 'cached'
WHEN drafter AND draft = 'insufficient_evidence' AND (coalesce(top, 0) >= 5 OR (NOT gate_passed AND possible)) THEN 'extractive' WHEN drafter AND draft IS NOT NULL THEN 'live' ELSE 'extractive' END AS route FROM d""")
def answer_routes(t):
    i, n = F.col("doc_id"), F.col("n_chars")
    draft = F.when(i % 6 == 1, "insufficient_evidence").when(i % 6 > 1, "answer")
    top = F.when(i % 7 != 0, (n % 100) / F.lit(10.0))
    intent = F.when(i % 17 == 0, "out_of_scope").otherwise("ask")
    return t("documents").select("doc_id", an.route(intent, i % 13 == 0, n % 2 == 0, n % 3 == 0, i % 11 == 0, i % 4 != 0, draft, top).alias("route"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority < '3' AND o_orderkey % 4 = 0 THEN 'insufficient_evidence' ELSE 'answer' END AS answer_type,
CASE WHEN o_orderkey % 10 <= 3 THEN 'accept' WHEN o_orderkey % 2 = 0 THEN 'retry' ELSE 'give_up' END AS step FROM orders""")
def finalised_answers(t):
    key = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey", an.finalised(F.lit("answer"), key % 4, F.col("o_orderpriority") < "3").alias("answer_type"),
        an.next_attempt(key % 10, F.lit(10), key % 2).alias("step"),
    )


@query("""WITH d AS (SELECT user_id AS qid, event_id AS pos, event_type AS text, CAST(event_id % 5 AS VARCHAR) AS reason FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10)
SELECT qid, string_agg(text || ': ' || reason, '; ' ORDER BY pos) AS message FROM d GROUP BY qid""")
def correction_messages(t):
    rows = t("events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), (F.col("event_id") % 5).cast("string").alias("reason"))
    return an.correction(rows)


@query("""WITH e AS (SELECT DISTINCT l_returnflag AS aspect, l_linestatus AS side, l_suppkey AS cid FROM lineitem WHERE l_quantity > 25)
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity <= 25 AND EXISTS (SELECT 1 FROM e WHERE aspect = l_returnflag AND side = l_linestatus AND cid = l_suppkey)""")
def admitted_cells(t):
    rows = t("lineitem").withColumns({"aspect": F.col("l_returnflag"), "side": F.col("l_linestatus"), "cid": F.col("l_suppkey")})
    return an.admitted_cells(rows.where("l_quantity <= 25"), rows.where("l_quantity > 25")).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT l_partkey AS pair, l_linenumber AS pos, count(DISTINCT l_linestatus) AS sides FROM lineitem GROUP BY 1, 2)
SELECT pair, pos, CAST(row_number() OVER (PARTITION BY pair ORDER BY pos) AS INTEGER) AS place FROM s WHERE sides = 2 QUALIFY place <= 3""")
def admitted_differences(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("pair"), F.col("l_linenumber").alias("pos"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cid"), F.col("l_linestatus").alias("side"))
    return an.admitted_differences(rows.drop("side"), rows.drop("pos"))


_QUOTA = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in an.SUMMARY_KINDS.items()) + " ELSE 0 END"
_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(an.SUMMARY_KINDS)) + " END"


@query(f"""WITH {_CTX}, p AS (SELECT source AS std, id, kind, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '4.' || id END AS number FROM ctx),
able AS (SELECT * FROM p WHERE NOT (kind IN ('requirement', 'test_method') AND regexp_matches(number, '^[0-9]+$')) AND {_QUOTA} > 0
 QUALIFY row_number() OVER (PARTITION BY std, kind ORDER BY id) <= {_QUOTA})
SELECT std, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY std ORDER BY {_ORDER}, id) AS place FROM able) WHERE place <= 8""")
def summary_context(t):
    number = F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("4."), "id"))
    rows = passages(t).select(F.col("source").alias("std"), "id", "kind", number.alias("number"), F.col("id").alias("ord"))
    return an.summary_context(rows)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The official product manual for N' || p_partkey || ' (' || p_name || '): how samples are taken, which tests are done and what a licence covers.'
WHEN 1 THEN 'N' || p_partkey || ' is the standard listed for ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END || ' in the official list. Its number and title are known, not its text.' END AS about FROM part""")
def about_sentences(t):
    scope = F.when(F.col("p_partkey") % 3 == 0, "product_manual").when(F.col("p_partkey") % 3 == 1, "metadata_only").otherwise("full_text")
    product = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return t("part").select("p_partkey", an.about_sentence(scope, F.concat(F.lit("N"), "p_partkey"), F.col("p_name"), product).alias("about"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN least(120.0::DOUBLE, (o_orderkey % 3) * 60 + (o_orderkey % 50) + 0.5::DOUBLE) WHEN 1 THEN (o_orderkey % 50) + 0.25::DOUBLE
WHEN 2 THEN least(120.0::DOUBLE, (o_orderkey % 300)::DOUBLE) ELSE 20.0::DOUBLE END AS seconds FROM orders""")
def retry_seconds(t):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.concat((k % 3).cast("string"), F.lit("m"), (k % 50).cast("string"), F.lit(".5s"))).when(k % 4 == 1, F.concat((k % 50).cast("string"), F.lit(".25s")))
        .when(k % 4 == 2, (k % 300).cast("string")).otherwise(F.lit("soon"))
    )
    return t("orders").select("o_orderkey", an.retry_after(raw).alias("seconds"))


@query("""WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(texts, lambda x: length(x) BETWEEN 1 AND 60)[1:3], '|') AS kept FROM l""")
def request_limits(t):
    lists = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return lists.select("conv_id", F.array_join(an.requested(F.col("texts"), 3, 60), "|").alias("kept"))


@query("SELECT page_id, regexp_replace(html, '(?i)<\\s*/?\\s*(?:title|nav|h1)\\b[^>]*>', ' ', 'g') AS neutral FROM pages")
def neutral_pages(t):
    return t("pages").select("page_id", an.neutral(F.col("html"), ("title", "nav", "h1")).alias("neutral"))


_HEADS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{0}], w)), lambda w: left(w, 4)))"


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_HEADS.format(', '.join(repr(w) for w in an.STOPWORDS))}), ' ') AS heads FROM conversations")
def word_heads(t):
    return t("conversations").select("conv_id", "turn", F.array_join(F.sort_array(an.heads(F.col("text"))), " ").alias("heads"))


# Search steps.
@query("""SELECT c_custkey, n_name, round(CASE WHEN c_custkey % 2 = 0 THEN 0.52::DOUBLE ELSE 0.5::DOUBLE END, 6) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def mention_boost(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("rules of "), "n_name", F.lit(" 5."))).otherwise(F.concat(F.lit("rules ofx"), "n_name", F.lit("7.")))
    rows = named.select("c_custkey", "n_name", text.alias("text"), F.array("n_name", F.lit("")).alias("phrases"), F.lit(0.5).alias("score"))
    return se.with_mentions(rows).select("c_custkey", "n_name", F.round("score", 6).alias("score"))


@query(f"WITH {_CTX} SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN source = 'src1' THEN 1 ELSE 0 END, pos) AS INTEGER) AS pos FROM ctx")
def foreign_demotion(t):
    return se.placed_last(passages(t), F.col("source") == "src1").select("qid", "id", "pos")


@query(f"""WITH {_CTX}, cand AS (SELECT qid, id, pos AS old FROM ctx WHERE pos <= 12), probe AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY n_chars, id) AS rank FROM ctx WHERE kind = 'list' AND pos % 2 = 0),
j AS (SELECT coalesce(c.qid, p.qid) AS qid, coalesce(c.id, p.id) AS id, old, rank FROM cand c FULL JOIN (SELECT * FROM probe WHERE rank <= 3) p ON c.qid = p.qid AND c.id = p.id),
w AS (SELECT *, qid % 2 = 0 AS lead, arg_min(id, old) OVER (PARTITION BY qid) AS head, arg_min(id, rank) OVER (PARTITION BY qid) AS best FROM j),
f AS (SELECT *, lead AND best IS NOT NULL AND head IS NOT NULL AND head <> best AS first FROM w),
m AS (SELECT *, rank IS NOT NULL AND (first OR old IS NULL OR old > 3) AS moved FROM f)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN first THEN CASE WHEN moved THEN 0 ELSE 1 END WHEN coalesce(old, 0) = 1 THEN 0 WHEN moved THEN 1 ELSE 2 END,
 CASE WHEN moved THEN rank ELSE old END, id) AS INTEGER) AS pos FROM m""")
def list_promotion(t):
    rows = passages(t)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("n_chars", "id"))
    probe = rows.where("kind = 'list' and pos % 2 = 0").withColumn("rank", rank).where("rank <= 3")
    return se.promoted(rows.where("pos <= 12"), probe, F.col("qid") % 2 == 0)


@query("""WITH cl AS (SELECT p_brand AS std, p_partkey AS id, (p_size % 5) || '.' || (p_partkey % 4) || '.' || (p_partkey % 3) AS number, p_partkey AS ord FROM part),
refs AS (SELECT DISTINCT n_nationkey AS qid, 'Brand#1' || (n_nationkey % 5 + 1) AS std, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey % 5 AS VARCHAR) ELSE n_nationkey % 5 || '.' || n_nationkey % 4 END AS ref FROM nation)
SELECT qid, ref, id, CAST(row_number() OVER (PARTITION BY qid, ref ORDER BY ord, id) AS INTEGER) AS place FROM refs r JOIN cl ON cl.std = r.std AND (cl.number = ref OR starts_with(cl.number, ref || '.')) QUALIFY place <= 6""")
def clause_lookup(t):
    n = F.col("n_nationkey")
    ref = F.when(n % 2 == 0, (n % 5).cast("string")).otherwise(F.concat_ws(".", n % 5, n % 4))
    refs = t("nation").select(n.alias("qid"), F.concat(F.lit("Brand#1"), (n % 5 + 1)).alias("std"), ref.alias("ref"))
    k = F.col("p_partkey")
    clauses = t("part").select(F.col("p_brand").alias("std"), k.alias("id"), F.concat_ws(".", F.col("p_size") % 5, k % 4, k % 3).alias("number"), k.alias("ord"))
    return se.clause_lookup(refs, clauses)


@query("""WITH s AS (SELECT l_orderkey AS qid, l_suppkey AS std FROM lineitem), h AS (SELECT s_suppkey AS std FROM supplier WHERE s_acctbal > 0)
SELECT qid, std, std IN (SELECT std FROM h) AS has_text, bool_or(std IN (SELECT std FROM h)) OVER (PARTITION BY qid) AS hard FROM s""")
def scope_filter(t):
    scope = t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("std"))
    return se.scope_filter(scope, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("std")))


_ASPECT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{a}'" for a, ks in se.ASPECTS.items() for k in ks) + " END"


@query(f"""WITH {_CTX} SELECT source AS std, {_ASPECT} AS aspect, id, CAST(row_number() OVER (PARTITION BY source, {_ASPECT} ORDER BY id) AS INTEGER) AS place FROM ctx
WHERE {_ASPECT} IS NOT NULL AND trim(text, ' ') <> '' AND n_chars <> 0 QUALIFY place <= 2""")
def compare_passages(t):
    return se.compare_passages(passages(t).select(F.col("source").alias("std"), "id", "kind", "text", F.col("id").alias("ord")))


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), ',?\\s*\\b(max|min|maximum|minimum)\\b\\.?', '', 'g'), '\\(as [^)]*\\)', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH p AS (SELECT p_name || ', Max. (as ' || p_type || ')' AS name, p_type AS value, p_partkey AS ord, p_size FROM part WHERE p_partkey <= 60),
a AS (SELECT {_KEY.format("name")} AS key, arg_max(value, ord) AS a, min(ord) AS at FROM p WHERE p_size < 35 GROUP BY 1),
b AS (SELECT {_KEY.format("name")} AS key, arg_max(value, ord) AS b, min(ord) AS at FROM p WHERE p_size > 15 GROUP BY 1),
j AS (SELECT coalesce(a.key, b.key) AS key, a, b, a.at AS aa, b.at AS ba FROM a FULL JOIN b ON a.key = b.key)
SELECT key, a, b, CAST(row_number() OVER (ORDER BY CASE WHEN aa IS NOT NULL AND ba IS NOT NULL THEN 0 WHEN aa IS NOT NULL THEN 1 ELSE 2 END, coalesce(aa, ba)) AS INTEGER) AS place FROM j QUALIFY place <= 30""")
def aligned_parameters(t):
    rows = t("part").where("p_partkey <= 60").select(
        F.concat("p_name", F.lit(", Max. (as "), "p_type", F.lit(")")).alias("name"), F.col("p_type").alias("value"), F.col("p_partkey").alias("ord"), "p_size"
    )  # two given documents' tables, which are small by nature
    return se.aligned_parameters(rows.where("p_size < 35"), rows.where("p_size > 15"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR lower(p_name) LIKE '%red%'")
def number_search(t):
    rows = t("part").select("p_partkey", F.col("p_brand").alias("base"), F.col("p_name").alias("number"))
    return se.number_search(rows, "Brand#12", "Red").select("p_partkey")


@query(f"""WITH {_CTX}, s AS (SELECT source AS std, string_agg(text, chr(10) || chr(10) ORDER BY id) AS scope FROM (
 SELECT * FROM ctx WHERE kind = 'scope' AND text <> '' AND source <> 'src2' QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 3) GROUP BY source),
f AS (SELECT source AS std, left(arg_min(text, id), 800) AS first FROM ctx WHERE kind <> 'table' AND text <> '' AND NOT (source = 'src2' AND kind = 'scope') GROUP BY source)
SELECT std, coalesce(scope, first) AS scope FROM f FULL JOIN s USING (std)""")
def scope_texts(t):
    rows = passages(t).where("not (source = 'src2' and kind = 'scope')")
    return se.scope_texts(rows.select(F.col("source").alias("std"), "kind", "text", F.col("id").alias("ord")))


@query("""SELECT n_nationkey AS id, coalesce((SELECT string_agg(CAST(c_custkey + 1000 AS VARCHAR), ' ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS children FROM nation
UNION ALL SELECT c_custkey + 1000, '' FROM customer""")
def clause_children(t):
    nodes = t("nation").select(F.lit(1).alias("std"), F.col("n_nationkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("ord")).unionByName(
        t("customer").select(F.lit(1).alias("std"), (F.col("c_custkey") + 1000).cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("parent"), F.col("c_custkey").cast("long").alias("ord"))
    )
    return se.children(nodes).select("id", F.array_join(F.transform("children", lambda x: x.cast("string")), " ").alias("children"))


# Questions that name nations, as plural or not.
_ASKED = "asked AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN 'kya ' || n_name || ' ke liye ' || c_mktsegment || ' chahiye' ELSE 'which ' || lower(n_name) || 's need ' || lower(c_mktsegment) || 'es' END AS text, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def asked(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hindi = F.concat_ws(" ", F.lit("kya"), "n_name", F.lit("ke liye"), "c_mktsegment", F.lit("chahiye"))
    english = F.concat(F.lit("which "), F.lower("n_name"), F.lit("s need "), F.lower("c_mktsegment"), F.lit("es"))
    return named.select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 3 == 0, hindi).otherwise(english).alias("text"), "n_name")


@query(f"WITH {_ASKED} SELECT qid, qid % 3 = 0 AS hindi FROM asked")
def romanised_hindi(t):
    return asked(t).select("qid", se.romanised_hindi(F.col("text")).alias("hindi"))


@query(f"""WITH {_ASKED} SELECT DISTINCT qid, lower(n.n_name) AS key, r_name AS extra FROM asked a, nation n JOIN region ON n.n_regionkey = r_regionkey
WHERE regexp_matches(lower(a.text), '(^|[^a-z0-9_])' || lower(n.n_name) || 's?($|[^a-z0-9_])')""")
def expanded_terms(t):
    synonyms = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("key"), F.array("r_name").alias("extra"))
    found = se.expanded(asked(t), synonyms)
    return found.select("qid", "key", F.get("extra", F.lit(0)).alias("extra"))


@query(f"""WITH {_ASKED}, keys AS (SELECT lower(n_name) AS key FROM nation UNION SELECT DISTINCT lower(c_mktsegment) FROM customer)
SELECT qid, key FROM asked, keys WHERE regexp_matches(lower(text), '(^|[^a-z0-9_-])' || key || '(e?s)?($|[^a-z0-9_-])')
AND NOT EXISTS (SELECT 1 FROM keys k WHERE length(k.key) > length(keys.key) AND contains(k.key, keys.key) AND contains(lower(text), k.key))""")
def product_wording(t):
    keys = t("nation").select(F.lower("n_name").alias("key")).union(t("customer").select(F.lower("c_mktsegment"))).distinct()
    return se.product_phrases(asked(t), keys.withColumn("phrases", F.array("key"))).select("qid", "key")


@query(f"""WITH {_ASKED}, tok AS (SELECT qid, w, i FROM (SELECT qid, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1) AS i FROM asked)),
g AS (SELECT lower(n_name) AS key, r_name AS word FROM nation JOIN region ON n_regionkey = r_regionkey),
best AS (SELECT qid, i AS spot, arg_max(word, length(key)) AS word FROM tok JOIN g ON starts_with(w, key) AND (length(key) >= 3 OR w = key) GROUP BY qid, i),
own AS (SELECT qid, 1000 + generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]+|[0-9]+'), 1) AS spot, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]+|[0-9]+')) AS word FROM asked),
once AS (SELECT * FROM (SELECT * FROM best UNION ALL SELECT * FROM own) QUALIFY row_number() OVER (PARTITION BY qid, lower(word) ORDER BY spot) = 1)
SELECT qid, string_agg(word, ' ' ORDER BY spot) AS words FROM once GROUP BY qid""")
def keyword_translation(t):
    glossary = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("key"), F.array("r_name").alias("words"))
    return se.translated(asked(t), glossary).select("qid", F.array_join("words", " ").alias("words"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '[^\\p{L}\\p{M}\\p{N}_+ ]', '', 'g')), lambda x: trim(x) <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(word) ORDER BY i) = 1)
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS terms FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 40) GROUP BY conv_id, turn""")
def search_terms(t):
    found = t("conversations").select("conv_id", "turn", F.array_join(se.search_terms(F.split("text", " ")), " ").alias("terms"))
    return found.where("terms <> ''")


# Structure.
@query("""WITH r AS (SELECT p_partkey, p_name, p_type, p_size % 2 = 0 AS bold, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' - ' || p_type WHEN 2 THEN p_name || ' shall be ' || p_type ELSE p_name END AS rest FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
 WHEN 1 THEN CASE WHEN bold THEN rest ELSE p_name END WHEN 2 THEN '' ELSE CASE WHEN bold THEN p_name ELSE '' END END AS heading,
CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN bold THEN '' ELSE p_type END WHEN 2 THEN rest ELSE CASE WHEN bold THEN '' ELSE rest END END AS body FROM r""")
def split_headings(t):
    k = F.col("p_partkey") % 4
    rest = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit(" - "), "p_type")).when(k == 2, F.concat("p_name", F.lit(" shall be "), "p_type")).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", st.split_heading(rest, F.col("p_size") % 2 == 0).alias("s")).select("p_partkey", "s.heading", "s.body")


@query("""SELECT n_nationkey AS node, CASE WHEN n_regionkey % 2 = 0 THEN chr(CAST(65 + n_regionkey AS INTEGER)) || '-3.' || n_nationkey ELSE '3.' || n_nationkey END AS qualified FROM nation
UNION ALL SELECT r_regionkey + 1000, CASE WHEN r_regionkey % 2 = 0 THEN 'Annex ' || chr(CAST(65 + r_regionkey AS INTEGER)) ELSE CAST(r_regionkey AS VARCHAR) END FROM region
UNION ALL SELECT c_custkey + 2000, CASE WHEN n_regionkey % 2 = 0 THEN chr(CAST(65 + n_regionkey AS INTEGER)) || '-3.' || n_nationkey || '.' || c_custkey ELSE '3.' || n_nationkey || '.' || c_custkey END FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def annex_numbers(t):
    region = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Annex "), F.char(F.col("r_regionkey") + 65))).otherwise(F.col("r_regionkey").cast("string"))
    row = lambda df, node, parent, number: df.select(F.lit(1).alias("doc_id"), node.cast("long").alias("node"), parent.cast("long").alias("parent"), number.alias("number"))
    nodes = row(t("region"), F.col("r_regionkey") + 1000, F.lit(None), region)
    nodes = nodes.unionByName(row(t("nation"), F.col("n_nationkey"), F.col("n_regionkey") + 1000, F.concat(F.lit("3."), "n_nationkey")))
    nodes = nodes.unionByName(row(t("customer"), F.col("c_custkey") + 2000, F.col("c_nationkey"), F.concat(F.lit("3."), "c_nationkey", F.lit("."), "c_custkey")))
    return st.annex_numbers(nodes).select("node", "qualified")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'IS ' || p_size || ': ' ELSE '' END || p_name || chr(10) || p_brand || chr(10) || p_type AS text FROM part")
def embed_texts(t):
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("IS "), "p_size"))
    return t("part").select("p_partkey", st.embed_text(number, F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


@query("""SELECT p_partkey, p_name AS term, p_type AS definition FROM part WHERE p_size % 3 <> 0""")
def terminology(t):
    k = F.col("p_size") % 3
    rows = t("part").select(
        "p_partkey", F.lit("terminology").alias("kind"), F.when(k == 0, 1).otherwise(2).alias("level"), F.when(k == 1, F.col("p_name")).otherwise("").alias("heading"),
        F.when(k == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" — "), "p_type")).alias("text"),
    )
    return st.terms(rows, ["p_partkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN ['January','February','March','April','May','June','July','August','September','October','November','December'][CAST(o_orderkey % 12 AS INTEGER) + 1] || ' ' || (1990 + o_orderkey % 30) END AS date,
left(o_orderpriority || CASE WHEN o_orderkey % 3 <> 0 THEN ' ' || ['January','February','March','April','May','June','July','August','September','October','November','December'][CAST(o_orderkey % 12 AS INTEGER) + 1] || ' ' || (1990 + o_orderkey % 30) ELSE '' END, 500) AS excerpt FROM orders WHERE o_orderkey % 2 = 0""")
def amendment_rows(t):
    k = F.col("o_orderkey")
    month = F.element_at(F.split(F.lit(st.MONTHS), r"\|"), (k % 12 + 1).cast("int"))
    text = F.when(k % 3 != 0, F.concat("o_orderpriority", F.lit(" "), month, F.lit(" "), (k % 30 + 1990).cast("string"))).otherwise(F.col("o_orderpriority"))
    rows = t("orders").select("o_orderkey", F.lit("amendment").alias("kind"), F.when(k % 2 == 0, 1).otherwise(2).alias("level"), F.lit("Amendment").alias("heading"), text.alias("text"))
    return st.amendments(rows, ["o_orderkey"])


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '-' || n ELSE p_brand END AS slug FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_slugs(t):
    return st.unique_slugs(t("part"), "p_brand", "p_partkey").select("p_partkey", F.col("unique_slug").alias("slug"))


@query("""WITH known AS (SELECT c_custkey AS base, c_mktsegment AS status, c_name AS source FROM customer WHERE c_custkey % 2 = 0),
rows_ AS (SELECT o_custkey AS base, o_orderstatus AS status, o_orderpriority AS source, o_orderpriority AS product, o_orderkey AS seq FROM orders),
last AS (SELECT base, arg_max(status, seq) AS status, arg_max(source, seq) AS source FROM rows_ GROUP BY base),
pr AS (SELECT base, string_agg(product, '|' ORDER BY seq) AS products FROM (SELECT base, product, min(seq) AS seq FROM rows_ GROUP BY base, product) GROUP BY base)
SELECT base, CASE WHEN l.base IS NOT NULL THEN l.status ELSE k.status END AS status, CASE WHEN l.base IS NOT NULL THEN l.source ELSE k.source END AS source, coalesce(products, '') AS products, k.base IS NULL AS added
FROM known k FULL JOIN last l USING (base) LEFT JOIN pr USING (base)""")
def catalogue_upsert(t):
    known = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("base"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("source"))
    rows = t("orders").select(
        F.col("o_custkey").alias("base"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"), F.col("o_orderpriority").alias("product"), F.col("o_orderkey").alias("seq")
    )
    return st.catalogue_upsert(known, rows).withColumn("products", F.array_join("products", "|"))


@query("SELECT l_orderkey, l_linenumber, (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = l_suppkey % 40) AS to_id FROM lineitem")
def resolved_references(t):
    refs = t("lineitem").withColumn("base", F.col("l_suppkey") % 40)
    return st.resolved(refs, t("supplier").select(F.col("s_nationkey").alias("base"), F.col("s_suppkey").alias("id"))).select("l_orderkey", "l_linenumber", "to_id")


@query("""WITH c AS (SELECT user_id AS doc_id, event_id AS row, event_type = 'click' AS is_header, event_type || user_id AS text, event_type AS number FROM events),
g AS (SELECT *, last_value(CASE WHEN is_header THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row) AS category FROM c)
SELECT doc_id, category, number, text AS product, min(row) AS row FROM g WHERE NOT is_header GROUP BY ALL""")
def catalogue_groups(t):
    cells = t("events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("row"), (F.col("event_type") == "click").alias("is_header"), F.concat("event_type", "user_id").alias("text"), F.col("event_type").alias("number")
    )
    return st.catalogue_groups(cells)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT *, CASE WHEN line_no % 4 = 1 THEN 14.0 WHEN line_no % 4 = 2 THEN 13.6 ELSE 9.0 END AS size, CASE WHEN line_no % 5 = 3 THEN 'N' || line_no END AS number FROM l WHERE line_no <= 40),
m AS (SELECT *, max(size) OVER (PARTITION BY doc_id) AS big FROM s)
SELECT doc_id, arg_min(number, line_no) FILTER (WHERE number IS NOT NULL AND line_no <= 15) AS number, left(coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (WHERE size >= big - 0.5 AND number IS NULL), ''), 300) AS title FROM m GROUP BY doc_id""")
def document_metadata(t):
    """First pages: forty lines each, with sizes and numbers by line."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("line_no", F.col("at") + 1).where("line_no <= 40")
    size = F.when(F.col("line_no") % 4 == 1, 14.0).when(F.col("line_no") % 4 == 2, 13.6).otherwise(9.0)
    number = F.when(F.col("line_no") % 5 == 3, F.concat(F.lit("N"), "line_no"))
    return st.metadata(lines.withColumn("size", size), number)


@query("""SELECT l_suppkey AS doc_id, margin FROM (SELECT l_suppkey, round_even(l_discount * 100, 0)::DOUBLE AS margin, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, margin) = 1""")
def left_margins(t):
    lines = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_discount") * 100).cast("double").alias("x0"))
    return st.left_margin(lines)


@query("""SELECT l_orderkey, l_linenumber, (l_quantity / 2.0::DOUBLE BETWEEN 4 AND 16) AND (l_linenumber / 2.0::DOUBLE BETWEEN 0 AND 3) AS inside FROM lineitem""")
def boxes_inside(t):
    zero = F.lit(0.0)
    inner = (zero, zero, F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"))
    return t("lineitem").select("l_orderkey", "l_linenumber", st.inside((F.lit(5.0), F.lit(1.0), F.lit(15.0), F.lit(2.0)), inner).alias("inside"))


# Evaluation.
@query(f"""WITH {_CTX}, r AS (SELECT qid, pos AS rank, source AS slug, (id % 4) || '.' || (id % 3) AS number, (id % 5) || ' ' || kind AS path FROM ctx),
e AS (SELECT DISTINCT qid, 'src' || (qid % 4) AS slug, CASE qid % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(qid % 4 AS VARCHAR) ELSE CAST(qid % 5 AS VARCHAR) END AS clause FROM ctx)
SELECT e.qid, min(rank) AS rank FROM e LEFT JOIN r ON r.qid = e.qid AND r.slug = e.slug AND rank <= 10 AND (clause IS NULL OR number = clause OR starts_with(number, clause || '.') OR starts_with(path, clause || ' ')) GROUP BY e.qid""")
def expected_ranks(t):
    i, q = F.col("id"), F.col("qid")
    rows = passages(t).select("qid", F.col("pos").alias("rank"), F.col("source").alias("slug"), F.concat_ws(".", i % 4, i % 3).alias("number"), F.concat_ws(" ", i % 5, "kind").alias("path"))
    clause = F.when(q % 3 == 1, (q % 4).cast("string")).when(q % 3 == 2, (q % 5).cast("string"))
    expected = rows.select("qid").distinct().select("qid", F.concat(F.lit("src"), q % 4).alias("slug"), clause.alias("clause"))
    return ev.expected_ranks(rows, expected).select("qid", F.col("rank").cast("long").alias("rank"))


@query("""WITH f AS (SELECT doc_id % 200 AS qid, lang AS fact FROM documents), a AS (SELECT doc_id AS qid, text FROM documents WHERE doc_id < 150)
SELECT f.qid, count(*) AS facts, count(*) FILTER (WHERE contains(lower(text), lower(fact))) AS hits FROM f LEFT JOIN a USING (qid) GROUP BY f.qid""")
def fact_hits(t):
    facts = t("documents").select((F.col("doc_id") % 200).alias("qid"), F.col("lang").alias("fact"))
    return ev.fact_hits(t("documents").where("doc_id < 150").select(F.col("doc_id").alias("qid"), "text"), facts)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size % 2 = 0 WHEN p_size % 2 = 0 THEN false WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 3 = 0 THEN p_size % 3 = 0
ELSE contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'widget') END AS good FROM part""")
def everyday_judge(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    number = F.when(k % 3 == 0, s % 3 == 0)
    return t("part").select("p_partkey", ev.judged(k % 7 == 0, s % 2 == 0, k % 5 == 0, number, F.col("p_name"), F.array(F.lit("red")), F.array(F.lit("widget"))).alias("good"))


@query("SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def medians(t):
    return t("events").groupBy("event_type").agg(F.median("value").alias("median"))


@query(f"""WITH {_CTX}, p AS (SELECT *, kind = 'list' AS is_list, (id % 4) / 4.0::DOUBLE AS match, qid % 2 = 0 AS by_position, vec / 10 AS fused FROM ctx WHERE pos <= 20),
s AS (SELECT *, CASE WHEN by_position THEN 30.0::DOUBLE - (pos - 1) ELSE coalesce(rerank, fused * 100) - (pos - 1) * 0.01::DOUBLE END AS plain FROM p WHERE NOT is_list OR match > 0),
g AS (SELECT qid, source AS std, max(CASE WHEN NOT is_list THEN plain WHEN by_position THEN plain + 0.1::DOUBLE * match ELSE plain - 0.5 + 2 * match END) AS best,
 string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids, arg_min(id, pos) FILTER (WHERE is_list) AS row_id FROM s GROUP BY qid, source),
n AS (SELECT DISTINCT qid, 'src' || (qid % 30) AS std FROM p WHERE qid % 3 = 0),
b AS (SELECT coalesce(g.qid, n.qid) AS qid, coalesce(g.std, n.std) AS std, coalesce(best, 0) + CASE WHEN n.qid IS NULL THEN 0 ELSE 100 END AS score, coalesce(ids, '') AS ids, row_id
 FROM g FULL JOIN n ON g.qid = n.qid AND g.std = n.std)
SELECT qid, std, round(score, 6) AS score, ids, row_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, std) AS INTEGER) AS place FROM b""")
def grouped_standards(t):
    rows = passages(t).where("pos <= 20").withColumns(
        {"is_list": F.col("kind") == "list", "match": (F.col("id") % 4) / F.lit(4.0), "by_position": F.col("qid") % 2 == 0, "fused": F.col("vec") / 10, "std": F.col("source")}
    )
    named = rows.where("qid % 3 = 0").select("qid", F.concat(F.lit("src"), F.col("qid") % 30).alias("std"))
    out = se.grouped_standards(rows, named)
    return out.select("qid", "std", F.round("score", 6).alias("score"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "row_id", "place")
