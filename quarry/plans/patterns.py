"""Identifier, cleaning, validation and list-row functions over texts that are put together from the tables' values.

The SQL puts the expected values together from the same values and never matches a pattern of the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import cleaning as cl
from quarry.functions import identifiers as idn
from quarry.functions import listrows as lr
from quarry.functions import protect as pr
from quarry.functions import sentences as se
from quarry.operators import chunking as ch
from quarry.operators import understanding as un
from quarry.operators import validation as val
from quarry.plans.core import query
from quarry.sources import manifest as mf


def key() -> Column:
    return F.col("p_partkey")


def number() -> Column:
    return (key() % 900 + 100).cast("string")


def year() -> Column:
    return (key() % 60 + 1960).cast("string")


def size() -> Column:
    return F.col("p_size").cast("string")


_P = "p AS (SELECT *, CAST(p_partkey % 900 + 100 AS VARCHAR) AS n, CAST(p_partkey % 60 + 1960 AS VARCHAR) AS y, CAST(p_size AS VARCHAR) AS s FROM part)"
c = F.concat
s = F.lit


def pick(*values) -> Column:
    """One of the values, in turn by key."""
    return F.element_at(F.array(*[F.lit(None).cast("string") if v is None else v if isinstance(v, Column) else F.lit(v) for v in values]), (key() % len(values) + 1).cast("int"))


def _pick(*values: str) -> str:
    return f"[{', '.join(values)}][CAST(p_partkey % {len(values)} AS INTEGER) + 1]"


def _sql(got: str) -> str:
    return f"WITH {_P} SELECT p_partkey, {got} AS got FROM p"


def rows(t, got: Column):
    return t("part").select("p_partkey", got.alias("got"))


def numbered():
    return (
        c(s("see IS "), number(), s(" (Part "), size(), s(") : "), year(), s(" now")), c(s("IS"), number(), s("(Part "), size(), s(")")), c(s("as is "), number(), s(" says")), c(s("IS / ISO "), number(), s(" : "), year()),
        c(s("DEMO "), number()), s("the value is 5 mg"), c(s("IS "), number(), s(" (Part "), size(), s(") (Sec 2)")), s(""),
    )


@query(_sql(_pick("'IS ' || n || ' (Part ' || s || '):' || y", "'IS ' || n || ' (Part ' || s || ')'", "'IS ' || n", "'IS/ISO ' || n || ':' || y", "'DEMO-' || n", "NULL", "'IS ' || n || ' (Part ' || s || ') (Sec 2)'", "NULL")))
def norm_standard_number(t):
    return rows(t, idn.canonical_number(pick(*numbered())))


@query(_sql("p_partkey % 4 = 0"))
def same_standard(t):
    own = c(s("IS "), number())
    return rows(t, idn.same_standard(pick(own, c(own, s(":"), year()), c(own, s(" (Part 1)")), s("none")), pick(c(own, s(":"), year()), c(own, s(":1900")), c(own, s(" (Part 2)")), own)))


@query(_sql("'is-' || n || '-part-' || s || '-' || y"))
def slugify(t):
    return rows(t, idn.slug(c(s("IS "), number(), s(" (Part "), size(), s("):"), year())))


@query(_sql("'IS ' || n || '|IS 99' || n || ':' || y"))
def find_all_numbers(t):
    return rows(t, F.array_join(idn.all_numbers(c(s("Compare IS "), number(), s(" and IS 99"), number(), s(":"), year(), s("; IS "), number(), s(" again."))), "|"))


@query("""WITH c AS (SELECT p_brand AS doc, p_partkey AS spot, CAST(300 + p_size AS VARCHAR) AS n FROM part)
SELECT doc, min(spot) AS spot, 'IS ' || n AS number FROM c WHERE n <> '307' GROUP BY doc, n""")
def first_references(t):
    clauses = t("part").select(F.col("p_brand").alias("doc"), s("IS 307:2001").alias("own"), key().alias("spot"), c(s("as in IS "), F.col("p_size") + 300, s(" above")).alias("text"))
    return ch.references(clauses, "doc", "own", "text", "spot")


VERBS = ("shall not", "shall", "should not", "should", "may", "must", "did")


@query(_sql(_pick("'shall_not'", "'shall'", "'should_not'", "'should'", "'may'", "'must'", "NULL")))
def modality(t):
    return rows(t, se.modality(c(s("The "), "p_name", s(" "), pick(*VERBS), s(" be kept dry."))))


@query(_sql("'Sample No. ' || n || ' of the ' || p_name || ' applies.|The value of the ' || p_type || ' shall be 2; so it is.'"))
def split_sentences(t):
    text = c(s("Sample No. "), number(), s(" of the "), "p_name", s(" applies.\nThe value of the "), "p_type", s(" shall be 2; so it is.\n\n| a | b |\n\nShort."))
    return rows(t, F.array_join(se.split_sentences(text), "|"))


@query(_sql(_pick("true", "true", "false", "false")))
def watermark_lines(t):
    return rows(t, cl.is_watermark(pick(c(s("Licensed to "), "p_name"), c(s("x@y.in dated "), year()), s("write to x@y.in"), F.col("p_name"))))


@query(_sql(_pick("true", "true", "true", "false")))
def page_number_lines(t):
    return rows(t, cl.is_page_number(pick(c(s("Page "), size()), c(s("- "), number(), s(" -")), c(size(), s(" of "), number()), F.col("p_name"))))


@query(_sql(_pick("true", "false", "true", "false")))
def gazette_lines(t):
    return rows(t, cl.is_gazette_noise(pick(s("PUBLISHED BY AUTHORITY"), F.col("p_name"), c(s("[PART II no. "), number()), c(s("part of "), "p_type"))))


@query(_sql("p_name || ' ' || p_type || ' office x'"))
def normalize_text(t):
    return rows(t, cl.normalize_text(c(s(" "), "p_name", s("​​"), "p_type", s(" \t oﬃce x­ "))))


@query(_sql("'requirements of ' || p_name || ' the part IEC- ' || s"))
def join_wrapped(t):
    return rows(t, cl.join_wrapped(F.array(s("require-"), c(s("ments of "), "p_name"), s("  "), s("the part"), s("IEC-"), size())))


@query(_sql(_pick("'scope'", "'test_method'", "'requirement'", "'marking'", "'other'")))
def heading_kind(t):
    return rows(t, cl.kind_for_heading(c(pick("1 Scope of", "Ways to Test", "Test Requirements of", "Labelling of", "Shape of"), s(" "), "p_name")))


@query(_sql("'| ' || p_name || ' | Limit |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_type || ' / ' || s || ' | ' || n || ' |' || chr(10) || '| ' || y || ' |  |'"))
def markdown_table(t):
    table = F.array(F.array("p_name", s("Limit")), F.array(c("p_type", s(" |  "), size()), number()), F.array(year()))
    return rows(t, cl.rows_to_markdown(table))


@query(_sql("CASE WHEN p_partkey % 90 + 2 <= 21 THEN CAST(p_partkey % 90 + 2 AS VARCHAR) ELSE array_to_string(list_transform(range((p_partkey % 90 + 20) // 20), lambda i: least(20, p_partkey % 90 + 1 - 20 * i) + 1), ',') END"))
def table_groups(t):
    groups = cl.split_table(F.sequence(s(1), (key() % 90 + 2).cast("int")), 20)
    return rows(t, F.array_join(F.transform(groups, lambda g: F.size(g).cast("string")), ","))


@query(_sql("p_partkey % 2 = 0"))
def legacy_font(t):
    return rows(t, cl.looks_like_legacy_font(pick(c(s("ªvÈa ¶ÆbÐ "), number()), c("p_name", s(" and "), "p_type"))))


@query(_sql(_pick("p_name", "'केवल हिंदी'", "p_type")))
def parallel_script(t):
    return rows(t, cl.strip_parallel_devanagari(pick(c(s("मानक संख्या "), "p_name"), "केवल हिंदी", F.col("p_type"))))


@query(_sql("'\"' || lower(p_name) || '\" - ' || lower(p_type) || ' containment'"))
def quote_norm(t):
    return rows(t, val.norm_text(c(s("“"), "p_name", s("”  — | "), "p_type", s(" contain-\nment. "))))


@query(_sql("n || '000|0.5|1' || n || '|' || s || '.25'"))
def number_support(t):
    return rows(t, F.array_join(val.numbers_in(c(s("Use "), number(), s(" 000 mg of IS 302 [C1], 0.50, 1,"), number(), s(" and "), size(), s(".250 kg"))), "|"))


_R = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 10 - 4 END"
_V = "(p_partkey % 11) / 10.0::DOUBLE"


@query(_sql(f"CASE WHEN p_partkey % 4 = 0 THEN 'none' WHEN p_partkey % 4 >= 2 AND coalesce({_R}, 0) >= 3 AND {_V} >= 0.8 THEN 'strong' WHEN coalesce({_R}, 0) >= 0 AND {_V} >= 0.5 THEN 'moderate' ELSE 'limited' END"))
def evidence_strength(t):
    relevance = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 10 - 4).cast("double")
    return rows(t, val.strength(key() % 4, relevance, (key() % 11) / s(10.0)))


_T = "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 9 - 5.5 END"
_C = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0::DOUBLE END"


@query(_sql(f"CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 7 = 0 THEN true WHEN {_T} IS NOT NULL THEN {_T} >= CASE WHEN p_size % 2 = 0 THEN -4 ELSE 1 END ELSE coalesce({_C} >= 0.62 AND (p_size % 2 = 0 OR (p_partkey % 13) / 13.0 >= 0.6), false) END"))
def gate(t):
    rerank = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 9 - s(5.5))
    cosine = F.when(F.col("p_size") % 5 != 0, (key() % 10) / s(10.0))
    return rows(t, val.gate(key() % 5, key() % 7 == 0, rerank, cosine, (key() % 13) / s(13.0), F.col("p_size") % 2 == 0))


_W = "list_distinct(list_transform(string_split(lower(p_name), ' '), lambda w: left(w, 5)))"


@query(_sql(f"round(len(list_filter({_W}, lambda w: contains(lower(p_type || ' and ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END), w))) / len({_W})::DOUBLE, 6)"))
def term_coverage(t):
    text = c("p_type", s(" and "), F.when(key() % 2 == 0, F.col("p_name")).otherwise(""))
    return rows(t, F.round(val.coverage(F.split("p_name", " "), text), 6))


@query(_sql("'see https://a.in/' || n || ' and  or https://a.in, not .'"))
def strip_addresses(t):
    text = c(s("see https://a.in/"), number(), s(" and http://b.org/"), year(), s(" or https://a.in, not https://c.in/"), size(), s("x."))
    return rows(t, F.regexp_replace(val.strip_addresses(F.regexp_replace(text, r"x\.$", " ."), F.array(s("https://a.in"))), r" \.$", "."))


def asked():
    return (
        s("hello"), c(s("Compare "), "p_name", s(" and "), "p_type"), c(s("what does clause 4."), size(), s(" say")), c(s("I make "), "p_name", s(", what now?")), c(s("explain "), "p_name"),
        c(s("testing of "), "p_name"), c(s("which standard covers "), "p_name"), c(s("what is "), "p_name"), c(s("what is the process for "), "p_name"), c(s("colours of "), "p_name"),
        c(s("ನನ್ನ ಉತ್ಪನ್ನ "), size()), c(s("ಯಾವ ಮಾನದಂಡ "), size()),
    )


@query(_sql(_pick(*[f"'{x}'" for x in "out_of_scope compare clause_lookup applicability summarize requirements discover define ask ask applicability discover".split()])))
def intent(t):
    return rows(t, un.intent(pick(*asked())))


@query(_sql(_pick("'en'", "'hi'", "'kn'", "'en'")))
def language(t):
    return rows(t, un.language(pick(F.col("p_name"), c(s("यह क्या है "), size()), c(s("ಇದು ಏನು "), size()), number())))


_STOP = ", ".join(f"'{w}'" for w in un.STOPWORDS)


@query(_sql(f"array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], lower(w))) || ['pH', n], '|')"))
def content_terms(t):
    return rows(t, F.array_join(un.content_terms(c(s("What is the "), "p_name", s(" of a "), "p_type", s("? pH "), number())), "|"))


@query(_sql(_pick("n || '.' || s || '|Table ' || s || '|Annex B'", "'A-' || s", "''")))
def clause_refs(t):
    return rows(t, F.array_join(un.clause_refs(pick(c(s("see clause "), number(), s("."), size(), s(" and Table "), size(), s(", Annex B")), c(s("sec. A-"), size()), "none")), "|"))


@query(_sql(_pick("NULL", "'unsupported number'", "'no citation'", "'quote not found'", "'sample and official mixed'", "'unknown standard'", "NULL", "NULL", "'unsupported clause'")))
def validated_points(t):
    one = lambda cid, text, clause, number, sample: F.struct(
        s(cid).alias("cid"), text.alias("text"), clause.alias("clause"), number.alias("number"), s(3).alias("page_start"), s(4).alias("page_end"), s(sample).alias("synthetic")
    )
    held = c(s("The "), "p_name", s(" shall not exceed 0."), number(), s(" mg in all."))
    both = F.array(one("C1", held, c(s("4."), size()), c(s("IS "), number(), s(":"), year()), False), one("C2", c(s("Other text on "), "p_type"), s("5"), s("DEMO-101"), True))
    sources = t("part").select(key().alias("draft"), F.explode(both).alias("x")).select("draft", "x.*")
    text = pick(
        c(s("At most 0."), number(), s(" mg.")), c(s("At most 7."), number(), s(" mg.")), "None is named.", "A quote is given.", "Both are named.", c(s("IS 9"), number(), s(" says so.")), c(s("See 4."), size(), s(" on page 3.")),
        c(s("As clause 4."), size(), s(" says.")), "As Annex Q says."
    )
    quote = pick(c(s("shall not exceed 0."), number()), None, None, "is strictly forbidden anywhere", None, None, c("p_name", s(" SHALL not exceed")), None, None)
    cites = F.split(pick("C1", "C1", "C9", "C1", "C1 C2", "C1", "C1", "C1", "C1"), " ")
    points = t("part").select(key().alias("draft"), s(0).alias("point"), text.alias("text"), quote.alias("quote"), cites.alias("citations"))
    return val.checked_points(points, sources).select(F.col("draft").alias("p_partkey"), F.col("drop").alias("got"))


def list_row():
    return (F.col("p_name"), c(s("IS "), number()), F.when(key() % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), pick("ISI", "CRS", "ISI"), pick("Goods (Quality Control) Order, 2020", None, "De-notified 2024"))


_TITLE = "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' — ' || p_type END"


@query(_sql(f"'Product: ' || p_name || ' · IS ' || n || {_TITLE} || " + _pick("' · Scheme-I ISI mark · Order: Goods (Quality Control) Order, 2020'", "' · Scheme-II CRS'", "' · Scheme-I ISI mark · Status: De-notified 2024'")))
def list_row_text(t):
    return rows(t, lr.format_row(*list_row()))


@query(_sql("p_name || '/IS ' || n || '/' || " + _pick("'Goods (Quality Control) Order, 2020/false'", "'/false'", "'De-notified 2024/true'")))
def list_row_parse(t):
    got = t("part").select("p_partkey", lr.parse_row(lr.format_row(*list_row())).alias("r"))
    return got.select("p_partkey", F.concat_ws("/", "r.product", "r.numbers", F.coalesce("r.order", s("")), F.col("r.denotified").cast("string")).alias("got"))


@query(_sql(_pick("p_type || ' QCO ' || y", "'CRS Order ' || y", "NULL")))
def order_names(t):
    return rows(t, lr.order_short(pick(c(s("1. "), "p_type", s(" (Quality Control) Order, "), year()), c(s("Goods (Compulsory Registration) Order, "), year()), "a letter")))


@query(_sql(_pick("'CRS'", "'ISI'", "'ISI'", "NULL")))
def list_scheme(t):
    return rows(t, lr.scheme_of(pick(c("p_name", s(" under Scheme-II")), c(s("Scheme-I list of "), "p_name"), "ISI Mark products", F.col("p_name"))))


@query(_sql("'⟦0⟧ limits ⟦1⟧ of ' || p_name || ' and ⟦2⟧ of ⟦3⟧'"))
def protect_terms(t):
    text = c(s("IS "), number(), s(":"), year(), s(" limits pH of "), "p_name", s(" and "), size(), s(" mg of IS "), number())
    return rows(t, pr.protect(text, [r"IS \d+(?::\d{4})?", r"\bpH\b", r"\d+ mg"])["text"])


@query(_sql(_pick("'DEMO-' || n || '|' || p_name || '|# Scope' || chr(10) || p_type", "'||' || p_name")))
def front_matter(t):
    text = pick(c(s("---\nnumber: DEMO-"), number(), s("\ntitle: \""), "p_name", s("\"\n---\n# Scope\n"), "p_type"), F.col("p_name"))
    got = t("part").select("p_partkey", mf.front_matter(text).alias("m"))
    value = lambda name: F.coalesce(mf.header_value(F.col("m.header"), name), s(""))
    return got.select("p_partkey", F.concat_ws("|", value("number"), value("title"), "m.body").alias("got"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS text FROM documents")
def composed_text(t):
    apart = F.replace(F.replace("text", s("é"), s("e\u0301")), s("ü"), s("u\u0308"))
    return t("documents").select("doc_id", cl.composed(apart).alias("text"))


_SUMMARY = ("'The ' || p_name || ' holds 0.' || n || ' mg [C1].'", "'It is of ' || p_type || ' [C2].'", "'Nothing is known. It ends.'", "''", "'The ' || p_name || ' holds 0.' || n || ' mg [C1]. Plain words follow here.'")


@query(_sql(_pick(*_SUMMARY)))
def checked_summaries(t):
    text = pick(
        c(s("The "), "p_name", s(" holds 0."), number(), s(" mg [C1]. It also holds 0.9"), number(), s(" mg [C1].")), c(s("It is of "), "p_type", s(" [C2]. There are 7 of them.")),
        "Nothing is known. It ends.[C9]", c(s("The one [C1] and the other [C2] differ.")), c(s("The "), "p_name", s(" holds 0."), number(), s(" mg [C1]. Plain words follow here. IS 9"), number(), s(" says more [C1].")),
    )
    one = lambda cid, body, sample: F.struct(s(cid).alias("cid"), body.alias("text"), s("4").alias("clause"), c(s("IS "), number()).alias("number"), s(3).alias("page_start"), s(4).alias("page_end"), s(sample).alias("synthetic"))
    both = F.array(one("C1", c(s("It holds 0."), number(), s(" mg.")), False), one("C2", F.col("p_type"), True))
    sources = t("part").select(key().alias("draft"), F.explode(both).alias("x")).select("draft", "x.*")
    got = val.checked_summaries(t("part").select(key().alias("draft"), text.alias("text")), sources)
    return got.select(F.col("draft").alias("p_partkey"), F.col("summary").alias("got"))


@query(_sql("p_name || '|see IS ' || n || '|b|c|d|e'"))
def kept_items(t):
    items = F.array(c(s(" "), F.col("p_name"), s("  ")), c(s("see IS 8"), number()), s(""), c(s("see  IS "), number()), s("b"), s("c"), s("d"), s("e"), s("f"))
    return rows(t, F.array_join(val.kept_items(items, F.array(c(s("IS "), number()))), "|"))


@query("""SELECT * FROM (SELECT p_brand, p_type, 'both' AS level, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 60)
UNION ALL SELECT NULL, p_type, 'second', count(*) FROM part GROUP BY p_type""")
def top_facets(t):
    from quarry.operators.relations import facets

    return facets(t("part"), "p_brand", "p_type", 60)
