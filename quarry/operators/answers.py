"""Answers from ranked passages: excerpts, points, verdicts, routing, merged lists, admission of compared cells.

A context is a DataFrame of passages keyed by qid with pos (rank order from 1); every operator works on all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.understanding import STOPWORDS

RERANK_MARGIN, DISCOVER_MARGIN, VECTOR_MARGIN, EXCERPT = 5.0, 3.0, 0.07, 320
# Kinds by how much they say what a standard is about, and those that say it least.
ABOUT = ("scope", "front", "foreword", "terminology", "requirement", "test_method", "table")
LAST = ("marking", "packing", "sampling", "annex")
REFUSED = ("insufficient_evidence", "out_of_scope")
FINES = r"(?iU)\b(fines?|penalt\w*|punish\w*|jail|imprison\w*|prosecut\w*|prices?|cost of|how much does|rate of)\b"
SERVICE_TOPICS = (
    (r"(?iU)\b(complain\w*|grievance|fake isi|misuse)\b", ("consumer", "complaint")),
    (r"(?iU)\b(hallmark\w*|huid|jewell?ery)\b", ("hallmark",)),
    (r"(?iU)\b(apply|application|get a bis|grant of licen[cs]e)\b", ("product certification", "grant of licence")),
    (r"(?iU)\b(lab|labs|laborator\w*|get (my )?product tested)\b", ("laborator", "lab ")),
)
#: Kinds of passages of a whole-document summary in order, and how many of each.
SUMMARY_KINDS = {
    "scope": 2, "requirement": 2, "table": 1, "test_method": 1, "marking": 1, "sampling": 1, "conformity": 1, "packing": 1,
    "faq": 4, "other": 3, "front": 1, "foreword": 1,
}
REFUSAL_OVERRIDE, DROPPED_MOST = 5.0, 0.3


def flat(text: Column) -> Column:
    """Blanks collapsed and cut off at both ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_sentences(text: Column, most: int = EXCERPT) -> Column:
    """Sentences from the start as long as they fit; the first one always counts, cut to the size."""
    parts = F.split(flat(text), r"(?<=[.;])\s+(?=[A-Z(•])")
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = acc["open"] & ((acc["out"] == "") | (F.length(acc["out"]) + F.length(part) <= most))
        longer = F.trim(F.concat(acc["out"], F.lit(" "), part))
        return F.struct(F.when(fits, longer).otherwise(acc["out"]).alias("out"), fits.alias("open"))

    return F.left(F.aggregate(parts, start, add, lambda acc: acc["out"]), F.lit(most))


def is_table(text: Column) -> Column:
    return text.contains("|---") | text.contains("| ---")


def snippet(text: Column, most: int = 600) -> Column:
    """At most so many characters, cut behind a word."""
    trimmed = F.trim(text, F.lit(" \t\n\r"))
    cut = F.regexp_replace(F.left(trimmed, F.lit(most)), r" [^ ]*$", "")
    return F.when(F.length(trimmed) <= most, trimmed).otherwise(F.concat(cut, F.lit(" …")))


def location(number: Column, heading: Column, manual: Column) -> Column:
    """Where a passage sits, in words; empty for front matter."""
    head = F.coalesce(heading, F.lit(""))
    return (
        F.when(number.startswith("Front") | (number == ""), "").when(number.startswith("Table"), "Table").when(number.startswith("Annex"), number)
        .when(number.startswith("§"), F.when(manual | (head == ""), F.concat(F.lit("Section "), F.substr(number, F.lit(2)))).otherwise(head))
        .when(number.rlike(r"^Q\d+$"), F.when(head != "", F.concat(F.lit("FAQ: "), head)).otherwise(F.concat(F.lit("FAQ "), F.substr(number, F.lit(2)))))
        .otherwise(F.concat(F.lit("Clause "), number))
    )


def pages(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(F.concat(F.lit("Pages "), first, F.lit("–"), last))


def source_label(*parts: Column) -> Column:
    """The parts that aren't empty, with a middle dot between them."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " · ")


def strong_context(context: DataFrame, margin: float = RERANK_MARGIN, keep_lists: bool = False) -> DataFrame:
    """Passages that aren't much weaker than the question's best: within the margin of the best rerank score, or where
    nothing is reranked near the best vector or among the first two of the lexical list."""
    of = Window.partitionBy("qid")
    top, best = F.max("rerank").over(of), F.max("vec").over(of)
    lists = (F.col("kind") == "list") if keep_lists else F.lit(False)
    ranked = F.col("rerank").isNull() | (F.col("rerank") >= top - margin) | lists
    near = F.coalesce(F.col("vec") >= best - VECTOR_MARGIN, F.lit(False)) | F.coalesce(F.col("lex_rank") <= 2, F.lit(False)) | lists
    return context.withColumn("__keep", F.when(top.isNotNull(), ranked).when(best.isNotNull(), near).otherwise(True)).where("__keep").drop("__keep")


def about_rank(kind: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(ABOUT) for x in (k, i)])
    return F.coalesce(F.element_at(ranks, kind), F.lit(7))


def one_per_standard(context: DataFrame, related: Column, limit: int = 6) -> DataFrame:
    """qid, id, place: up to three list rows, then the passage of each standard that best says what it is about.

    A standard that isn't related to the question is left out, unless none is: then the first one stays.
    """
    by_pos = Window.partitionBy("qid").orderBy("pos")
    lists = context.where("kind = 'list'").withColumn("__n", F.row_number().over(by_pos)).where("__n <= 3").select("qid", "id", F.lit(0).alias("part"), "pos")
    of = Window.partitionBy("qid", "std")
    marked = context.where("kind <> 'list'").withColumn("__rel", F.coalesce(related, F.lit(False))).withColumn("__first", F.min("pos").over(of))
    best = of.orderBy(F.col("kind").isin(*LAST), about_rank(F.col("kind")), "pos")
    each = marked.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    some, place = F.max("__rel").over(Window.partitionBy("qid")), F.row_number().over(Window.partitionBy("qid").orderBy("__first"))
    kept = each.withColumn("__some", some).withColumn("__at", place).where("__rel or (not __some and __at = 1)")
    both = lists.unionByName(kept.select("qid", "id", F.lit(1).alias("part"), F.col("__first").alias("pos")))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("part", "pos"))
    return both.withColumn("place", order).where(F.col("place") <= limit).select("qid", "id", "place")


def point_text(kind: Column, text: Column, label: Column, where: Column) -> Column:
    """An official list row as it reads, any other passage as "label — place: excerpt"."""
    row = (kind == "list") & text.startswith("Product: ")
    place = F.when(F.coalesce(where, F.lit("")) != "", F.concat(F.lit(" — "), where)).otherwise("")
    return F.when(row, F.substr(text, F.lit(10))).otherwise(F.concat(label, place, F.lit(": "), first_sentences(text)))


def point_quote(kind: Column, text: Column) -> Column:
    """The excerpt if it is the source's own wording; rows of tables and lists aren't."""
    return F.when(~is_table(text) & (kind != "list"), first_sentences(text))


def heads(text: Column, size: int = 4) -> Column:
    """Distinct beginnings of the words of a text that aren't stop words and are longer than two letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), lambda w: F.left(w, F.lit(size))))


def service_hit(question: Column, title: Column) -> Column:
    """Whether a passage's title is about the service that a question asks for."""
    hit = F.lit(False)
    for pattern, words in SERVICE_TOPICS:
        named = F.lit(False)
        for w in words:
            named = named | F.lower(title).contains(w)
        hit = hit | (question.rlike(pattern) & named)
    return hit


def possible_match(context: DataFrame, question: str = "question", title: str = "title", product_hit: str = "product_hit", k: int = 3) -> DataFrame:
    """(qid, possible): whether one of the first k passages is an official row or manual of the product asked about, or
    a page about the service asked for. Questions about fines and prices never have one."""
    list_row = F.col("kind") == "list"
    hit = F.col(product_hit) | (~list_row & service_hit(F.col(question), F.col(title)))
    able = (F.col("pos") <= k) & hit & ~F.col(question).rlike(FINES)
    return context.groupBy("qid").agg(F.coalesce(F.bool_or(able), F.lit(False)).alias("possible"))


def needs_product(intent: Column, scoped: Column, stems: Column) -> Column:
    return (intent == "applicability") & ~scoped & (F.size(stems) == 0)


def verdict_kind(answer_type: Column, product_question: Column, has_standard: Column, row_denotified: Column, status: Column) -> Column:
    """not_found, compulsory, not_compulsory, standard_only or info; null for a clarification. row_denotified is null
    where no official row matches."""
    off = F.coalesce(row_denotified, F.lit(False)) | F.coalesce(status == "denotified", F.lit(False))
    on = ~off & (F.coalesce(status == "yes", F.lit(False)) | (row_denotified.isNotNull() & ~F.coalesce(row_denotified, F.lit(False))))
    known = F.when(on, "compulsory").when(off, "not_compulsory").otherwise("standard_only")
    return (
        F.when(answer_type.isin(*REFUSED), "not_found").when(answer_type == "clarification", F.lit(None).cast("string"))
        .when(product_question & has_standard, known).otherwise("info")
    )


def verdicts(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """answers (qid, answer_type, product_question, has_standard, status) with verdict and row_id, the first matching
    official row of rows (qid, pos, id, denotified, matches)."""
    first = rows.where("matches").groupBy("qid").agg(F.min_by(F.struct("id", "denotified"), "pos").alias("row"))
    kind = verdict_kind(*(F.col(c) for c in ("answer_type", "product_question", "has_standard")), F.col("row.denotified"), F.col("status"))
    return answers.join(first, "qid", "left").select("*", kind.alias("verdict"), F.col("row.id").alias("row_id")).drop("row")


def merged_standards(validated: DataFrame, retrieved: DataFrame, most: int = 8) -> DataFrame:
    """(qid, slug, why, place): validated standards first, then retrieved ones of the two standard kinds, each once."""
    first = validated.select("qid", "slug", "why", F.lit(0).alias("part"), "pos")
    rest = retrieved.where(F.col("kind").isin("standard", "catalogue")).select("qid", "slug", F.lit(None).cast("string").alias("why"), F.lit(1).alias("part"), "pos")
    once = F.row_number().over(Window.partitionBy("qid", "slug").orderBy("part", "pos", F.col("why").asc_nulls_last()))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("part", "pos", "slug"))
    kept = first.unionByName(rest).withColumn("__n", once).where("__n = 1")
    return kept.withColumn("place", place).where(F.col("place") <= most).select("qid", "slug", "why", "place")


def route(
    intent: Column, needs: Column, gate_passed: Column, possible: Column, cached: Column, drafter: Column, draft_type: Column, top_rerank: Column
) -> Column:
    """Which answer is given. draft_type is null where drafting failed or its draft was rejected."""
    declined = F.coalesce(draft_type == "insufficient_evidence", F.lit(False))
    overruled = declined & (F.coalesce(top_rerank >= REFUSAL_OVERRIDE, F.lit(False)) | (~gate_passed & possible))
    return (
        F.when(intent == "out_of_scope", "out_of_scope").when(needs, "clarification").when(~gate_passed & ~possible, "insufficient_evidence")
        .when(cached, "cached").when(drafter & overruled, "extractive").when(drafter & draft_type.isNotNull(), "live").otherwise("extractive")
    )


def finalised(answer_type: Column, facts: Column, factual: Column) -> Column:
    """An answer to a factual question without a fact that stands has insufficient evidence."""
    return F.when(factual & (facts == 0), "insufficient_evidence").otherwise(answer_type)


def next_attempt(dropped: Column, total: Column, attempt: Column) -> Column:
    """accept, retry or give_up, by the share of points that the checks dropped."""
    share = F.when(total > 0, dropped / total).otherwise(0.0)
    return F.when(share <= DROPPED_MOST, "accept").when(attempt == 0, "retry").otherwise("give_up")


def correction(drops: DataFrame, most: int = 10) -> DataFrame:
    """(qid, message): the first drops (qid, pos, text, reason) of a draft in one line."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    line = F.concat("text", F.lit(": "), "reason")
    some = drops.withColumn("__n", place).where(F.col("__n") <= most).groupBy("qid")
    return some.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "; ").alias("message"))


def admitted_cells(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """Compared cells (aspect, side, cid, text) of which a citation belongs to the same aspect and side of the evidence."""
    return cells.join(evidence.select("aspect", "side", "cid").distinct(), ["aspect", "side", "cid"], "left_semi")


def admitted_differences(differences: DataFrame, evidence: DataFrame, most: int = 3) -> DataFrame:
    """Differences (pair, pos, cid: a row a citation) that cite both sides, the first few of each pair."""
    sides = differences.join(evidence.select("pair", "cid", "side").distinct(), ["pair", "cid"]).groupBy("pair", "pos").agg(F.count_distinct("side").alias("sides"))
    place = F.row_number().over(Window.partitionBy("pair").orderBy("pos"))
    return sides.where("sides = 2").withColumn("place", place).where(F.col("place") <= most).select("pair", "pos", "place")


def summary_context(passages: DataFrame, limit: int = 8) -> DataFrame:
    """(std, id, place): the passages that stand for a whole document: so many of each kind, in the order of kinds.
    Requirements and tests that are numbered headings only are passed over."""
    quota = F.create_map(*[F.lit(x) for k, n in SUMMARY_KINDS.items() for x in (k, n)])
    first = F.create_map(*[F.lit(x) for i, k in enumerate(SUMMARY_KINDS) for x in (k, i)])
    bare = F.col("kind").isin("requirement", "test_method") & F.coalesce(F.col("number").rlike(r"^\d+$"), F.lit(False))
    able = passages.where(F.col("kind").isin(*SUMMARY_KINDS) & ~bare)
    nth = F.row_number().over(Window.partitionBy("std", "kind").orderBy("ord"))
    some = able.withColumn("__n", nth).where(F.col("__n") <= F.element_at(quota, F.col("kind")))
    place = F.row_number().over(Window.partitionBy("std").orderBy(F.element_at(first, F.col("kind")), "ord"))
    return some.withColumn("place", place).where(F.col("place") <= limit).select("std", "id", "place")


def about_sentence(scope: Column, number: Column, title: Column, product: Column) -> Column:
    """What an entry without a usable scope covers; null for others."""
    manual = F.format_string("The official product manual for %s (%s): how samples are taken, which tests are done and what a licence covers.", number, title)
    listed = F.format_string("%s is the standard listed for %s in the official list. Its number and title are known, not its text.", number, F.coalesce(product, title))
    return F.when(scope == "product_manual", manual).when(scope == "metadata_only", listed)


def retry_after(raw: Column, most: float = 120.0) -> Column:
    """Seconds of "1m5s", "38.7s" or "12"; 20 where nothing is stated."""
    form = r"^\s*(?:(\d+)m)?(\d+(?:\.\d*)?|\.\d+)s?\s*$"
    minutes = F.coalesce(F.regexp_extract(raw, form, 1).try_cast("double"), F.lit(0.0))
    seconds = F.regexp_extract(raw, form, 2).try_cast("double")
    return F.when(seconds.isNull(), 20.0).otherwise(F.least(F.lit(most), minutes * 60 + seconds))


def requested(texts: Column, most: int, size: int) -> Column:
    """A request's texts that have 1 to `size` characters, at most `most` of them."""
    return F.slice(F.filter(texts, lambda t: F.length(t).between(1, size)), 1, most)


def neutral(text: Column, names: tuple[str, ...] = ("source", "sources", "question", "user")) -> Column:
    """Tags that look like the delimiters of a prompt become blanks."""
    return F.regexp_replace(text, rf"(?i)<\s*/?\s*(?:{'|'.join(names)})\b[^>]*>", " ")
