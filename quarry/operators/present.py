"""What an answer shows: assembled answers, citations, summaries, coverage, labels, requirement sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.answers import snippet

# Notices of answers without a model, scopes without the full text, the sheet's columns and words.
NOTICES = {"none": "notice.extractive_no_key", "quota": "notice.extractive_llm_quota", "failed": "notice.extractive_llm_failed"}
WITHOUT_TEXT = ("metadata_only", "product_manual")
SHEET = ("standard", "clause", "page", "modality", "requirement_verbatim", "interpretation", "status", "notes")
SHEET_NOTE = "Requirement statements extracted from {}, with clause references. This checklist is a study aid, not a certification or compliance determination."
SHEET_SAMPLE = "Synthetic demo data, not an Indian Standard."
SLUG = r"^[a-z0-9][a-z0-9-]{0,120}$"
MOST_STANDARDS, TITLE_CHARS = 8, 72


def extractive_answers(points: DataFrame, passages: DataFrame, standards: DataFrame) -> DataFrame:
    """(qid, citations, standards): what a question's answer without a model shows.

    points: qid, citations (array). passages: qid, cid, slug. standards: qid, pos, slug, kind, via. citations are those
    of the points; of the standards and catalogue entries, those of which a passage is shown and those that an official
    list gave, in order, eight at most. Questions are those with a standard or a point.
    """
    cited = points.select("qid", F.explode("citations").alias("cid")).distinct()
    shown = passages.join(cited, ["qid", "cid"], "left_semi").select("qid", "slug").distinct().withColumn("shown", F.lit(True))
    able = standards.where(F.col("kind").isin("standard", "catalogue")).join(shown, ["qid", "slug"], "left")
    able = able.where(F.col("shown") | (F.col("via") == "official_list"))
    held = able.groupBy("qid").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"]), 1, MOST_STANDARDS).alias("standards"))
    listed = cited.groupBy("qid").agg(F.array_sort(F.collect_list("cid")).alias("citations"))
    asked = standards.select("qid").union(points.select("qid")).distinct()
    none = F.array().cast("array<string>")
    out = asked.join(listed, "qid", "left").join(held, "qid", "left")
    return out.select("qid", F.coalesce("citations", none).alias("citations"), F.coalesce("standards", F.array().cast(held.schema["standards"].dataType)).alias("standards"))


def extractive_notice(model: Column, quota: Column) -> Column:
    """Why an answer has no summary: no model, its quota, or its failure."""
    return F.when(~model, NOTICES["none"]).when(quota, NOTICES["quota"]).otherwise(NOTICES["failed"])


def summaries(standards: DataFrame, clauses: DataFrame, requirements: DataFrame, key: str) -> DataFrame:
    """standards with clause_count and requirement_count, 0 where there are none."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    out = standards.join(count(clauses, "clause_count"), key, "left").join(count(requirements, "requirement_count"), key, "left")
    return out.fillna(0, ["clause_count", "requirement_count"])


def is_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike(SLUG), F.lit(False))


def citations(candidates: DataFrame, keep: list[str]) -> DataFrame:
    """keep, id, snippet, vector, fused, rerank, boosts of ranked passages (n, citation_id, text, vector, fused, rerank,
    boosts): scores are rounded to 4, 5 and 3 digits, half to even, boosts to 4 and without their total."""
    parts = F.transform_values(F.map_filter("boosts", lambda k, _: k != "total"), lambda _, v: F.bround(v, 4))
    return candidates.select(
        *keep, F.coalesce("citation_id", F.concat(F.lit("R"), F.col("n").cast("string"))).alias("id"), snippet(F.col("text")).alias("snippet"),
        F.bround("vector", 4).alias("vector"), F.bround("fused", 5).alias("fused"), F.bround("rerank", 3).alias("rerank"), parts.alias("boosts"),
    )


def scope_coverage(scope: DataFrame, standards: DataFrame, key: str, text_scope: str) -> DataFrame:
    """scope rows with their standard's columns, where its text isn't held in full."""
    return scope.join(standards.where(F.col(text_scope).isin(*WITHOUT_TEXT)), key)


def coverage_sentence(total: Column, full: Column, manual: Column, samples: Column, name: str) -> Column:
    """How many standards are known and of how many the text is held."""
    line = F.format_string(
        f"{name} currently covers %d standards (full text available for %d; official BIS product manual for %d; the rest by number and title from official BIS lists)",
        total, full, manual,
    )
    more = F.when(samples > 0, F.format_string(", plus %d sample documents (not official)", samples)).otherwise("")
    return F.concat(line, more, F.lit("."))


def searched_sentence(guidance: Column, manual: Column, full: Column, catalogue: Column) -> Column:
    return F.format_string(
        "Searched %d official BIS pages, documents and notifications, %d BIS product manuals, %d full-text standards and %d standards listed in official BIS lists.",
        guidance, manual, full, catalogue,
    )


def clause_anchor(number: Column) -> Column:
    return F.concat(F.lit("clause-"), F.regexp_replace(F.regexp_replace(number, "[^A-Za-z0-9]+", "-"), "^-|-$", ""))


def clause_link(slug: Column, number: Column) -> Column:
    """The address of a standard, or of one of its clauses."""
    encoded = F.replace(F.url_encode(number), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/standards/"), slug, F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("?tab=clauses&clause="), encoded)).otherwise(""))


def short_title(title: Column, most: int = TITLE_CHARS) -> Column:
    bare = F.regexp_replace(title, r"(?i)\s*\(synthetic demo document, not an Indian Standard\)\s*", "")
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most - 1)), F.lit("…"))).otherwise(bare)


def clause_title(number: Column, heading: Column) -> Column:
    """struct(num, text): a clause's number and heading as shown; words in place of a number join the heading."""
    worded = number.rlike("^[A-Za-z]") & ~number.rlike(r"^[A-H]-[0-9]") & ~number.rlike(r"^(Table|Q[0-9])")
    of = lambda num, text: F.struct(num.alias("num"), text.alias("text"))
    none = F.lit(None).cast("string")
    return (
        F.when(number == "Front", of(none, F.when(heading != "", heading).otherwise("Front matter")))
        .when(worded, of(none, F.when(heading != "", F.concat(number, F.lit(" — "), heading)).otherwise(number)))
        .otherwise(of(number, heading))
    )


def requirement_sheet(items: DataFrame) -> DataFrame:
    """(slug, ord, line) of the sheet of each standard's requirements, a CSV file by lines: a byte order mark and what
    the sheet is, whether its data are a sample, the columns, and a line for each requirement.

    items: slug, label, synthetic, ord, clause, page, modality, text. Cells with a comma, a quote or a line break are
    quoted.
    """
    cell = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    text = lambda c: cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
    said = F.upper(F.replace("modality", F.lit("_"), F.lit(" ")))
    rows = items.select("slug", "ord", F.concat_ws(",", text("label"), text("clause"), text("page"), cell(said), text("text"), F.lit(",,")).alias("line"))
    before, after = (F.lit(x) for x in SHEET_NOTE.split("{}"))
    heads = items.groupBy("slug").agg(F.first("label").alias("label"), F.bool_or("synthetic").alias("synthetic"))
    note = F.concat(F.lit("﻿"), cell(F.concat(before, F.col("label"), after)))
    lines = F.array(F.struct(F.lit(-3).alias("ord"), note.alias("line")), F.struct(F.lit(-2).alias("ord"), F.when(F.col("synthetic"), cell(F.lit(SHEET_SAMPLE))).alias("line")), F.struct(F.lit(-1).alias("ord"), F.lit(",".join(SHEET)).alias("line")))
    top = heads.select("slug", F.explode(lines).alias("x")).select("slug", F.col("x.ord").cast(items.schema["ord"].dataType).alias("ord"), "x.line").where("line is not null")
    return rows.unionByName(top)


def cut_at_word(text: Column, most: int, mark: str = "…") -> Column:
    """The text, or what is before the last blank of its first `most` characters, and the mark."""
    head = F.left(text, F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(mark)))


def short_product(text: Column, most: int = 70) -> Column:
    """A product's name up to a dash, a colon, a sentence's end or a part number."""
    return cut_at_word(F.trim(F.get(F.split(text, r"\s+[-–—:]\s+|\.\s|\(Part", 2), 0), F.lit(" .,")), most)


def short_category(text: Column, most: int = 80) -> Column:
    """A list's heading as a category: its first line with words, without a number or "List of" before it, and what
    stands before "(Quality Control)"."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 0), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(first, r"^\d+\.\s*", ""), r"(?i)^List of\s+", "")
    bare = F.trim(F.get(F.split(bare, r"\s*\(Quality Control\)", 2), 0))
    cut = F.regexp_replace(F.regexp_replace(F.left(bare, F.lit(most)), r" [^ ]*$", ""), r"[,;:-]+$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(cut, F.lit("…")))


def shorten_order(order: Column, most: int = 260) -> Column:
    return cut_at_word(order, most, " … (further amendment and extension orders are listed on the source page)")


def standing_standards(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(draft, pos, base, citations, reason): drafted standards (draft, pos, base, citations) with the citations that name
    a source (draft, cid) once each, and why one is dropped: its base isn't among the sources', or no citation stands.

    sources: draft, cid, bases (array of the base numbers that the source names).
    """
    held = sources.groupBy("draft").agg(F.collect_set("cid").alias("cids"), F.array_distinct(F.flatten(F.collect_list("bases"))).alias("known"))
    out = items.join(held, "draft", "left")
    valid = F.coalesce(F.array_distinct(F.filter("citations", lambda c: F.array_contains("cids", c))), F.array().cast("array<string>"))
    known = F.coalesce(F.array_contains("known", F.col("base")), F.lit(False))
    reason = F.when(~known, "standard not present in the sources").when(F.size(valid) == 0, "listed standard without a valid citation")
    return out.select("draft", "pos", "base", valid.alias("citations"), reason.alias("reason"))


def _attribute(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def source_blocks(passages: DataFrame, attributes: dict[str, str], text: str = "text") -> DataFrame:
    """(qid, block): a question's passages (qid, pos, text) as marked sources, in order: attributes (name: column) are
    escaped, and what looks like a mark in a text becomes a blank."""
    named = F.concat(*[F.concat(F.lit(f' {name}="'), _attribute(F.col(c)), F.lit('"')) for name, c in attributes.items()])
    clean = F.regexp_replace(text, r"(?i)</?\s*(source|sources|user_question|context|intent|system)\b[^>]*>", " ")
    one = passages.select("qid", "pos", F.concat(F.lit("<source"), named, F.lit(">\n"), clean, F.lit("\n</source>")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return one.groupBy("qid").agg(F.concat(F.lit("<sources>\n"), F.array_join(parts, "\n"), F.lit("\n</sources>")).alias("block"))


def suggested_questions(questions: DataFrame, phrases: DataFrame, products: DataFrame, padding: tuple[str, ...], most: int = 2) -> DataFrame:
    """(qid, place, question): other questions to ask: two for each official wording (qid, pos, phrase) of a question's
    product; without one, one for each product (qid, pos, product) that shares a word; padding fills the rest.

    Names meet once, by question, and only the first `most` different ones of a question are put into words.
    """
    named = lambda rows, rank, pos, text: rows.select("qid", F.lit(rank).alias("rank"), pos.cast("long").alias("pos"), text.cast("string").alias("text"))
    rows = named(phrases, 0, F.col("pos"), F.col("phrase")).unionByName(named(products, 1, F.col("pos"), short_product(F.col("product"), 60)))
    rows = rows.unionByName(named(questions, 2, F.lit(0), F.lit(None))).repartition("qid")
    by = Window.partitionBy("qid").orderBy("rank", "pos", "text")
    order = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("best", F.min("rank").over(order)).where("rank = best or rank = 2")
    # name0 is a question's first name, from its row on, name1 its first other one, and so on: one sort serves all.
    name, seen, names = F.struct("rank", "text"), F.lit(False), [f"name{k}" for k in range(most)]
    for k in names:
        rows = rows.withColumn(k, F.first(F.when(~seen, name), ignorenulls=True).over(order))
        seen = seen | F.coalesce(F.col(k) == name, F.lit(False))
    rows = rows.withColumns({f"{k}_before": F.lag(k).over(by) for k in names})
    rows = rows.where(" or ".join(f"({k} is not null and {k}_before is null)" for k in names)).select("qid", "rank", "pos", "text")
    first = F.collect_list(F.struct("rank", "pos", "text")).over(by.rowsBetween(Window.currentRow, most - 1))
    rows = rows.withColumns({"named": first, "n": F.row_number().over(by)}).where("n = 1")
    ask = lambda start, x: F.concat(F.lit(start), x["text"], F.lit("?"))
    applies, compulsory = (lambda x: ask("Which Indian Standard applies to ", x)), (lambda x: ask("Is BIS certification compulsory for ", x))
    worded = lambda x: F.when(x["rank"] == 0, F.array(applies(x), compulsory(x))).when(x["rank"] == 1, F.array(compulsory(x))).otherwise(F.array(*map(F.lit, padding)).cast("array<string>"))
    placed = F.transform("named", lambda x: F.transform(worded(x), lambda q, nth: F.struct(x["rank"], x["pos"], nth.alias("nth"), q.alias("question"))))
    asked = F.array_distinct(F.transform(F.array_sort(F.flatten(placed)), lambda q: q["question"]))
    return rows.select("qid", F.posexplode_outer(F.slice(asked, 1, most)).alias("place", "question")).where("place is not null").select("qid", (F.col("place") + 1).alias("place"), "question")


def lead_first(standards: DataFrame, lead: DataFrame) -> DataFrame:
    """standards (qid, pos, slug) with the question's lead (qid, slug) in front, added where it isn't among them."""
    led = lead.select("qid", F.lit(-1).cast(standards.schema["pos"].dataType).alias("pos"), "slug")
    rest = standards.join(lead, ["qid", "slug"], "left_anti").select("qid", "pos", "slug")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "slug"))
    return led.unionByName(rest).withColumn("place", place).select("qid", "place", "slug")


def newest_distinct(events: DataFrame, owner: str, key: str, ts: str, tie: str, most: int) -> DataFrame:
    """(owner, key, place): the last `most` distinct keys of each owner, newest first."""
    last = events.groupBy(owner, key).agg(F.max(F.struct(ts, tie)).alias("last"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("last")))
    return last.withColumn("place", place).where(F.col("place") <= most).select(owner, key, "place")


def reaffirmed(lines: DataFrame, doc: str, pages: int = 2) -> DataFrame:
    """(doc, reaffirmed): the year after "Reaffirmed" on the first pages (doc, page, line_no, text); null without one."""
    some = lines.where(F.col("page") <= pages).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))).alias("all"))
    said = F.array_join(F.transform("all", lambda x: x["text"]), " ")
    return some.select(doc, F.nullif(F.regexp_extract(said, r"(?i)Reaffirmed\s*(\d{4})", 1), F.lit("")).alias("reaffirmed"))
