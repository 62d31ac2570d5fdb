"""Small steps around the main operators: scopes, caches, sources, typed filters, fan-out, product matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.identifiers import base_number
from quarry.operators.retrieval import product_score, stem
from quarry.operators.understanding import content_terms, intent

MAX_PDF = 50 * 1024 * 1024
#: Folders of source files by kind of document.
FOLDERS = {"synthetic_demo": "demo/pdf", "standard": "raw"}


def find_standards(asked: DataFrame, standards: DataFrame) -> DataFrame:
    """asked (qid, base, year) with id, the best standard of that base: of the year asked for if there is one, catalogue
    entries last, the newest first; null where the base is unknown."""
    # A base has one answer a year and one besides, so that a question meets two rows and not all standards of its base.
    order = (F.col("kind") == "catalogue", F.desc_nulls_last("year"), "id")

    def first(df: DataFrame, keys: list[str], order: tuple) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")

    known = standards.select("base", "id", "kind", "year")
    best = F.struct(F.col("kind").alias("kind"), F.col("year").alias("year"), F.col("id").alias("id"))
    exact = first(known.where("year is not null"), ["base", "year"], order).select("base", "year", best.alias("__exact"))
    other = first(known, ["base"], order).select("base", best.alias("__other"))
    met = asked.join(exact, ["base", "year"], "left").join(other, "base", "left")
    met = met.withColumn("__met", F.coalesce("__exact", "__other"))
    own = (F.col("__exact").isNull(), F.col("__met.kind") == "catalogue", F.desc_nulls_last("__met.year"), F.col("__met.id"))
    return first(met, ["qid", "base"], own).select("qid", "base", "year", F.col("__met.id").alias("id"))


def rewritten_intent(own: Column, english: Column) -> Column:
    """A rewritten question is classified anew only where nothing was recognised before."""
    return F.when(own == "ask", intent(english)).otherwise(own)


def rewritten_terms(question: Column, rewritten: Column, keywords: Column) -> Column:
    """struct(question, terms): a question's English form and its search terms, derived anew from it, with the keywords
    that came along; an empty form leaves the question as it was."""
    form = F.when(F.trim(F.coalesce(rewritten, F.lit(""))) != "", F.trim(rewritten)).otherwise(question)
    given = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k != "")
    return F.struct(form.alias("question"), F.concat(content_terms(form), given).alias("terms"))


def merged_scope(explicit: Column, wants_context: Column, open_slug: Column, focus: Column, most: int = 4) -> Column:
    """The standards that a question is about: those it names, else the open one and those in focus, if it refers to them."""
    first = F.when(open_slug.isNotNull(), F.array(open_slug)).otherwise(F.array().cast("array<string>"))
    context = F.slice(F.concat(first, F.filter(focus, lambda s: ~F.coalesce(s == open_slug, F.lit(False)))), 1, most)
    none = F.array().cast("array<string>")
    return F.when(F.size(explicit) > 0, explicit).when(wants_context, context).otherwise(none)


def scope_rows(scopes: DataFrame, standards: DataFrame) -> DataFrame:
    """(qid, place, slug, id): the known standards of scopes (qid, slugs), in order."""
    return scopes.select("qid", F.posexplode("slugs").alias("place", "slug")).join(standards.select("slug", "id"), "slug").select("qid", "place", "slug", "id")


def number_phrase(prefix: Column, number: Column) -> Column:
    """How a standard is named in running text."""
    return F.when(prefix == "DEMO", F.concat(F.lit("DEMO-"), number)).otherwise(F.concat_ws(" ", prefix, number))


def product_terms(content: Column, lexical: Column, generic: Column) -> Column:
    """struct(own, extra): stems of a question's content words without generic ones, and those that its expansion adds."""
    words = lambda ws: F.flatten(F.transform(ws, lambda w: F.regexp_extract_all(w, F.lit("([A-Za-z]{3,})"), F.lit(1))))
    stems = lambda ws: F.array_except(F.transform(words(ws), lambda w: stem(w)), generic)
    own = F.array_distinct(stems(content))
    return F.struct(own.alias("own"), F.array_except(stems(lexical), own).alias("extra"))


def product_match(name: Column, stems: Column, variants: Column, extra: Column, context: Column, phrases: Column) -> Column:
    """The best score of a product name over a question's variants, more where an official phrase stands in it."""
    best = F.array_max(F.transform(variants, lambda v: product_score(stems, v, extra, context)))
    flat = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    said = F.exists(phrases, lambda p: flat.contains(p))
    return F.when((best > 0) & said, best + 0.3).otherwise(F.coalesce(best, F.lit(0.0)))


def cached_answers(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (key) with payload, null at a miss; a payload that isn't JSON is a miss too."""
    sound = cache.where(F.try_parse_json("payload").isNotNull()).select("key", "payload")
    return asked.join(sound, "key", "left")


def json_in(text: Column) -> Column:
    """The JSON object in a model's reply, without thoughts and fences around it; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""), r"```[a-zA-Z]*", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def source_path(kind: Column, name: Column) -> Column:
    """Where the PDF of a document lies; null for other files."""
    folders = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return F.when(F.lower(name).endswith(".pdf"), F.concat_ws("/", F.coalesce(F.element_at(folders, kind), F.lit("public")), name))


def pdf_fault(content: Column) -> Column:
    """empty, too large or not a PDF file; null for a sound one."""
    head = F.substring(content, 1, 1024)
    marked = F.position(F.lit("%PDF-").cast("binary").cast("string"), F.decode(head, "ISO-8859-1")) > 0
    return F.when(F.length(content) == 0, "empty").when(F.length(content) > MAX_PDF, "too large").when(~marked, "not a PDF file")


def unparsed(files: DataFrame, cache: DataFrame, parser: str) -> DataFrame:
    """files (sha256) that no cache entry of this parser's version covers."""
    name = F.concat(F.substring("sha256", 1, 16), F.lit(f"-{parser}"))
    return files.withColumn("name", name).join(cache.select("name"), "name", "left_anti")


def pruned_vectors(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """Stored vectors (text_hash) of texts that are still there."""
    return vectors.join(live.select("text_hash").distinct(), "text_hash", "left_semi")


def mentioned_by(standards: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, product): list rows (number as written, product) that name a standard (id, base), met by the parsed base."""
    named = mappings.withColumn("base", base_number(F.col("number"))).where("base is not null")
    return standards.join(named, "base").select("id", "product")


def filtered_requirements(rows: DataFrame, modalities: Sequence[str] = (), topics: Sequence[str] = (), text: str = "") -> DataFrame:
    """Requirements (modality, topic, sentence) of the given kinds whose sentence contains the text."""
    if modalities:
        rows = rows.where(F.col("modality").isin(*modalities))
    if topics:
        rows = rows.where(F.col("topic").isin(*topics))
    return rows.where(F.lower("sentence").contains(text.lower())) if text else rows


def parts_of(answers: DataFrame) -> DataFrame:
    """(qid, part, text): what of an answer (qid, summary, points array, gaps array) is translated, by name of the part."""
    lists = F.concat(
        F.array(F.struct(F.lit("summary").alias("part"), F.col("summary").alias("text"))),
        F.transform("points", lambda x, i: F.struct(F.concat(F.lit("p"), i).alias("part"), x.alias("text"))),
        F.transform("gaps", lambda x, i: F.struct(F.concat(F.lit("g"), i).alias("part"), x.alias("text"))),
    )
    return answers.select("qid", F.explode(lists).alias("x")).select("qid", "x.*").where(F.coalesce("text", F.lit("")) != "")


def rejoined(answers: DataFrame, translated: DataFrame) -> DataFrame:
    """answers with the translated parts (qid, part, text) in their places; what has no translation stays."""
    maps = translated.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("part", "text"))).alias("__t"))
    out = answers.join(maps, "qid", "left")
    new = lambda part, old: F.coalesce(F.element_at(F.col("__t"), part), old)
    return out.select(
        "qid", new(F.lit("summary"), F.col("summary")).alias("summary"),
        F.transform("points", lambda x, i: new(F.concat(F.lit("p"), i), x)).alias("points"),
        F.transform("gaps", lambda x, i: new(F.concat(F.lit("g"), i), x)).alias("gaps"),
    )


def library_rows(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(file, kind, number, title): what a manifest says of a file before what was detected in it; kind by document type."""
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    kind = F.coalesce(F.element_at(table, F.col("doc_type")), F.lit("guidance"))
    return files.select("file", kind.alias("kind"), F.coalesce("manifest_number", "detected_number").alias("number"), F.coalesce("manifest_title", "detected_title", "file").alias("title"))


def with_total(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """df with total, how many rows its group has: the count that a page of a filtered list states."""
    return df.withColumn("total", F.count("*").over(Window.partitionBy(*group)))
