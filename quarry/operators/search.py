"""Steps of a search besides the ranked lists: scopes, boosts, promotion, clause lookup, comparison, typed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MENTION = 0.02
# Aspects of a comparison with their kinds of clauses, and lead-ins that say nothing.
ASPECTS = {
    "Scope": ("scope",), "Definitions": ("terminology",), "Requirements": ("requirement",), "Test methods": ("test_method",),
    "Sampling & conformity": ("sampling", "conformity"), "Marking & labelling": ("marking",), "Packing": ("packing",),
    "Referenced standards": ("references",), "Amendments": ("amendment",),
}
BOILERPLATE = r"(?i)^(For the purpose of this (document|standard)|The following (documents|standards) contain provisions)"
FUNCTION_WORDS = (
    "main mai mein hoon hun hu hai hain ka ki ke ko kya kaunsa konsa kaun kaise kahan chahiye banata banate banati "
    "bechta bechte bechti mera meri mere apna liye zaroori zaruri jaruri lagega lagta karna karta karte se par aur "
    "bhi nahi nahin kyun kab"
).split()


def mentions(text: Column, phrases: Column) -> Column:
    """Whether a phrase stands in a text, not within a word and not before a digit."""
    return F.exists(phrases, lambda p: (p != "") & F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), p, F.lit(r"\E(?!\d)"))))


def with_mentions(scores: DataFrame, phrases: str = "phrases", text: str = "text", score: str = "score") -> DataFrame:
    """score raised once for each phrase of the question that the passage mentions."""
    hits = F.size(F.filter(phrases, lambda p: mentions(F.col(text), F.array(p))))
    return scores.withColumn("mention_boost", F.when(hits > 0, MENTION).otherwise(0.0)).withColumn(score, F.col(score) + MENTION * hits)


def placed_last(candidates: DataFrame, late: Column) -> DataFrame:
    """Positions with the rows in `late` behind all others, order kept otherwise."""
    order = Window.partitionBy("qid").orderBy(F.coalesce(late, F.lit(False)).cast("int"), "pos")
    return candidates.withColumn("__pos", F.row_number().over(order)).drop("pos").withColumnRenamed("__pos", "pos")


def promoted(candidates: DataFrame, probe: DataFrame, leading: Column) -> DataFrame:
    """(qid, id, pos): official rows (qid, id, rank) moved up.

    Where `leading` and the first candidate isn't the first official row, official rows come first. Otherwise those
    that aren't among the first three candidates come behind the first one.
    """
    marks = candidates.select("qid", "id", F.col("pos").alias("old"), leading.alias("__lead"))
    both = marks.join(probe.select("qid", "id", "rank"), ["qid", "id"], "full")
    of = Window.partitionBy("qid")
    lead = F.coalesce(F.max("__lead").over(of), F.lit(False))
    head = F.min_by("id", "old").over(of)
    best = F.min_by("id", "rank").over(of)
    first = lead & best.isNotNull() & head.isNotNull() & (head != best)
    moved = F.col("rank").isNotNull() & (first | F.col("old").isNull() | (F.col("old") > 3))
    part = F.when(first, F.when(moved, 0).otherwise(1)).otherwise(F.when(F.col("old") == 1, 0).when(moved, 1).otherwise(2))
    keyed = both.withColumn("__part", part).withColumn("__at", F.when(moved, F.col("rank")).otherwise(F.col("old")))
    return keyed.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("__part", "__at", "id")).alias("pos"))


def clause_lookup(refs: DataFrame, clauses: DataFrame, most: int = 6) -> DataFrame:
    """(qid, ref, id, place): clauses of the scoped standards (refs: qid, std, ref) with that number or below it.

    Met by the number itself and by each of its beginnings, so no pair without a common one is compared.
    """
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.lower(F.array_join(F.slice(parts, 1, n), ".")))
    by_number = clauses.withColumn("__ref", F.explode(F.array_distinct(above)))
    asked = refs.withColumn("__ref", F.lower(F.trim(F.regexp_replace("ref", r"\s+", " "))))
    found = asked.join(by_number, ["std", "__ref"])
    place = F.row_number().over(Window.partitionBy("qid", "ref").orderBy("ord", "id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("qid", "ref", "id", "place")


def scope_filter(scope: DataFrame, chunks: DataFrame) -> DataFrame:
    """scope (qid, std, number) with has_text, and hard: the question has a standard with text, so only those count."""
    held = chunks.select("std").distinct().withColumn("__has", F.lit(True))
    out = scope.join(held, "std", "left").withColumn("has_text", F.coalesce("__has", F.lit(False))).drop("__has")
    return out.withColumn("hard", F.max("has_text").over(Window.partitionBy("qid")))


def compare_passages(passages: DataFrame, most: int = 2) -> DataFrame:
    """(std, aspect, id, place): the first passages of each aspect that say something."""
    kinds = F.create_map(*[F.lit(x) for a, ks in ASPECTS.items() for k in ks for x in (k, a)])
    said = F.trim("text")
    able = passages.withColumn("aspect", F.element_at(kinds, F.col("kind"))).where(
        F.col("aspect").isNotNull() & (said != "") & ~(said.rlike(BOILERPLATE) & (F.length("text") < 140))
    )
    place = F.row_number().over(Window.partitionBy("std", "aspect").orderBy("ord"))
    return able.withColumn("place", place).where(F.col("place") <= most).select("std", "aspect", "id", "place")


def parameter_key(name: Column) -> Column:
    """A parameter's name without limits, footnotes and signs, for alignment."""
    out = F.regexp_replace(F.lower(name), r",?\s*\b(max|min|maximum|minimum)\b\.?", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\(as [^)]*\)", ""), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def aligned_parameters(a: DataFrame, b: DataFrame, most: int = 30) -> DataFrame:
    """(key, a, b, place): values (name, value, ord) of two tables by parameter, those of both first, then a's, then b's."""
    last = lambda d, s: d.groupBy(parameter_key(F.col("name")).alias("key")).agg(F.max_by("value", "ord").alias(s), F.min("ord").alias(f"at_{s}"))
    both = last(a, "a").join(last(b, "b"), "key", "full")
    part = F.when(F.col("at_a").isNotNull() & F.col("at_b").isNotNull(), 0).when(F.col("at_a").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy(F.lit(0)).orderBy("__part", F.coalesce("at_a", "at_b"))
    few = both.withColumn("__part", part).orderBy("__part", F.coalesce("at_a", "at_b")).limit(most)
    return few.withColumn("place", F.row_number().over(order)).select("key", "a", "b", "place")


def number_search(standards: DataFrame, typed_base: str | None, typed: str) -> DataFrame:
    """Standards whose base number is the one typed, or whose number contains what is typed."""
    hit = F.lower("number").contains(typed.lower())
    return standards.where(hit | (F.col("base") == typed_base) if typed_base else hit)


def paged(df: DataFrame, order: list, number: int, size: int = 20) -> tuple[DataFrame, int]:
    """One page (from 1) of at most 100 rows in an order that ends with a unique key, and how many rows there are."""
    size = min(size, 100)
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def scope_texts(clauses: DataFrame, most: int = 3, size: int = 800) -> DataFrame:
    """(std, scope): a standard's first scope clauses, or the beginning of its first clause that isn't a table."""
    some = clauses.where(F.col("text") != "")
    place = F.row_number().over(Window.partitionBy("std").orderBy("ord"))
    own = some.where("kind = 'scope'").withColumn("__n", place).where(F.col("__n") <= most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    scopes = own.groupBy("std").agg(joined.alias("__scope"))
    first = some.where("kind <> 'table'").groupBy("std").agg(F.left(F.min_by("text", "ord"), F.lit(size)).alias("__first"))
    return first.join(scopes, "std", "full").select("std", F.coalesce("__scope", "__first").alias("scope"))


def children(clauses: DataFrame) -> DataFrame:
    """(std, id, children): ids of each clause's children in order; none for a leaf."""
    below = clauses.where(F.col("parent").isNotNull()).groupBy("std", F.col("parent").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("children")
    )
    none = F.array().cast(clauses.select(F.array("id")).schema[0].dataType)
    return clauses.select("std", "id").join(below, ["std", "id"], "left").withColumn("children", F.coalesce("children", none))


def romanised_hindi(text: Column) -> Column:
    """ASCII only, with two function words or more that make up a quarter of the words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS)))
    return ~text.rlike(r"[^\x00-\x7F]") & (hits >= 2) & (hits >= F.size(words) * 0.25)


def expanded(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, key, extra): synonyms (key, extra array) whose key stands in a question (qid, text), with or without a
    plural s. They meet on the key's first word, so questions and keys aren't paired at random."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), F.lit(1))
    forms = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))))
    asked = questions.select("qid", F.lower("text").alias("__low"), F.explode(forms).alias("__word"))
    keyed = synonyms.withColumn("__word", F.regexp_extract("key", r"^(\w+)", 1))
    whole = F.regexp_like(F.col("__low"), F.concat(F.lit(r"(?<!\w)\Q"), F.col("key"), F.lit(r"\Es?(?!\w)")))
    return asked.join(keyed, "__word").where(whole).select("qid", "key", "extra").distinct()


def product_phrases(questions: DataFrame, products: DataFrame) -> DataFrame:
    """(qid, key, phrases): product keys in a question, longest first and without overlaps, plural endings included."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\w-]+)"), F.lit(1))
    forms = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "s$", "")), F.transform(words, lambda w: F.regexp_replace(w, "es$", ""))))
    asked = questions.select("qid", F.lower("text").alias("low"), F.explode(forms).alias("__word"))
    met = asked.join(products.withColumn("__word", F.regexp_extract("key", r"^([\w-]+)", 1)), "__word").drop("__word").distinct()
    size = F.length("key")
    places = F.filter(F.sequence(F.lit(1), F.length("low")), lambda i: F.substr(F.col("low"), i, size) == F.col("key"))
    tail = lambda i: F.regexp_extract(F.substr(F.col("low"), i + size), r"^(e?s)?(?![\w-])", 0)
    whole = lambda i: ((i == 1) | ~F.substr(F.col("low"), i - 1, F.lit(1)).rlike(r"[\w-]")) & F.substr(F.col("low"), i + size).rlike(r"^(e?s)?(?![\w-])")
    spans = F.transform(F.filter(places, whole), lambda i: F.struct((-size).alias("order"), F.col("key"), i.alias("start"), (i + size + F.length(tail(i))).alias("end"), F.col("phrases")))
    found = met.select("qid", F.explode(spans).alias("span")).groupBy("qid").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.slice("spans", 1, 0)

    def take(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["key"] == x["key"]) | ((x["start"] < t["end"]) & (t["start"] < x["end"])))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    return found.select("qid", F.explode(F.aggregate("spans", none, take)).alias("s")).select("qid", F.col("s.key").alias("key"), F.col("s.phrases").alias("phrases"))


def translated(questions: DataFrame, glossary: DataFrame, least: int = 3) -> DataFrame:
    """(qid, words): for each token its glossary words, by the token or the longest key that it begins with, then the
    Latin words and numbers of the question; repeated ones count once, whatever their case."""
    tokens_ = F.regexp_extract_all("text", F.lit(r"([\wऀ-ॿಀ-೿‌‍]+)"), F.lit(1))
    asked = questions.select("qid", F.posexplode(tokens_).alias("pos", "token"))
    size = F.length("token")
    heads = F.transform(F.sequence(F.lit(1), size), lambda n: F.left(F.col("token"), n))
    able = F.filter(heads, lambda h: (F.length(h) >= least) | (h == F.col("token")))
    met = asked.withColumn("key", F.explode(able)).join(glossary, "key")
    best = met.groupBy("qid", "pos").agg(F.max_by("words", F.length("key")).alias("words")).select("qid", F.col("pos").alias("at"), F.posexplode("words").alias("nth", "word"))
    latin = F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9\-]+|\d+)"), F.lit(1))
    own = questions.select("qid", F.lit(1 << 30).alias("at"), F.posexplode(latin).alias("nth", "word"))
    once = F.row_number().over(Window.partitionBy("qid", F.lower("word")).orderBy("at", "nth"))
    kept = best.unionByName(own).withColumn("__n", once).where("__n = 1")
    return kept.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "nth", "word"))), lambda x: x["word"]).alias("words"))


def search_terms(words: Column, most: int = 40) -> Column:
    """Terms of a lexical query: letters and digits only, each once whatever its case, the first ones."""
    clean = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{M}\p{N}_+ ]", "")), lambda w: F.trim(w) != "")
    new = lambda taken, w: (F.size(taken) < most) & ~F.exists(taken, lambda t: F.lower(t) == F.lower(w))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda taken, w: F.when(new(taken, w), F.concat(taken, F.array(w))).otherwise(taken))


def grouped_standards(passages: DataFrame, explicit: DataFrame) -> DataFrame:
    """(qid, std, score, ids, row_id, place): the standards of a question's ranked passages, best first.

    A passage scores its rerank score (else 100 times the fused one) less a hundredth a place, or where by_position
    holds 30 less its place. An official row scores by how well it matches, and not at all where it doesn't. Standards
    that the question names (explicit: qid, std) come first, also without a passage. passages: qid, std, id, pos,
    rerank, fused, is_list, match, by_position.
    """
    rank = F.col("pos") - 1
    plain = F.when(F.col("by_position"), 30.0 - rank).otherwise(F.coalesce("rerank", F.col("fused") * 100) - rank * 0.01)
    listed = F.when(F.col("by_position"), plain + 0.1 * F.col("match")).otherwise(plain - 0.5 + 2 * F.col("match"))
    able = passages.where(~F.col("is_list") | (F.coalesce("match", F.lit(0.0)) > 0))
    groups = able.withColumn("__score", F.when(F.col("is_list"), listed).otherwise(plain)).groupBy("qid", "std").agg(
        F.max("__score").alias("__best"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"),
        F.min_by("id", F.when(F.col("is_list"), F.col("pos"))).alias("row_id"),
    )
    named = explicit.select("qid", "std").distinct().withColumn("__named", F.lit(100.0))
    both = groups.join(named, ["qid", "std"], "full").withColumn("score", F.coalesce("__best", F.lit(0.0)) + F.coalesce("__named", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "std"))
    none = F.array().cast(groups.schema["ids"].dataType)
    return both.select("qid", "std", "score", F.coalesce("ids", none).alias("ids"), "row_id", place.alias("place"))
