"""Checks of drafted statements against their cited passages, and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.identifiers import NUMBER_PATTERN, all_numbers, base_number
from quarry.operators.understanding import clause_refs

# What counts as a number, a citation and an address.
PLAIN_NUMBER = r"(?<![\w.])(\d{1,3}(?:[ ,]\d{3})+|\d+(?:\.\d+)?)(?![\w.]*\d)"
CITATION = r"\[(C\d{1,2})\]"
ADDRESS = r"https?://[^\s)\]>\"']+"
#: Quotes of one or two words that one scan of the passages looks for, and bits of the filter of longer ones at most.
MAX_BROADCAST_SHORT, FILTER_BITS = 100_000, 1 << 23
STRONG_MIN, MODERATE_MIN = 3.0, 0.0
GATE = {"reranked_live": -4.0, "reranked_extractive": 1.0, "cosine": 0.62, "coverage": 0.6}


def norm_text(text: Column) -> Column:
    """Quotes and dashes unified, lower case, line-break hyphens healed, table marks and blanks collapsed."""
    out = F.lower(F.translate(text, "“”„‘’‛–—‐‑ ", "\"\"\"'''---- "))
    out = F.regexp_replace(out, r"(\w)-\s+(\w)", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, r"[|*_`]", " "), r"\s+", " ")
    return F.trim(out, F.lit(" .;:"))


def norm_number(token: Column) -> Column:
    """Without thousands separators and without trailing zeros of a fraction."""
    plain = F.regexp_replace(token, "[ ,]", "")
    return F.when(plain.rlike(r"^\d+\.\d+$"), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def numbers_in(text: Column) -> Column:
    """Numbers of a text, apart from those of standard numbers and citations."""
    masked = F.regexp_replace(F.regexp_replace(text, NUMBER_PATTERN, " "), CITATION, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(PLAIN_NUMBER), F.lit(1)), norm_number))


def source_numbers(text: Column, clause: Column, number: Column, page_start: Column, page_end: Column) -> Column:
    """Numbers that a passage supports: of its text, clause number and its prefixes, standard and pages."""
    digits = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), norm_number)
    parts = F.split(F.coalesce(clause, F.lit("")), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    own = F.when(F.get(parts, F.lit(0)).rlike(r"^\d+$"), prefixes).otherwise(F.array().cast("array<string>"))
    standard = F.transform(F.regexp_extract_all(F.coalesce(number, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), norm_number)
    pages = F.array(page_start.cast("string"), page_end.cast("string"))
    return F.array_distinct(F.concat(numbers_in(text), digits(clause), own, standard, pages))


def checked_points(points: DataFrame, sources: DataFrame) -> DataFrame:
    """points with `drop`: the first reason against a point, null where it stands, and `cited`, its known citations.

    points: draft, point, text, quote, citations (array). sources: draft, cid, text, clause, number, page_start,
    page_end, synthetic. Reasons in order: no citation, quote not found, sample and official mixed, unknown standard,
    unsupported number, unsupported clause. A clause that a point names must be a cited passage's own, above or below
    it, or stand in its text; one of the draft's other passages will do for a numbered clause. Quotes under 12 characters (3 once normalised) aren't looked for.
    """
    # Dealt by draft before any text is read: a few small files would else be a few long tasks.
    points, sources = points.repartition("draft"), sources.repartition("draft")
    views = sources.select(
        "draft", "cid", norm_text(F.col("text")).alias("flat"), "synthetic",
        source_numbers(*(F.col(c) for c in ("text", "clause", "number", "page_start", "page_end"))).alias("numbers"),
        F.concat(F.transform(all_numbers(F.col("text")), base_number), F.array(base_number(F.col("number")))).alias("bases"),
        norm_text(F.coalesce("clause", F.lit(""))).alias("place"),
    )
    places = views.groupBy("draft").agg(F.collect_set("place").alias("__places"))
    cited = points.select("draft", "point", "quote", F.explode_outer(F.array_distinct("citations")).alias("cid"))
    joined = cited.join(views, ["draft", "cid"], "left")
    quote = norm_text(F.col("quote"))
    looked = (F.length("quote") >= 12) & (F.length(quote) >= 3)
    seen = joined.groupBy("draft", "point").agg(
        F.sort_array(F.collect_list(F.when(F.col("flat").isNotNull(), F.col("cid")))).alias("cited"),
        F.bool_or(F.coalesce(~looked, F.lit(True)) | F.coalesce(F.col("flat").contains(quote), F.lit(False))).alias("quoted"),
        F.count_distinct("synthetic").alias("kinds"),
        F.flatten(F.collect_list("numbers")).alias("numbers"), F.flatten(F.collect_list("bases")).alias("bases"),
        F.collect_list(F.when(F.col("flat").isNotNull(), F.struct("place", "flat"))).alias("held"),
    )
    out = points.join(seen, ["draft", "point"]).join(places, "draft", "left")
    standards = F.transform(all_numbers(F.col("text")), base_number)
    strange = F.size(F.array_except(standards, F.filter("bases", lambda x: x.isNotNull()))) > 0
    loose = F.size(F.array_except(numbers_in(F.col("text")), F.col("numbers"))) > 0
    below = lambda a, b: a.startswith(F.concat(b, F.lit(".")))
    here = lambda r: F.exists(
        "held", lambda h: (h["place"] == r) | below(h["place"], r) | ((h["place"] != "") & below(r, h["place"])) | h["flat"].contains(r) | h["place"].contains(r)
    )
    elsewhere = lambda r: r.rlike(r"^(?:[a-h]-)?\d") & F.array_contains(F.coalesce("__places", F.array().cast("array<string>")), r)
    refs = F.transform(clause_refs(F.col("text")), lambda r: norm_text(r))
    lost = F.exists(refs, lambda r: ~here(r) & ~elsewhere(r))
    reason = (
        F.when(F.size("cited") == 0, "no citation").when(~F.col("quoted"), "quote not found")
        .when(F.col("kinds") > 1, "sample and official mixed").when(strange, "unknown standard").when(loose, "unsupported number")
        .when(lost, "unsupported clause")
    )
    return out.select(*points.columns, "cited", reason.alias("drop"))


def checked_summaries(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """(draft, summary): the sentences of a draft's summary (draft, text) that its sources bear out.

    Markers of unknown sources go. A summary that cites both sample and official sources is dropped whole. A sentence
    is dropped where it names an unknown standard, a number that its sources (all of them, if it cites none) don't have,
    or any number without citing a source. sources: draft, cid, text, clause, number, page_start, page_end, synthetic.
    """
    # Dealt by draft before any text is read: a few small files would else be a few long tasks.
    drafts, sources = drafts.repartition("draft"), sources.repartition("draft")
    views = sources.groupBy("draft").agg(
        F.collect_list(
            F.struct(
                "cid", "synthetic", source_numbers(*(F.col(c) for c in ("text", "clause", "number", "page_start", "page_end"))).alias("numbers"),
                F.concat(F.transform(all_numbers(F.col("text")), base_number), F.array(base_number(F.col("number")))).alias("bases"),
            )
        ).alias("held")
    )
    joined = drafts.join(views, "draft", "left").withColumn("held", F.coalesce("held", F.array().cast(views.schema["held"].dataType)))
    markers = lambda t: F.regexp_extract_all(t, F.lit(CITATION), F.lit(1))
    cited = lambda t: F.filter("held", lambda h: F.array_contains(markers(t), h["cid"]))
    known = F.transform("held", lambda h: h["cid"])
    sentences = F.split(F.trim("text"), r"(?<=[.!?\]])\s+(?=[A-Z0-9\"'(])")

    def clean(t: Column) -> Column:
        return F.aggregate(F.array_except(markers(t), known), t, lambda a, m: F.replace(a, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))

    def stands(t: Column) -> Column:
        own = cited(t)
        pool = F.when(F.size(own) > 0, own).otherwise(F.col("held"))
        bases = F.flatten(F.transform("held", lambda h: F.filter(h["bases"], lambda b: b.isNotNull())))
        numbers = F.flatten(F.transform(pool, lambda h: h["numbers"]))
        strange = F.size(F.array_except(F.transform(all_numbers(t), base_number), bases)) > 0
        loose = F.size(F.array_except(numbers_in(t), numbers)) > 0
        bare = (F.size(own) == 0) & (F.size(numbers_in(t)) > 0)
        return ~strange & ~loose & ~bare

    kept = F.filter(F.transform(sentences, clean), lambda t: (F.trim(t) != "") & stands(t))
    mixed = F.size(F.array_distinct(F.transform(cited(F.col("text")), lambda h: h["synthetic"]))) > 1
    return joined.select("draft", F.when(mixed, "").otherwise(F.array_join(F.transform(kept, lambda t: F.trim(t)), " ")).alias("summary"))


def kept_items(items: Column, bases: Column, most: int = 6) -> Column:
    """A list's items, blanks collapsed, without those that name an unknown standard; the first ones."""
    flat = F.filter(F.transform(items, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    known = F.filter(flat, lambda t: F.size(F.array_except(F.transform(all_numbers(t), base_number), bases)) == 0)
    return F.slice(known, 1, most)


def strip_addresses(text: Column, known: Column) -> Column:
    """Addresses that neither are nor begin with a known one go."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1)))
    bad = F.filter(found, lambda u: ~F.exists(known, lambda k: u.startswith(k)))
    return F.aggregate(bad, text, lambda a, u: F.replace(a, u, F.lit("")))


def strength(cited: Column, relevance: Column, survived: Column) -> Column:
    """none, strong, moderate or limited; an unknown relevance counts as medium."""
    high, low = relevance >= STRONG_MIN, relevance < MODERATE_MIN
    return (
        F.when(cited == 0, "none").when((cited >= 2) & F.coalesce(high, F.lit(False)) & (survived >= 0.8), "strong")
        .when(~F.coalesce(low, F.lit(False)) & (survived >= 0.5), "moderate").otherwise("limited")
    )


def gate(passages: Column, scoped: Column, rerank: Column, cosine: Column, coverage: Column, live: Column) -> Column:
    """Whether a question may be answered from its passages."""
    limit = F.when(live, GATE["reranked_live"]).otherwise(GATE["reranked_extractive"])
    unranked = (cosine >= GATE["cosine"]) & (live | (coverage >= GATE["coverage"]))
    return F.when(passages == 0, False).when(scoped, True).when(rerank.isNotNull(), rerank >= limit).otherwise(F.coalesce(unranked, F.lit(False)))


def coverage(words: Column, passages: Column, prefix: int = 5) -> Column:
    """Share of words of which the first five letters occur in the passages; 1 without words."""
    heads = F.array_distinct(F.transform(words, lambda w: F.substring(F.lower(w), 1, prefix)))
    found = F.size(F.filter(heads, lambda h: F.lower(passages).contains(h)))
    return F.when(F.size(heads) > 0, found / F.greatest(F.size(heads), F.lit(1))).otherwise(1.0)


def _filter(hashes: DataFrame, count: int) -> tuple[bytes, int]:
    """A Bloom filter of the column h as bytes, and its bits: 16 a value, FILTER_BITS at most, two of them set by each."""
    bits = max(1 << 12, min(FILTER_BITS, 1 << (16 * count).bit_length()))
    places = hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 3).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("b"))
    out = bytearray(bits // 8)
    for r in words.collect():
        out[r["at"]] = r["b"]
    return bytes(out), bits


def _places(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def _may_hold(held: bytes, bits: int, h: Column) -> Column:
    byte = lambda p: F.conv(F.hex(F.substring(F.lit(held), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    one, two = (F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in _places(h, bits))
    return one & two


def _holding(given: DataFrame, text: str, quotes: list[str], keys: list[str]) -> DataFrame:
    """(keys, quote) of passages that hold one of a block's quotes, found by one automaton of them all in one scan."""
    schema = StructType([given.schema[k] for k in keys]).add("__quote", "string")

    def run(batches):
        import ahocorasick
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        found = ahocorasick.Automaton()
        for q in quotes:
            found.add_word(q, q)
        found.make_automaton()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            hits = [{q for _, q in found.iter(x)} if x else set() for x in batch.column(len(keys)).to_pylist()]
            take = pa.array([i for i, qs in enumerate(hits) for _ in qs], pa.int64())
            columns = [batch.column(i).take(take).cast(arrow.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([q for qs in hits for q in qs], pa.string())], schema=arrow)

    return given.select(*keys, text).mapInArrow(run, schema)


def found_quotes(quotes: DataFrame, passages: DataFrame, quote: str, text: str, keys: list[str]) -> DataFrame:
    """(quote's columns, passage's keys) where a passage holds a quote letter for letter.

    Quotes meet passages on a hashed run of their inner words, which stand whole in every passage that holds them, as
    the first and last may be parts of longer ones: words 2 to 9 of a quote of ten or more, all inner words of one of
    three to nine. A passage's runs are tested by a Bloom filter of the quotes' before they are rows, so that few but
    those of a quote are shuffled; no text is copied to its runs. Quotes of one or two words have no inner word: they
    are found by scans of the passages for MAX_BROADCAST_SHORT of them at a time. An empty quote is in every passage.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    asked = quotes.where(F.col(quote).isNotNull()).withColumn("__w", F.transform(words(F.col(quote)), lambda w: F.xxhash64(w)))
    asked = asked.withColumn("__n", F.least(F.greatest(F.size("__w") - 2, F.lit(0)), F.lit(8)))
    counts = {r["__n"]: r["count"] for r in asked.groupBy("__n").count().collect()}
    given = passages.select(*keys, text)
    met = None

    def also(found: DataFrame) -> None:
        nonlocal met
        met = found if met is None else met.unionByName(found)

    if 0 in counts:
        short = asked.where("__n = 0").drop("__w", "__n")
        blocks = max(1, -(-counts[0] // max(1, MAX_BROADCAST_SHORT)))
        for i in range(blocks):
            block = [r[0] for r in short.where((F.pmod(F.xxhash64(quote), F.lit(blocks)) == i) & (F.col(quote) != "")).select(quote).distinct().collect()]
            if block:
                also(short.withColumn("__quote", F.col(quote)).join(_holding(given, text, block, keys), "__quote").drop("__quote"))
        also(short.where(F.col(quote) == "").crossJoin(given.where(F.col(text).isNotNull()).select(*keys)))
    lengths = sorted(n for n in counts if n > 0)
    if lengths:
        long_ = asked.where("__n > 0").withColumn("h", F.xxhash64(F.slice("__w", F.lit(2), F.col("__n")))).drop("__w", "__n")
        held, bits = _filter(long_.select("h"), sum(counts[n] for n in lengths))
        run = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - n, F.lit(0))), lambda i: F.xxhash64(F.slice("__w", i + 1, F.lit(n))))
        coded = given.withColumn("__p", F.xxhash64(*keys, text))
        hashed = coded.select("__p", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__w"))
        runs = F.filter(F.concat(*[run(n) for n in lengths]), lambda h: _may_hold(held, bits, h))
        # An outer explode: for an inner one Spark would compute the runs once more, as a filter on their number.
        seen = hashed.select("__p", F.explode_outer(F.array_distinct(runs)).alias("h")).where("h is not null")
        # Only hashes meet by run, joined by a struct so that Spark may split a frequent one; texts come to what is left.
        pairs = seen.select("__p", F.struct("h").alias("__run")).join(long_.withColumn("__run", F.struct("h")).drop("h"), "__run").drop("__run").distinct()
        also(coded.join(pairs, "__p").where(F.col(text).contains(F.col(quote))).drop("__p", text))
    return quotes.limit(0).join(passages.select(*keys).limit(0)) if met is None else met.distinct()
