"""Quality rules from distribution divergence, in DataFrame operations only.

Each text gives a character-class histogram and a histogram of its language's common words. Both are compared by
Jensen-Shannon distance with the language's reference, the sum of these histograms over all documents of the
language. Common words are learned: the words that most documents of a language hold. Guards keep short texts from
being judged on too few counts. One pass over the texts counts words by language, a second one writes each document's
counts (a few hundred bytes); references and verdicts come from the written counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WS, WS_CLASS, table, words_of, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Common words of a language's reference. Up to MAX_BROADCAST languages (a row each) are broadcast.
COMMON, MAX_BROADCAST = 16, 10_000
#: Words that a text needs before its histograms are judged, and the largest distances (0 to 1) from the reference.
GUARD_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 80, 0.30, 0.30
#: Bits that a trigram's hash gives up besides those of its position.
SPARE = 0


def common_words(docs: DataFrame, text_col: str, lang_col: str, most: int = COMMON) -> DataFrame:
    """(lang, words): for each language the words that most of its documents hold, at most `most`, ties by word."""
    words = words_of(F.coalesce(text_col, F.lit("")))
    held = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(F.array_distinct(words)).alias("word"))
    counts = held.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("i", place).where(F.col("i") <= most)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("words"))


def _by_language(rows: DataFrame, facts: DataFrame, lang_col: str) -> DataFrame:
    """rows with the columns of facts (lang and others, a row a language), null where the language has none."""
    few = facts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    named = facts.withColumnRenamed("lang", "__named")
    return rows.join(F.broadcast(named) if few else named, F.col(lang_col) == F.col("__named"), "left").drop("__named")


def _base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts; docs has __list, the common words to count. Stages are separate selects, as a lambda would
    evaluate an inlined array again and again."""
    text = F.coalesce(text_col, F.lit(""))
    long = lambda c: c.cast("long")
    blank_line = lambda x: F.trim(x, F.lit(WS)) != ""
    out = docs.withColumns({"__text": text, "__words": words_of(text), "__list": F.coalesce("__list", F.array().cast("array<string>"))})
    # A trigram's hash fills the high bits and its position as many low bits as the text's length needs, so that one
    # sort of longs brings equal trigrams together.
    out = out.withColumns(
        {
            "__n": F.size("__words"),
            "__bits": F.length(F.bin(F.size("__words").cast("long"))),
            "__chars": F.char_length("__text"),
            "__word_chars": F.char_length(F.array_join("__words", "")),
            "__lines": F.filter(F.split("__text", "\n"), blank_line),
            "__found": F.filter("__words", lambda w: F.array_contains(F.col("__list"), w)),
        }
    )
    packed = F.expr(
        f"transform(sequence(0, __n - 3), i -> shiftleft(xxhash64(get(__words, i), get(__words, i + 1),"
        f" get(__words, i + 2)), __bits + {SPARE}) | cast(i as bigint))"
    )
    out = out.withColumn("__sorted", F.when(F.col("__n") >= 4, F.sort_array(packed)))
    like = lambda a, i, d: f"coalesce(shiftrightunsigned(x, __bits + {SPARE}) = shiftrightunsigned(get({a}, {i} {d} 1), __bits + {SPARE}), false)"
    equal = f"filter(__sorted, (x, i) -> {like('__sorted', 'i', '-')} or {like('__sorted', 'i', '+')})"
    # The low bits are the position; equal hashes of unequal words are told apart by the words.
    place = lambda x: f"cast({x} & (shiftleft(1L, __bits) - 1) as int)"
    out = out.withColumn("__equal", F.expr(equal)).withColumn("__place", F.expr(f"transform(__equal, x -> {place('x')})"))
    unlike = " or ".join(f"get(__words, {place('x')} + {d}) <> get(__words, get(__place, i - 1) + {d})" for d in range(3))
    out = out.withColumn("__clash", F.expr(f"size(filter(__equal, (x, i) -> i > 0 and {like('__equal', 'i', '-')} and ({unlike}))) > 0"))
    triples = F.expr(
        "sort_array(transform(sequence(0, __n - 3), i -> struct(get(__words, i) as a, get(__words, i + 1) as b,"
        " get(__words, i + 2) as c, i as at)))"
    )
    out = out.withColumn("__triples", F.when(F.coalesce("__clash", F.lit(False)), triples))
    as_ = lambda d: " and ".join(f"x.{w} = get(__triples, i {d} 1).{w}" for w in "abc")
    exact = F.expr(f"transform(filter(__triples, (x, i) -> coalesce({as_('-')}, false) or coalesce({as_('+')}, false)), x -> x.at)")
    out = out.withColumn("__at", F.sort_array(F.when(F.col("__triples").isNotNull(), exact).otherwise(F.col("__place"))))
    covered = F.aggregate(
        F.transform("__at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - x, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    runs = lambda kind: long(F.col("__chars") - F.char_length(F.regexp_replace("__text", f"[{kind}]+", "")))
    upper, digit, mark = runs("A-Z"), runs("0-9"), runs("!-/:-@\\[-`{-~")
    out = out.withColumns(
        {
            "n_words": long(F.col("__n")),
            "word_chars": long(F.col("__word_chars")),
            "n_symbols": long(F.regexp_count("__text", F.lit(f"[{SYMBOLS}]"))),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": F.coalesce(F.when(F.size("__at") > 0, covered), F.lit(0).cast("long")),
            "__upper": upper, "__digit": digit, "__mark": mark,
            "__wide": long(F.octet_length("__text") - F.col("__chars")),
            "__common": F.transform("__list", lambda w: long(F.size(F.filter("__found", lambda x: x == w)))),
        }
    )
    blank = long(F.col("__chars") - F.col("__word_chars"))
    plain = F.greatest(
        F.lit(0), F.col("word_chars") - F.col("__upper") - F.col("__digit") - F.col("__mark") - F.col("__wide")
    ).cast("long")
    return out.withColumn("__classes", F.array("__upper", "__digit", "__mark", "__wide", blank, plain))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, of two arrays of shares: 0 (equal) to 1 (disjoint)."""
    half = lambda a, b: F.when(a > 0, 0.5 * a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def references(counted: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common, ref_words): summed histograms of each language over all its documents."""
    at = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0).cast("long")) for i in range(n)])
    return counted.where(F.col("__lang").isNotNull()).groupBy(F.col("__lang").alias("lang")).agg(
        at("__classes", 6).alias("ref_classes"), at("__common", COMMON).alias("ref_common"), F.sum("n_words").alias("ref_words")
    )


def quality_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` of docs (all by default) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), char_distance,
    word_distance (double, null where a guard or a missing reference leaves them unjudged), base_failed and kept.

    A document is compared with the reference of its language, whichever languages occur. kept is false where
    base_failed, or where a judged distance exceeds its limit.

    Defined cases: a null or empty text has no words and fails the base rules. Texts under GUARD_WORDS words and
    documents without a language have no distances: only the base rules decide. The only document of a language is its
    own reference. Texts of any length are counted whole, in one row, and equal trigrams by their words. Repeated rows
    are judged alike and each counts in the references. Columns of docs with the names above are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance",
             "base_failed", "kept")
    own = [c for c in keep or docs.columns if c not in added]
    base = docs.select(*own, F.col(text_col).alias("__raw"), F.col(lang_col).alias("__lang"))
    lists = written(common_words(base, "__raw", "__lang").withColumnRenamed("words", "__list"), "common-words")
    listed = _by_language(base, lists, "__lang")
    counted = written(_base(listed, "__raw").select(*own, "__lang", *added[:5], "__classes", "__common"), "quality")
    judged = _by_language(counted, written(references(counted), "references"), "__lang")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    as_float = lambda a: F.transform(a, lambda x: x.cast("double"))
    rest = lambda all_, n: F.array((F.col(all_) - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)).cast("double"))
    some = F.slice("ref_common", 1, F.size("__common"))  # a language of few words has fewer than COMMON
    char = js_distance(_shares(as_float(F.col("__classes"))), _shares(as_float(F.col("ref_classes"))))
    word = js_distance(
        _shares(F.concat(as_float(F.col("__common")), rest("n_words", F.col("__common")))),
        _shares(F.concat(as_float(some), rest("ref_words", some))),
    )
    able = (F.col("n_words") >= GUARD_WORDS) & F.col("ref_classes").isNotNull()
    out = judged.select(
        *own, *added[:5], F.when(able, char).alias("char_distance"), F.when(able, word).alias("word_distance"), failed.alias("base_failed")
    )
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    lost = lambda kind: f"length(t) - length(regexp_replace(t, '[{kind}]+', '', 'g'))"
    jsd = (
        "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END"
        " + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)))"
    )
    return f"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{WS_CLASS}]+') AS w
  FROM documents),
sizes AS (SELECT doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols FROM texts),
line_rows AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
dup_lines AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM line_rows WHERE regexp_matches(line, '[^{WS_CLASS}]') GROUP BY doc_id),
word_rows AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
windows AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c
  FROM word_rows WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
gaps AS (SELECT doc_id, coalesce(least(3, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos), 3) AS gap
  FROM again WHERE n >= 2),
repeats AS (SELECT doc_id, CAST(sum(gap) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id),
classes AS (SELECT doc_id, lang, unnest([{lost('A-Z')}, {lost('0-9')}, {lost('!-/:-@\\[-`{-~')},
    strlen(t) - length(t), length(t) - word_chars,
    greatest(0, word_chars - ({lost('A-Z')}) - ({lost('0-9')}) - ({lost('!-/:-@\\[-`{-~')}) - (strlen(t) - length(t)))
  ]) AS n, unnest(range(6)) AS i FROM sizes),
char_refs AS (SELECT lang, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
  FROM classes WHERE lang IS NOT NULL GROUP BY lang, i),
common AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS i
  FROM (SELECT DISTINCT doc_id, lang, word FROM word_rows WHERE lang IS NOT NULL) GROUP BY lang, word
  QUALIFY i <= {COMMON}),
word_counts AS (SELECT doc_id, word, count(*) AS n FROM word_rows GROUP BY doc_id, word),
hits AS (SELECT s.doc_id, s.lang, c.i, coalesce(n, 0) AS n FROM sizes s JOIN common c ON c.lang = s.lang
  LEFT JOIN word_counts k ON k.doc_id = s.doc_id AND k.word = c.word),
shares AS (SELECT doc_id, lang, i, n FROM hits UNION ALL
  SELECT h.doc_id, h.lang, 99, any_value(n_words) - sum(n) FROM hits h JOIN sizes s USING (doc_id) GROUP BY h.doc_id, h.lang),
word_refs AS (SELECT lang, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM shares GROUP BY lang, i),
word_d AS (SELECT doc_id, {jsd} AS d FROM (SELECT s.doc_id, s.n / n_words AS p, q FROM shares s JOIN word_refs USING (lang, i)
  JOIN sizes z ON z.doc_id = s.doc_id WHERE n_words > 0) GROUP BY doc_id),
char_d AS (SELECT doc_id, {jsd} AS d FROM (SELECT c.doc_id, c.n / sum(c.n) OVER (PARTITION BY c.doc_id) AS p, q
  FROM classes c JOIN char_refs USING (lang, i)) GROUP BY doc_id),
base AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM sizes LEFT JOIN dup_lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT b.*, NOT base_failed AND NOT (n_words >= {GUARD_WORDS}
  AND (coalesce(c.d, 0) > {MAX_CHAR_DISTANCE} OR coalesce(w.d, 0) > {MAX_WORD_DISTANCE})) AS kept
FROM base b LEFT JOIN char_d c USING (doc_id) LEFT JOIN word_d w USING (doc_id)
"""


OP10_SQL = _oracle()
