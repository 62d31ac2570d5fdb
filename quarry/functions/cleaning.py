"""Line and text cleaning: columns to columns, without Python code at run time."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of lines that carry no content.
WATERMARK = (
    r"(?i)\b(licen[cs]ed to|supplied by|downloaded by|downloaded on|for internal use|single user licence|"
    r"simulated licence line|printed by|purchased by)\b"
)
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
IP_ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
DATED = r"(?i)\b(on|dated)\b"
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?[-–(\[]?\s*\d{1,4}\s*[-–)\]]?\s*(?:of\s*\d{1,4})?\s*$"
GAZETTE = (
    r"(?i)(THE GAZETTE OF INDIA|REGD\.\s*No\.|^\s*\[?PART II\b|^\s*EXTRAORDINARY\s*$|PUBLISHED BY AUTHORITY|"
    r"GI/\d{4}|Uploaded by Dte\. of Printing|Digitally signed by|^\s*xxxGID\w*xxx\s*$|Signature Not Verified)"
)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Texts that are Python strings at once while they are composed.
NFC_ROWS = 64
LEGACY_MARKS = r"[\x{A1}-\x{AC}\x{AE}-\x{DF}\x{F6}@\]^`~{}]"
#: Heading keywords in order of precedence, and the kind of clause that they name.
HEADING_KINDS = [
    ("FOREWORD", "foreword"), ("INTRODUCTION", "foreword"), ("SCOPE", "scope"), ("REFERENCE", "references"),
    ("TERMINOLOGY", "terminology"), ("DEFINITION", "terminology"), ("TERMS", "terminology"),
    ("REQUIREMENT", "requirement"), ("TEST", "test_method"), ("METHOD", "test_method"), ("SAMPLING", "sampling"),
    ("CRITERIA FOR CONFORMITY", "conformity"), ("CONFORMITY", "conformity"), ("MARKING", "marking"),
    ("LABELLING", "marking"), ("LABELING", "marking"), ("PACKING", "packing"), ("PACKAGING", "packing"),
    ("ANNEX", "annex"), ("AMENDMENT", "amendment"),
]

#: A word's boundary where only ASCII letters, digits and _ make words.
ASCII_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """The pattern with words and boundaries of ASCII characters only, as RE2 (DuckDB) reads it; Java's own \\b also
    counts letters such as ä as part of a word."""
    return pattern.replace("(?iU)", "(?iu)").replace(r"\b", ASCII_BOUND)


def normalize_text(text: Column) -> Column:
    """Separators to blanks, zero-width marks and soft hyphens away, ligatures spelt out, blanks collapsed.

    Composition to NFC isn't built into Spark: composed() does it, in Arrow batches.
    """
    out = F.regexp_replace(text, "[​⁠]+", " ")
    out = F.regexp_replace(out, "[‌‍﻿­]", "")
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return F.trim(F.regexp_replace(F.translate(out, " ", " "), r"[ \t\f\x0B]+", " "), F.lit(" \n\t\r\f\x0b"))


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    # So many texts at a time are Python's; Arrow's own utf8_normalize gives NFC wrong (23.0.1).
    slices = (text.slice(i, NFC_ROWS).to_pylist() for i in range(0, len(text), NFC_ROWS))
    done = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in part], pa.string()) for part in slices]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def composed(text: Column) -> Column:
    """Letters and their marks in one character (NFC); plain texts don't leave the JVM's columns."""
    marked = text.rlike(r"[^\x00-\x7F]")
    return F.when(marked, _nfc(F.when(marked, text))).otherwise(text)


def join_wrapped(lines: Column) -> Column:
    """One paragraph from its lines: blank ones skipped, a hyphen between two lower-case letters healed."""
    stripped = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    heal = lambda a, x: F.when(a == "", x).when(
        a.rlike("[a-z]-$") & x.rlike("^[a-z]"), F.concat(F.regexp_replace(a, "-$", ""), x)
    ).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(stripped, F.lit(""), heal)


def is_watermark(line: Column, ascii: bool = False) -> Column:
    """Marks of a licence holder; with ascii, other letters than ASCII's end a word."""
    has = lambda p: line.rlike(ascii_words(p) if ascii else p)
    return has(WATERMARK) | (has(EMAIL) & (has(IP_ADDRESS) | has(DATED)))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_gazette_noise(line: Column) -> Column:
    return line.rlike(GAZETTE)


def repeat_key(line: Column) -> Column:
    """Key under which lines that differ in digits only are the same."""
    return F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#")


def script_counts(text: Column) -> Column:
    """Letters by script: latin (below U+0250), devanagari, kannada, other."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    n = lambda kind: F.length(letters) - F.length(F.regexp_replace(letters, kind, ""))
    latin, deva, kannada = n(r"[\x{0}-\x{24F}]"), n(r"[\x{900}-\x{97F}]"), n(r"[\x{C80}-\x{CFF}]")
    return F.struct(
        latin.alias("latin"), deva.alias("devanagari"), kannada.alias("kannada"),
        (F.length(letters) - latin - deva - kannada).alias("other"),
    )


def devanagari_ratio(text: Column) -> Column:
    n = script_counts(text)
    total = n["latin"] + n["devanagari"] + n["kannada"] + n["other"]
    return F.when(total > 0, n["devanagari"] / total).otherwise(0.0)


def looks_like_legacy_font(line: Column) -> Column:
    """Two words or more, three tenths of them odd: marks of old fonts, capitals or punctuation inside a word."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    inner_capital = lambda w: w.rlike("[a-z][A-Z]") & ~w.rlike("^(?:[A-Z]?[a-z]+[A-Z][a-z]+)+$")
    inner_mark = lambda w: w.rlike("[a-zA-Z][/.;&][a-zA-Z]") & ~w.rlike(
        r"(?i)(https?|www|\.pdf|\.in|\.com|e\.g|i\.e|and/or)"
    )
    odd = F.size(F.filter(words, lambda w: w.rlike(LEGACY_MARKS) | inner_capital(w) | inner_mark(w)))
    return (F.size(words) >= 2) & (odd / F.greatest(F.lit(1), F.size(words)) >= 0.3)


def is_broken_devanagari(line: Column) -> Column:
    """Devanagari mixed with stray marks and capitals, over 8 for 100 letters."""
    deva = F.regexp_count(line, F.lit(r"[\x{900}-\x{97F}]"))
    stray = F.regexp_count(line, F.lit(r"""[!"#$%&'*+<=>?@\[\\\]^_`{|}~]"""))
    caps = F.regexp_count(line, F.lit(r"[\x{900}-\x{97F}][A-Z]|[A-Z][\x{900}-\x{97F}]"))
    return (deva > 0) & ((stray + caps) / F.greatest(deva, F.lit(1)) > 0.08)


def strip_parallel_devanagari(text: Column) -> Column:
    """Of a text in both scripts, the Latin half."""
    run = r"[\x{900}-\x{97F}\x{A8E0}-\x{A8FF}][\x{900}-\x{97F}\x{A8E0}-\x{A8FF}\x{200C}\x{200D}\s/,:()-]*"
    both = (F.regexp_count(text, F.lit("[A-Za-z]")) >= 3) & text.rlike(run)
    return F.when(both, F.trim(F.regexp_replace(F.regexp_replace(text, run, " "), r"[ \t]{2,}", " "))).otherwise(text)


def kind_for_heading(heading: Column) -> Column:
    upper = F.upper(heading)
    out = F.lit(None).cast("string")
    for keyword, kind in reversed(HEADING_KINDS):
        out = F.when(upper.contains(keyword), kind).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def rows_to_markdown(rows: Column) -> Column:
    """A pipe table from an array of rows: blanks collapsed, pipes to slashes, rows padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "|", "/"), r"\s+", " "))
    line = lambda r: F.concat(
        F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")
    )
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))), "\n")


def markdown_to_rows(text: Column) -> Column:
    """The rows of a pipe table; the rule under the header is skipped."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^\s*\|[-| :]+\|\s*$"))
    inner = lambda x: F.regexp_replace(F.trim(x), r"^\||\|$", "")
    return F.transform(lines, lambda x: F.transform(F.split(inner(x), r"\|"), lambda c: F.trim(c)))


def split_table(rows: Column, most: int) -> Column:
    """Groups of at most `most` body rows, each under the header; a table of up to most + 1 rows stays whole."""
    body = F.greatest(F.size(rows) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(body / most).cast("int") - 1, F.lit(0)))
    groups = F.transform(starts, lambda i: F.concat(F.slice(rows, 1, 1), F.slice(rows, i * most + 2, F.lit(most))))
    return F.when(F.size(rows) <= most + 1, F.array(rows)).otherwise(groups)
