"""Document identifiers: recognising, normalising and comparing standard numbers.

All functions take and return columns. A match keeps its parts (prefix, number, part, section, year) as a struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that a number may be written in.
NUMBER_PATTERN = (
    r"(?i)(?<![A-Za-z0-9])((IS\s*/\s*ISO\s*/\s*IEC|IS\s*/\s*IEC|IS\s*/\s*ISO|IS|DEMO)"
    r"(?:\s*[-:]?\s*|\s+)(\d+(?:[-.]\d{1,4})*)"
    r"(?:\s*[:(]?\s*(?:Part|Pt\.?|भाग)\s*(\d{1,3}[A-Z]?)\s*\)?)?"
    r"(?:\s*[(/]?\s*(?:Sec(?:tion)?\.?)\s*(\d{1,3}[A-Z]?)\s*\)?)?"
    r"(?:\s*[:：]\s*((?:19|20)\d{2}))?)(?=([\s\S]{0,8}))"
)
UNIT_PATTERN = r"(?i)^(mg|g|kg|ml|l|mm|cm|m|%|°|per|ppm|µ|n|kn|v|w|a)\b"

_PARTS = ("whole", "prefix", "number", "part", "section", "year", "after")


def _matches(text: Column) -> Column:
    """Every match in order, as structs of its parts; absent parts are empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), " ", " ")
    groups = [F.regexp_extract_all(plain, F.lit(NUMBER_PATTERN), F.lit(i + 1)).alias(n) for i, n in enumerate(_PARTS)]
    return F.arrays_zip(*groups)


def _is_number(m: Column) -> Column:
    """Prose guards: a bare one-digit number, or a lower-case "is" before a short, decimal or measured number."""
    prefix = F.upper(F.regexp_replace(m["prefix"], r"\s+", ""))
    tiny = (prefix == "IS") & (F.length(m["number"]) < 2) & (m["part"] == "")
    prose = (F.trim(m["prefix"]) == F.lit("is")) & (
        (F.length(m["number"]) < 3) | m["number"].contains(".") | F.trim(m["after"]).rlike(UNIT_PATTERN)
    )
    return ~tiny & ~prose


def _base(m: Column) -> Column:
    prefix = F.upper(F.regexp_replace(m["prefix"], r"\s+", ""))
    return F.concat(
        prefix,
        F.when(prefix == "DEMO", "-").otherwise(" "),
        m["number"],
        F.when(m["part"] != "", F.concat(F.lit(" (Part "), m["part"], F.lit(")"))).otherwise(""),
        F.when(m["section"] != "", F.concat(F.lit(" (Sec "), m["section"], F.lit(")"))).otherwise(""),
    )


def _canonical(m: Column) -> Column:
    return F.concat(_base(m), F.when(m["year"] != "", F.concat(F.lit(":"), m["year"])).otherwise(""))


def _first(text: Column, form) -> Column:
    found = F.filter(F.slice(_matches(text), 1, 1), _is_number)
    return F.get(F.transform(found, form), F.lit(0))


def canonical_number(text: Column) -> Column:
    """Canonical form of the first number in a text; null if there is none or prose guards reject it."""
    return _first(text, _canonical)


def base_number(text: Column) -> Column:
    """Canonical form without the year."""
    return _first(text, _base)


def year_of(text: Column) -> Column:
    year = _first(text, lambda m: m["year"])
    return F.when(year != "", year).cast("int")


def all_numbers(text: Column) -> Column:
    """Canonical forms of all numbers in order, each once."""
    return F.array_distinct(F.transform(F.filter(_matches(text), _is_number), _canonical))


def slug(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(canonical), "[^a-z0-9]+", "-"), F.lit("-"))


def same_standard(a: Column, b: Column) -> Column:
    """Equal base numbers, and equal years unless either is missing."""
    base = base_number(a) == base_number(b)
    years = year_of(a).isNull() | year_of(b).isNull() | (year_of(a) == year_of(b))
    return F.coalesce(base & years, F.lit(False))


def number_matches(found: Column, expected: Column) -> Column:
    """Whether a base number is the expected one or one of its parts."""
    base = base_number(found)
    return F.coalesce(
        (base == expected) | base.startswith(F.concat(expected, F.lit(" "))) | base.startswith(F.concat(expected, F.lit("("))),
        F.lit(False),
    )


def number_spans(text: Column) -> Column:
    """(number, start, end) of every number in a text, places from 1, end behind the last character."""
    plain = F.coalesce(text, F.lit(""))
    start = F.from_json(F.lit('{"at":1,"out":[]}'), "struct<at:int,out:array<struct<number:string,start:int,end:int>>>")

    def add(acc: Column, m: Column) -> Column:
        whole = F.trim(m["whole"])
        at = F.position(whole, F.translate(plain, " ", " "), acc["at"])
        span = F.struct(_canonical(m).alias("number"), at.alias("start"), (at + F.length(whole)).alias("end"))
        return F.struct((at + F.length(whole)).alias("at"), F.when(_is_number(m), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_matches(text), start, add, lambda acc: acc["out"])
