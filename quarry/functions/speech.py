"""Spoken identifiers: digits said after a prefix, joined to a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken digits and tens, and the digits that a prefix needs.
SPOKEN = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
}
MIN_DIGITS, MIN_DIGITS_VERB = 2, 3

_STATE = "struct<out:array<string>,held:array<string>,digits:string,tens:boolean>"


def spoken_numbers(text: Column) -> Column:
    """The words of a text, points and commas as blanks, with digits said after "IS" or "I S" joined: "I S fourteen five
    four three" to "IS 14543". After twenty to ninety a digit from one to nine replaces the zero. A prefix keeps its
    words if it is followed by fewer than two digits, or three where it is a lower-case "is", which may be the verb.

    A fold over the words: `held` has an open prefix and what was said after it, as written, and digits their value.
    """
    words = F.filter(F.split(F.regexp_replace(text, "[.,]", " "), r"\s+"), lambda w: w != "")
    named = F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair])
    start = F.from_json(F.lit('{"out":[],"held":[],"digits":"","tens":false}'), _STATE)
    none = F.array().cast("array<string>")
    state = lambda out, held, digits, tens: F.struct(out.alias("out"), held.alias("held"), digits.alias("digits"), tens.alias("tens"))

    def closed(s: Column) -> Column:
        """The words out, with what is open settled."""
        least = F.when(F.get(s["held"], 0) == "is", MIN_DIGITS_VERB).otherwise(MIN_DIGITS)
        number = F.when(F.length(s["digits"]) >= least, F.array(F.concat(F.lit("IS "), s["digits"]))).otherwise(s["held"])
        return F.concat(s["out"], number)

    def add(s: Column, w: Column) -> Column:
        low = F.lower(w)
        said = F.when(w.rlike(r"^[0-9]+$"), w).otherwise(F.element_at(named, low))
        only_i = (F.size(s["held"]) == 1) & (F.lower(F.get(s["held"], 0)) == "i")
        second = only_i & (low == "s")
        begins = (low == "is") | (low == "i")
        opened = (F.size(s["held"]) > 0) & ~only_i
        replaces = s["tens"] & ~w.rlike("^[0-9]") & (F.length(said) == 1) & (said != "0")
        digits = F.when(replaces, F.concat(F.substring(s["digits"], F.lit(1), F.length(s["digits"]) - 1), said)).otherwise(F.concat(s["digits"], said))
        tens = ~w.rlike("^[0-9]") & (F.length(said) == 2) & said.endswith("0") & (said != "10")
        fresh = lambda held: state(closed(s), held, F.lit(""), F.lit(False))
        return (
            F.when(second, state(s["out"], F.concat(s["held"], F.array(w)), F.lit(""), F.lit(False)))
            .when(opened & said.isNotNull(), state(s["out"], F.concat(s["held"], F.array(w)), digits, tens))
            .when(begins, fresh(F.array(w)))
            .otherwise(state(F.concat(closed(s), F.array(w)), none, F.lit(""), F.lit(False)))
        )

    joined = F.aggregate(words, start, add, lambda s: F.array_join(closed(s), " "))
    plain = F.array_join(words, " ")
    return F.when(text.rlike(r"(?i)\bi\s*s\b"), joined).otherwise(plain)
