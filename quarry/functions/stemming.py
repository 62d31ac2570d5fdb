"""Stems of English words by Porter's algorithm of 1980, and letters without their marks."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what they become, by step.
STEP_2 = dict(
    x.split(":") for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous "
        "ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    ).split()
)
STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
LONGEST = 64


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last of them not w, x or y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table, if what precedes it measures more than `least`."""
    for n in range(min(7, len(word)), 0, -1):
        if word[-n:] in table:
            return word[:-n] + table[word[-n:]] if _measure(word[:-n]) > least else word
    return word


@lru_cache(1 << 17)
def stem_word(word: str) -> str:
    """The stem of a word in lower case; words of one, two or over LONGEST letters stay."""
    if not 2 < len(word) <= LONGEST:
        return word
    if word[1:].endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word[1:].endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end) and "v" in _kinds(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-1:] == word[-2:-1] and _kinds(word)[-1:] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 0), STEP_3, 0)
    end = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def plain_letters(word: str) -> str:
    """Letters without their marks."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem_word(plain_letters(w)) for w in ws])


def stemmed(words: Column) -> Column:
    """An array of words in lower case without marks and suffixes, in Arrow batches."""
    return _stems(words)
