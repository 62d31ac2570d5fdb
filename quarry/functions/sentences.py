"""Sentences, their modality, and token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbal forms in order of precedence, and sentence borders.
MODALITIES = [
    ("shall_not", r"(?i)\bshall\s+not\b|\bshall\s+neither\b"), ("shall", r"(?i)\bshall\b"),
    ("should_not", r"(?i)\bshould\s+not\b"), ("should", r"(?i)\bshould\b"),
    ("may", r"(?i)\bmay\b(?!\s+be\s+called)"), ("must", r"(?i)\bmust\b"),
]
SENTENCE_BORDER = (
    r"(?<!\bNo)(?<!\be\.g)(?<!\bi\.e)(?<!\bCl)(?<!\bSec)(?<!\bFig)(?<!\bvs)(?<!\bS\.O)(?<!\bdt)(?<!\bMax)(?<!\bMin)"
    r"(?<=[.;])\s+(?=[A-Z(•\"'])"
)
UNIT_BORDER = r"(?<=[.;:])\s+(?=[A-Z(•])"
SILENT_KINDS = ("foreword", "terminology", "references", "scope", "front", "amendment", "list")
REQUIREMENT_KINDS = (
    "requirement", "test_method", "marking", "packing", "sampling", "conformity", "annex", "table", "other", "faq",
)
MIN_SENTENCE = 12


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, cut to an integer, plus one."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.floor(words * F.lit(1.3).cast("double")).cast("int") + 1


def split_sentences(text: Column) -> Column:
    """Sentences of at least 12 characters, paragraph by paragraph; table lines are skipped."""
    paragraphs = F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    prose = F.filter(paragraphs, lambda p: (p != "") & ~p.startswith("|"))
    parts = F.flatten(F.transform(prose, lambda p: F.split(p, SENTENCE_BORDER)))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= MIN_SENTENCE)


def modality(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MODALITIES):
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def may_oblige(clause_kind: Column, document_kind: Column) -> Column:
    """Whether a clause's sentences count as requirements."""
    return ~clause_kind.isin(*SILENT_KINDS) & ((document_kind != "standard") | clause_kind.isin(*REQUIREMENT_KINDS))
