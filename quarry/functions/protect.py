"""Protected spans: terms that a translation must leave alone become placeholders and come back afterwards."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "⟦", "⟧"
_HOLDER = re.compile(f"{OPEN}(\\d+){CLOSE}")


def masked(text: str, patterns: Sequence[re.Pattern]) -> tuple[str, list[str]]:
    """The text with non-overlapping spans as numbered placeholders, earlier patterns first, and the spans."""
    taken: list[tuple[int, int]] = []
    for pattern in patterns:
        for m in pattern.finditer(text):
            if m.end() > m.start() and all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
    out, spans, at = [], [], 0
    for a, b in sorted(taken):
        out += [text[at:a], f"{OPEN}{len(spans)}{CLOSE}"]
        spans.append(text[a:b])
        at = b
    return "".join([*out, text[at:]]), spans


def protect(text: Column, patterns: Sequence[str]) -> Column:
    """struct(text, spans) of a text column."""
    compiled = [re.compile(p, re.I) for p in patterns]

    @F.pandas_udf("text string, spans array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [masked(t or "", compiled) for t in texts]
        return pd.DataFrame({"text": [f[0] for f in found], "spans": [f[1] for f in found]})

    return run(text)


def restore(text: Column, spans: Column) -> Column:
    """The spans back in place; null unless each placeholder occurs exactly once and no other does."""
    found = F.regexp_extract_all(text, F.lit(f"{OPEN}(\\d+){CLOSE}"), F.lit(1))
    wanted = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: i.cast("string")))
    whole = F.sort_array(found).eqNullSafe(F.sort_array(F.coalesce(wanted, F.array().cast("array<string>"))))
    pairs = F.transform(spans, lambda s, i: F.struct(F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE)).alias("k"), s.alias("v")))
    return F.when(whole, F.aggregate(pairs, text, lambda a, p: F.replace(a, p["k"], p["v"])))
