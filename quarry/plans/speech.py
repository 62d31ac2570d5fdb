"""Spoken numbers in the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import speech as sp
from quarry.plans.core import query

_ONES, _TENS = list(sp.SPOKEN)[0:1] + list(sp.SPOKEN)[2:11], list(sp.SPOKEN)[21:]
_WORDS = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.,]', ' ', 'g'), '\\s+'), lambda w: w <> ''), ' ')"


@query(f"""WITH said AS (SELECT conv_id, turn, {_WORDS} AS words, (conv_id % 8 + 2) AS ten, (turn % 9 + 1) AS one, conv_id % 10 AS last FROM conversations)
SELECT conv_id, turn, words || CASE WHEN words = '' THEN '' ELSE ' ' END || 'so IS ' || ten || one || last || '1786 and is ' || {_ONES}[one + 1] || ' of them is 12' AS written FROM said""")
def spoken_turns(t):
    """Each turn, and a number said after it: tens and a digit, a digit, and digits as written."""
    word = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    ten, one, last = F.col("conv_id") % 8, F.col("turn") % 9 + 1, F.col("conv_id") % 10
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit("so I S"), word(_TENS, ten), word(_ONES, one), word(_ONES, last), F.lit("1786, and is"), word(_ONES, one), F.lit("of them is 12"))
    return t("conversations").select("conv_id", "turn", sp.spoken_numbers(said).alias("written"))
