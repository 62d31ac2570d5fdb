"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from quarry.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from quarry.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from quarry.llm.language_id import op6_language_id
from quarry.llm.line_dedup import OP4_SQL, op4_line_dedup
from quarry.llm.merkle import OP11_SQL, op11_merkle_manifest
from quarry.llm.mixing import op3_mixing
from quarry.llm.near_dedup import op9_near_dedup
from quarry.llm.ogg import op2_media_ogg
from quarry.llm.pieces import op8_sentencepiece
from quarry.llm.quality_classifier import op7_quality_classifier
from quarry.llm.quality_rules import OP10_SQL, op10_quality_rules
from quarry.llm.suffix_dedup import op1_suffix_dedup
from quarry.llm.warc import op5_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_media_ogg": op2_media_ogg,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE_SQL = {
    "op4_line_dedup": OP4_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
