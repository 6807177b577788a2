"""Queries of this subpackage, by name, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, conversations, html, jaccard, language, lmscore, packing, pieces, private, quality, sharding, sql, topk, whitening
from tidemark.llm.shared import small_batches

_OPERATORS = {
    "op1_pseudonyms": private.op1_pseudonyms,
    "op2_packing": packing.op2_packing,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_lm_scoring": lmscore.op4_lm_scoring,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_language_id": language.op6_language_id,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_sharding": sharding.op10_sharding,
    "op11_bpe": bpe.op11_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}


def _query(operator: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(small_batches(spark), sf_dir)


QUERIES = {name: _query(f) for name, f in _OPERATORS.items()}

#: The others need a trained model, a tokeniser, a parser or checksums, which this SQL does not have.
ORACLE_SQL: dict[str, str] = {"op7_exact_topk": topk.SQL, "op8_jaccard_join": sql.JACCARD_JOIN, "op13_conversation_repair": sql.CONVERSATION_REPAIR}
