"""Queries of the dealt operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwell.llm import (
    conversation_repair,
    embed_dedup,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    sentencepiece_nbest,
    substring_dedup,
    token_files,
    topk_search,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_nbest.op1_sentencepiece,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_topk_search": topk_search.op7_topk,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_embedding_near_dedup": embed_dedup.op9_embedding_near_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_language_id": language_id.op11_language_id,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": url_filter.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op10_mixing": mixing.oracle(),
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
