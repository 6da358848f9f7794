"""Queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from corpusloom.llm import (chat_format, conversation_repair, exact_dedup,
                            html_text, language_id, line_dedup, mixing,
                            ngram_join, packing, periodic_runs,
                            substring_dedup, url_filter, vector_dedup)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_embedding_near_dedup": vector_dedup.op9_embedding_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_html_extraction": html_text.op13_html_extraction,
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
}
