"""Queries of this subpackage, and their SQL twins where SQL can state them."""

from __future__ import annotations

from tracehound.llm import alignment, chat, classifier, embeddings, lm, mixing, ngram_join, quality, repair, secrets, sentencepiece, token_counts, urls

QUERIES = {
    "op1_url_filters": urls.query,
    "op2_quality_rules": quality.query,
    "op3_secret_scans": secrets.query,
    "op4_quality_classifier": classifier.query,
    "op5_sentencepiece": sentencepiece.query,
    "op6_embedding_dedup": embeddings.query,
    "op7_ngram_join": ngram_join.query,
    "op9_lm_scoring": lm.query,
    "op8_source_mixing": mixing.query,
    "op10_chat_formatting": chat.query,
    "op11_token_counts": token_counts.query,
    "op12_alignment": alignment.query,
    "op13_conversation_repair": repair.query,
}
SQL = {"op13_conversation_repair": repair.SQL, "op10_chat_formatting": chat.SQL, "op6_embedding_dedup": embeddings.SQL, "op7_ngram_join": ngram_join.SQL, "op2_quality_rules": quality.SQL, "op1_url_filters": urls.SQL, "op8_source_mixing": mixing.SQL}
