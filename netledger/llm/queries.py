"""Registered queries of this package and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from netledger.llm import chat, embeddings, metric_search, mixing, paragraphs, periodic_runs, quality_classifier, quality_rules, secrets, sentencepiece_codec, simhash, vector_codes, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_embeddings": embeddings.query,
    "op3_paragraphs": paragraphs.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_warc": warc.query,
    "op6_sentencepiece": sentencepiece_codec.query,
    "op7_mixing": mixing.query,
    "op8_secrets": secrets.query,
    "op9_chat": chat.query,
    "op10_quality_rules": quality_rules.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_vector_codes": vector_codes.query,
    "op13_metric_search": metric_search.query,
}

ORACLE_SQL = {
    "op2_embeddings": embeddings.SQL,
    "op5_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op8_secrets": secrets.SQL,
    "op9_chat": chat.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_metric_search": metric_search.SQL,
}
