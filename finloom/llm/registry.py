"""Queries of the numbered operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from finloom.llm import centroids, chat, classifier, collocations, decontaminate, neardup, packing, quality, secrets, substrings, tokens, toxicity, urls

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_chat_formatting": chat.query,
    "op3_url_filters": urls.query,
    "op4_minhash_near_dedup": neardup.query,
    "op5_substring_dedup": substrings.query,
    "op6_secret_scans": secrets.query,
    "op7_best_fit_packing": packing.query,
    "op8_quality_classifier": classifier.query,
    "op9_toxicity": toxicity.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_centroid_clustering": centroids.query,
    "op12_phrase_collocations": collocations.query,
    "op13_token_counts": tokens.query,
}

#: Not expressible in SQL: 5 (rolling hash), 6 (test battery), 7 (greedy packing), 8 and 9 (fitted models), 13 (byte pairs).
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_url_filters": urls.ORACLE,
    "op4_minhash_near_dedup": neardup.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
}
