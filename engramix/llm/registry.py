"""Queries and oracles of the training-data operators, by name."""

from . import chat_format, decontamination, html_extraction, mixing, ngram_join, prefix_trie, quality, secrets_crf, sharding, token_counts, toxicity, turn_repair, url_filter

QUERIES = {
    "op1_secret_scan": secrets_crf.op1_secret_scan,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_chat_formatting": chat_format.op4_chat_formatting,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_sharding": sharding.op10_sharding,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_url_filters": url_filter.op12_url_filters,
    "op13_structure_repair": turn_repair.op13_structure_repair,
}

ORACLES = {
    "op4_chat_formatting": chat_format.ORACLE_SQL,
    "op8_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_url_filters": url_filter.ORACLE_SQL,
    "op13_structure_repair": turn_repair.ORACLE_SQL,
}
