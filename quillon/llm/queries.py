"""The corpus operators' queries, a thin one each, and their oracle SQL."""

from __future__ import annotations

from quillon.llm import decontamination, html_extract, language_id, mixing, secret_scan, simhash, token_counts, toxicity, url_filter, vector_search

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_vector_search": vector_search.op3_vector_search,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_language_id": language_id.op9_language_id,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op3_vector_search": vector_search.OP3_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
