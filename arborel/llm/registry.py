"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard, lines, mixing, pii, records, repeats, topk, toxicity, urls

QUERIES = {
    "op1_token_records": records.query,
    "op2_toxicity": toxicity.query,
    "op3_repeated_passages": repeats.query,
    "op4_fuzzy_lines": lines.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_decontamination": decontaminate.query,
    "op7_source_mix": mixing.query,
    "op8_exact_top_k": topk.query,
    "op9_personal_data": pii.query,
    "op10_url_rules": urls.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_repeated_passages": repeats.ORACLE,
    "op5_ngram_jaccard": jaccard.ORACLE,
    "op8_exact_top_k": topk.ORACLE,
    "op10_url_rules": urls.ORACLE,
}
