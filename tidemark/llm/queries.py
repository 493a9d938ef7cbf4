"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, packing, sharding, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter

def queries() -> dict:
    return {
        "op1_url_filter": url_filter.query,
        "op2_best_fit_packing": packing.query,
        "op3_rendezvous_sharding": sharding.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_token_counts": token_counts.query,
        "op6_toxicity": toxicity.query,
        "op7_chat_format": chat_format.query,
        "op8_exact_topk": topk.query,
        "op9_decontaminate": decontaminate.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.ORACLE_SQL, "op8_exact_topk": topk.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL}
