"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from postroom.llm import decontamination, language_model, line_dedup, merkle, minhash_dedup, mixing, neighbours, quality_rules, secret_scan, token_counts, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_mixing": mixing.op2_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_language_model": language_model.op8_language_model,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_whitening": whitening.op12_whitening,
        "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op5_url_filter": url_filter.SQL}
