"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from caudal.llm import (
    ann, bpe, exact_dedup, hard_negatives, hmm, language, minhash, packing, periodic, pii, quality, token_counts, toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_bpe": bpe.op3_bpe,
    "op4_ann": ann.op4_ann,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_language_id": language.op8_language_id,
    "op9_minhash": minhash.op9_minhash,
    "op10_hmm_lm": hmm.op10_hmm_lm,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
