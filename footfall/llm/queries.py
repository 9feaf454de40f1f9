"""The queries of this subpackage and the SQL they must equal, where SQL can express it."""

from __future__ import annotations

from footfall.llm import (decontamination, exact_dedup, merkle, mixing, prefix_join, quality,
                          secrets, simhash, suffix_dedup, token_counts, token_ids, toxicity, whitening)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_simhash": simhash.op2_simhash,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontamination.op7_decontaminate,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_whitening": whitening.op12_whitening,
    "op13_ngram_jaccard": prefix_join.op13_ngram_jaccard,
}

ORACLE = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_ngram_jaccard": prefix_join.SQL,
}
