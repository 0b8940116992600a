"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import best_fit, exact_dedup, jaccard_join, pii, quality, secrets, sentencepiece_codec, token_output, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_output": token_output.op3_token_output,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_best_fit_packing": best_fit.op8_best_fit_packing,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_warc": warc.op10_warc,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op9_secret_scans": secrets.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}
