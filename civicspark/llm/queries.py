"""The corpus queries and their SQL."""

from __future__ import annotations

from civicspark.llm import bpe, exact, katz, lexical, lines, minhash, mixing, negatives, ordinal, passages, rules, sharding, toxicity

QUERIES = {
    "op1_quality": ordinal.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_sharding": sharding.op3_sharding,
    "op4_substring_dedup": passages.op4_substring_dedup,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_minhash": minhash.op9_minhash,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_katz": katz.op11_katz,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLES = {
    "op5_line_dedup": lines.SQL,
    "op8_exact_dedup": exact.SQL,
    "op10_quality_rules": rules.SQL,
    "op12_ranked_search": lexical.SQL,
    "op13_hard_negatives": negatives.SQL,
}
