"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontamination, embedding_dedup, lm_scoring, minhash_dedup, mixing, passage_dedup, sharding, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_passage_dedup": passage_dedup.op2_passage_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLE_SQL = {"op6_mixing": mixing.ORACLE_SQL}
