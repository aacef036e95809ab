"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, exact_dedup, filter_audit, jaccard_join, langid, lm_score, merkle, mixing, packing, quality, secrets, sharding, token_counts

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_secrets": secrets.op2_secrets,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_language_id": langid.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_packing": packing.op13_packing,
}

ORACLE_SQL = {
    "op4_decontamination": decontam.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
