"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from routelake.llm import embedding_dedup, exact_dedup, jaccard_join, language_id, media, mixing, packing, quality, resampling, sharding, token_store, toxicity, whitening

QUERIES = {
    "op1_token_store": token_store.query,
    "op2_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_sharding": sharding.query,
    "op5_language_id": language_id.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_media": media.query,
    "op8_mixing": mixing.query,
    "op9_quality": quality.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_embedding_dedup": embedding_dedup.query,
    "op12_resampling": resampling.query,
    "op13_whitening": whitening.query,
}
ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
