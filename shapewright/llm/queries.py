"""Queries of the operators in this folder and their DuckDB SQL, where SQL can state them."""

from __future__ import annotations

from shapewright.llm import (
    decontamination,
    fingerprints,
    hard_negatives,
    jaccard,
    licenses,
    merkle,
    mixing,
    pii,
    sharding,
    substrings,
    token_counts,
    toxicity,
    urls,
)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_licenses": licenses.op2_licenses,
    "op3_pii": pii.op3_pii,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_urls": urls.op5_urls,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_substrings": substrings.op9_substrings,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle": merkle.op11_merkle,
    "op12_sharding": sharding.op12_sharding,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op2_licenses": licenses.OP2_SQL,
    "op4_token_counts": token_counts.OP4_SQL,
    "op5_urls": urls.OP5_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_substrings": substrings.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
