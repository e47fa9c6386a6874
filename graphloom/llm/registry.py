"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from graphloom.llm import exact_dedup, graph_dedup, lm_scoring, ngram_join, packing, pieces, quality_model, quality_rules, sharding, suffix_dedup, toxicity, turn_repair, whitening
from graphloom.llm.common import prepared

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_ngram_jaccard": ngram_join.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_quality_rules": quality_rules.query,
    "op5_packing": packing.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_sentencepiece": pieces.query,
    "op8_sharding": sharding.query,
    "op9_quality_classifier": quality_model.query,
    "op10_toxicity": toxicity.query,
    "op11_whitening": whitening.query,
    "op12_graph_dedup": graph_dedup.query,
    "op13_turn_repair": turn_repair.query,
}
QUERIES = {name: prepared(query) for name, query in QUERIES.items()}

ORACLE_SQL = {
    "op4_quality_rules": quality_rules.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op12_graph_dedup": graph_dedup.SQL,
}
