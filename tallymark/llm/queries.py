"""Queries of this folder, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tallymark.llm import class_lm, embedding_dedup, jaccard_join, merkle, mixing, packing, quality_classifier, quality_rules, token_files, toxicity, warc, weighted_kmeans, winnowing

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_token_files": token_files.op10_token_files,
    "op11_winnowing": winnowing.op11_winnowing,
    "op12_weighted_kmeans": weighted_kmeans.op12_weighted_kmeans,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op9_warc": warc.SQL,
    "op12_weighted_kmeans": weighted_kmeans.SQL,
    "op13_merkle": merkle.SQL,
}
