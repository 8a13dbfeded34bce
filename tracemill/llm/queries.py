"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, bpe, embedding_dedup, fingerprints, hard_negatives, mixing, ngram_join, pii, secrets, substring_dedup, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_bpe": bpe.op4_bpe,
    "op5_mixing": mixing.op5_mixing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_warc": warc.op8_warc,
    "op9_secrets": secrets.op9_secrets,
    "op10_pii": pii.op10_pii,
    "op11_topk": topk.op11_topk,
    "op12_alignment": alignment.op12_alignment,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "fingerprint_classes": fingerprints.fingerprint_classes,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_topk": topk.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
