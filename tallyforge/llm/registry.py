"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

from . import fim, langid, lexical, minhash, mixing, ngram_lm, quality_cnn, quality_rules, sentencepiece, sharding, simhash, suffix_dedup, topk

MODULES = (minhash, quality_cnn, quality_rules, sharding, mixing, langid, topk, ngram_lm, sentencepiece, suffix_dedup, fim, simhash, lexical)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
