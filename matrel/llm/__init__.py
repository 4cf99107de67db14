"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import embeddings, lm_scoring, mixing, pieces, quality, simhash, suffix_dedup, token_counts, toxicity, warc

MODULES = (warc, quality, token_counts, toxicity, mixing, pieces, embeddings, simhash, suffix_dedup, lm_scoring)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
