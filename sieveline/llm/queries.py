"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat_format, chat_repair, embedding_dedup, hmm_score, language_id, line_dedup, mixing, packing, phrases, quality_rules, simhash_dedup, token_codes

MODULES = [quality_rules, line_dedup, embedding_dedup, simhash_dedup, hmm_score, mixing, language_id, chat_format, token_codes, bpe, phrases, packing, chat_repair]


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
