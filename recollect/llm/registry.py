"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from recollect.llm import langid, lexical_search, matroska, mixing, packing, pii, prefix_trie, simhash_blocks, simhash_tiles, suffixes, token_files, toxicity, url_filter

MODULES = [toxicity, simhash_blocks, mixing, matroska, langid, packing, token_files, simhash_tiles, suffixes, pii, prefix_trie, url_filter, lexical_search]


def queries() -> dict:
    import corpus_pipeline

    return {**{k: f for m in MODULES for k, f in m.QUERIES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**{k: s for m in MODULES for k, s in m.ORACLES.items()}, **own}
