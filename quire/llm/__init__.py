"""Operators and queries for preparing training data; nothing else in the library imports this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ngram_join", "cover_search", "suffix_dedup", "mixing", "quality_rules", "quality_bayes", "packing", "language", "token_counts", "html_density", "licenses", "alignment", "resampling")


def all_queries() -> dict:
    """Registered queries by name, the pipeline among them."""
    from quire.llm.registry import QUERIES

    for name in MODULES:
        import_module(f"quire.llm.{name}")
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    """SQL giving the same rows, for the queries SQL can express."""
    from quire.llm.registry import ORACLES

    for name in MODULES:
        import_module(f"quire.llm.{name}")
    import corpus_pipeline

    return {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
