"""Named queries of this subpackage and the DuckDB SQL of those that have one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "language_id",
    "chat_format",
    "substring_dedup",
    "mixing",
    "byte_bpe",
    "topk_search",
    "warc",
    "token_counts",
    "near_dedup",
    "quality_rules",
    "url_filter",
    "hard_negatives",
    "periodic_runs",
)


def _modules():
    return [importlib.import_module(f"lodestar.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    out = {k: f for m in _modules() for k, f in m.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: s for m in _modules() for k, s in getattr(m, "ORACLE", {}).items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
