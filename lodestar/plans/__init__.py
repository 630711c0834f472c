"""Query plans built from the operators.

Library modules here (``warehouse``, ``report``) import freely; the query
modules that register named queries are loaded on demand by
``all_queries()`` / ``all_oracles()`` (they build Columns, which needs an
active SparkContext).
"""

import importlib

QUERY_MODULES = (
    "core",
    "filter_queries",
    "function_queries",
    "analytic_queries",
    "tablewide_queries",
    "grain_queries",
    "stored_queries",
    "warehouse_queries",
    "report_queries",
    "extract_queries",
    "enrich_queries",
    "io_queries",
    "dump_queries",
)


def _load():
    for m in QUERY_MODULES:
        importlib.import_module(f"lodestar.plans.{m}")


def all_queries():
    from lodestar.plans import registry

    _load()
    return dict(registry.QUERIES)


def all_oracles():
    from lodestar.plans import registry

    _load()
    return dict(registry.ORACLE)
