"""Distinct counts at several grains from one pass over lineitem (A06, A17, LOD-03, LOD-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import grouping as G
from lodestar.plans.registry import add
from lodestar.sources.tables import Tables

_GRAINS = [["l_returnflag", "l_linestatus", "l_shipyear"], ["l_returnflag", "l_shipyear"], ["l_returnflag"], []]
_DIMS = _GRAINS[0]


def _lines(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("l_shipyear"), "l_partkey", "l_discount", F.col("l_extendedprice").cast("string").alias("price"))


def _sql(x: str) -> str:
    lines = "SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipyear, CAST(l_extendedprice AS VARCHAR) AS price FROM lineitem"
    parts = []
    for i, grain in enumerate(_GRAINS):
        types = {"l_shipyear": "INTEGER"}
        dims = ", ".join(d if d in grain else f"CAST(NULL AS {types.get(d, 'VARCHAR')}) AS {d}" for d in _DIMS)
        by = f" GROUP BY {', '.join(grain)}" if grain else ""
        parts.append(f"SELECT {i} AS _grain, {dims}, CAST(count(DISTINCT {x}) AS BIGINT) AS n FROM l{by}")
    return f"WITH l AS ({lines})\n" + "\nUNION ALL ".join(parts)


def _counts(form, x, cond=None):
    def fn(spark, sf_dir):
        state = G.distinct_state(_lines(spark, sf_dir), _DIMS, x, form, cond() if cond else None)
        return G.distinct_counts(state, _GRAINS, form)

    return fn


add("a06_distinct_at_four_grains", _counts("bitmap", "l_partkey"), _sql("l_partkey"))
add("a06_distinct_texts_at_four_grains", _counts("values", "price"), _sql("price"))
add(
    "a17_distinct_if_at_four_grains",
    _counts("bitmap", "l_partkey", lambda: F.col("l_discount") > 0.05),
    _sql("CASE WHEN l_discount > 0.05 THEN l_partkey END"),
)


def _merged(spark, sf_dir):
    """The states of two loads are united: neither load is read for the other."""
    lines = _lines(spark, sf_dir)
    loads = [G.distinct_state(lines.filter(side), _DIMS, "l_partkey", "bitmap") for side in ("l_shipyear % 2 = 0", "l_shipyear % 2 <> 0 OR l_shipyear IS NULL")]
    return G.distinct_counts(G.merge_distinct(loads, _DIMS, "bitmap"), _GRAINS, "bitmap")


add("a06_distinct_of_merged_loads", _merged, _sql("l_partkey"))
