"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import compact


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that it reaches.

    Every step is a grouped minimum (combined before the shuffle) and an
    equi-join, so a node with very many neighbours is never gathered in one
    task.  Steps go on until nothing changes: a number of rounds that grows with
    the logarithm of the nodes.  Each round is cut by a reliable checkpoint and
    kept in as many partitions as its rows ask for.
    """
    proper = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    state, _ = compact(proper.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    mark = _mark(state)
    while True:
        state, _ = compact(_small_star(_large_star(state)))
        after = _mark(state)
        if after == mark:
            break
        mark = after
    roots = state.select("v").distinct()
    return compact(state.selectExpr("u AS node", "v AS root").union(roots.selectExpr("v AS node", "v AS root")))[0]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row for each of the pairs of columns, as (u, v); keeps the partitioning of one partition, which a union would not."""
    return df.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(edges.join(least, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()
