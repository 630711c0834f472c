"""Level-of-detail expressions (LOD-01…LOD-08).

FIXED aggregates are computed on the *unfiltered* frame (query filters do not
apply) and joined back on the dimensions with null-safe equality; INCLUDE and
EXCLUDE run at the query grain after the query filters.

Plan shape: ``groupBy(dims).agg`` is a partial + final hash aggregate, so the
side joined back holds one row per group.  When that side is small AQE turns
the join into a broadcast join at runtime; when it is large the join is a
sort-merge join on the dimensions and AQE's skew handling splits a hot key.
A group with a third of all rows is never gathered into one task: it is one
partial-aggregate row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _join_back(df: DataFrame, agg: DataFrame, dims: list[str]) -> DataFrame:
    if not dims:
        from lodestar.operators.grouping import attach_one_row

        return attach_one_row(df, agg)  # one-row aggregate
    renamed = agg.select(*[F.col(d).alias(f"_lod_{d}") for d in dims], *[c for c in agg.columns if c not in dims])
    cond = reduce(lambda a, b: a & b, [df[d].eqNullSafe(renamed[f"_lod_{d}"]) for d in dims])
    return df.join(renamed, cond, "left").drop(*[f"_lod_{d}" for d in dims])


def fixed(df: DataFrame, dims: list[str], aggs: dict[str, Column], base: DataFrame | None = None) -> DataFrame:
    """LOD-01/LOD-02 ``{FIXED dims : agg}`` on every row of ``df``.

    ``base`` is the frame before query filters (defaults to ``df``)."""
    src = base if base is not None else df
    agg = src.groupBy(*dims).agg(*[c.alias(n) for n, c in aggs.items()])
    return _join_back(df, agg, list(dims))


def table_wide(df: DataFrame, aggs: dict[str, Column], base: DataFrame | None = None) -> DataFrame:
    """LOD-01 ``{agg}``: a one-row aggregate attached to every row."""
    return fixed(df, [], aggs, base)


def include(df: DataFrame, query_dims: list[str], include_dims: list[str], inner: dict[str, Column], outer) -> DataFrame:
    """LOD-03 ``{INCLUDE d : inner}`` re-aggregated at the query grain.

    ``outer`` maps output name -> function(Column) -> Column applied to the
    inner column of the same name (e.g. ``F.avg``)."""
    fine = df.groupBy(*query_dims, *include_dims).agg(*[c.alias(n) for n, c in inner.items()])
    return fine.groupBy(*query_dims).agg(*[fn(F.col(n)).alias(out) for out, (n, fn) in outer.items()])


def exclude(df: DataFrame, query_dims: list[str], exclude_dims: list[str], aggs: dict[str, Column], view: DataFrame) -> DataFrame:
    """LOD-04 ``{EXCLUDE d : agg}``: aggregate at query dims minus ``d`` and attach
    the value to each row of ``view`` (the query-grain result)."""
    coarse_dims = [d for d in query_dims if d not in exclude_dims]
    agg = df.groupBy(*coarse_dims).agg(*[c.alias(n) for n, c in aggs.items()])
    return _join_back(view, agg, coarse_dims)


def group_aggregate(df: DataFrame, query_dims: list[str], extra_dims: list[str], aggs: dict[str, Column], outer=None) -> DataFrame:
    """LOD-05/LOD-08 ``group_aggregate(agg, query_groups() + {extra}, query_filters())``.

    Aggregates at ``query_dims + extra_dims`` on the already filtered frame,
    then re-aggregates to the query grain with ``outer`` (default sum)."""
    fine = df.groupBy(*query_dims, *extra_dims).agg(*[c.alias(n) for n, c in aggs.items()])
    outer = outer or {n: F.sum for n in aggs}
    return fine.groupBy(*query_dims).agg(*[outer[n](F.col(n)).alias(n) for n in aggs])


def ratio_to_fixed(view: DataFrame, value: str, fixed_dims: list[str], base: DataFrame, base_value: Column, name: str = "ratio") -> DataFrame:
    """LOD-07 ``SUM(x) / SUM({FIXED r : SUM(x)})`` at the view's grain.

    ``view`` already holds ``value`` = SUM(x) per view row; the FIXED total is
    computed on ``base`` (unfiltered) and joined on ``fixed_dims``."""
    tot = base.groupBy(*fixed_dims).agg(base_value.alias("_fixed_total"))
    out = _join_back(view, tot, list(fixed_dims))
    return out.withColumn(name, F.try_divide(F.col(value), F.col("_fixed_total"))).drop("_fixed_total")
