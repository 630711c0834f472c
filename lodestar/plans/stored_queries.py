"""Joins over tables that are stored by their relationship's keys (J-02, J-05)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators.joins import Relationship
from lodestar.plans.core import STAR_SQL
from lodestar.plans.registry import add
from lodestar.session import checkpoint_dir
from lodestar.sources import stored
from lodestar.sources.tables import Tables, tables_stamp

_NAMES = ("lineitem", "orders", "customer", "nation", "region")
_EDGES = [
    Relationship("lineitem", "orders", [("l_orderkey", "o_orderkey")], "inner"),
    Relationship("orders", "customer", [("o_custkey", "c_custkey")], "inner"),
    Relationship("customer", "nation", [("c_nationkey", "n_nationkey")], "inner"),
    Relationship("nation", "region", [("n_regionkey", "r_regionkey")], "inner"),
]
#: Nations and regions are sent to the other side.
_SMALL = 1_000
_LAYOUTS: dict = {}


def stored_star(spark, sf_dir) -> stored.Layout:
    """The star's tables in the shared folder, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, tables_stamp(spark, sf_dir, _NAMES))
    if key not in _LAYOUTS:
        t = Tables(spark, sf_dir)
        folder = f"{checkpoint_dir(spark).rstrip('/')}/star-{uuid.uuid4().hex}"
        _LAYOUTS[key] = stored.store({n: getattr(t, n) for n in _NAMES}, _EDGES, folder, least_rows=_SMALL)
    return _LAYOUTS[key]


def _j02(spark, sf_dir):
    f = stored_star(spark, sf_dir).frames
    lines = f["lineitem"].filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity")
    j = f["orders"].hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


add(
    "j02_left_join_stored_layout",
    _j02,
    "SELECT o_orderstatus, count(*) AS n, count(l_orderkey) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM orders "
    "LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = l_orderkey GROUP BY 1",
)

_REVENUE = f"SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM ({STAR_SQL}) GROUP BY 1, 2"


def _j05(spark, sf_dir):
    star = stored_star(spark, sf_dir).star(_EDGES)
    return star.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


add("j05_star_join_stored_layout", _j05, _REVENUE)


def _j05_facts(spark, sf_dir):
    """The grouping by the order's key needs no exchange either, nor does the join of its result."""
    layout = stored_star(spark, sf_dir)
    facts = layout.frames["lineitem"].groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("ext"), F.count(F.lit(1)).alias("lines"))
    star = layout.star(_EDGES, {"lineitem": facts})
    return star.groupBy("r_name", "c_mktsegment").agg(F.sum("lines").alias("n"), F.round(F.sum("ext"), 2).alias("revenue"))


add("j05_order_facts_stored_layout", _j05_facts, _REVENUE)
