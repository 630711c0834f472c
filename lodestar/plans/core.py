"""Step 1 of the build plan: the flagship slice.

Star join (J-05) + member filter (FT04) + range filter (FT20) + top-N
semi-join (FT15) + FIXED ratio (LOD-02/LOD-07) + running sum (W05).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import lod, tablecalc as tc
from lodestar.operators.filters import FilterSpec, apply_filters
from lodestar.plans.registry import query
from lodestar.sources.tables import Tables

STAR_SQL = """
  SELECT * FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
"""

FLAGSHIP_SQL = f"""
WITH star AS ({STAR_SQL}),
topn AS (
  SELECT n_name FROM star GROUP BY n_name
  ORDER BY sum(l_extendedprice) DESC NULLS LAST, n_name ASC NULLS FIRST LIMIT 10),
filt AS (
  SELECT * FROM star
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    AND l_quantity BETWEEN 5 AND 45
    AND n_name IN (SELECT n_name FROM topn)),
v AS (
  SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, sum(l_extendedprice) AS revenue
  FROM filt GROUP BY 1, 2, 3),
fx AS (SELECT r_name, sum(l_extendedprice) AS tot FROM star GROUP BY r_name)
SELECT v.r_name, v.n_name, v.o_year,
  round(v.revenue, 2) AS revenue,
  round(v.revenue / nullif(fx.tot, 0), 6) AS region_share,
  round(sum(v.revenue) OVER (PARTITION BY v.r_name, v.n_name ORDER BY v.o_year
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_revenue
FROM v LEFT JOIN fx ON v.r_name IS NOT DISTINCT FROM fx.r_name
"""


def flagship(spark, sf_dir):
    t = Tables(spark, sf_dir)
    star = t.star
    # The top-N key set (by nation) and the FIXED total (by region) are both
    # additive over the unfiltered star, so one (region, nation) partial
    # aggregate feeds both: one extra pass over the facts instead of two.
    coarse = star.groupBy("r_name", "n_name").agg(F.sum("l_extendedprice").alias("rev"))
    filtered = apply_filters(
        star,
        [
            FilterSpec("o_orderpriority", members=["1-URGENT", "2-HIGH", "3-MEDIUM"]),
            FilterSpec("l_quantity", kind="quantitative", min=5, max=45),
            FilterSpec("n_name", kind="top", end="top", count=10, expression=F.sum("rev")),
        ],
        base=coarse,
    )
    view = filtered.groupBy("r_name", "n_name", F.year("o_orderdate").alias("o_year")).agg(
        F.sum("l_extendedprice").alias("revenue")
    )
    view = lod.ratio_to_fixed(view, "revenue", ["r_name"], coarse, F.sum("rev"), "region_share")
    w = tc.addressing(["r_name", "n_name"], ["o_year"])
    view = view.withColumn("running_revenue", tc.running_sum("revenue", w))
    return view.select(
        "r_name",
        "n_name",
        "o_year",
        F.round("revenue", 2).alias("revenue"),
        F.round("region_share", 6).alias("region_share"),
        F.round("running_revenue", 2).alias("running_revenue"),
    )


query("flagship_region_share", FLAGSHIP_SQL)(flagship)
