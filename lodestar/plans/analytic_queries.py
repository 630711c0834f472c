"""Aggregates (A), grouping (G), LOD, table calculations (W), top-k (T),
set operations (SO), joins (J) and projections (P) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import grouping as G
from lodestar.operators import joins as J
from lodestar.operators import lod
from lodestar.operators import tablecalc as tc
from lodestar.operators.filters import FilterSpec, apply_filters, clean_date_literal_col
from lodestar.plans.core import STAR_SQL
from lodestar.plans.registry import add
from lodestar.sources.tables import Tables


def r(c, d=6):
    return F.round(c, d)


# =========================================================== A01 … A17 (lineitem)
_AGGS = [
    ("a01_sum", lambda: r(G.sum_("l_extendedprice"), 2), "round(sum(l_extendedprice), 2)"),
    ("a02_avg", lambda: r(G.avg("l_extendedprice")), "round(avg(l_extendedprice), 6)"),
    ("a03_min", lambda: G.min_("l_extendedprice"), "min(l_extendedprice)"),
    ("a04_max", lambda: G.max_("l_extendedprice"), "max(l_extendedprice)"),
    ("a05_count", lambda: G.count("l_quantity"), "count(l_quantity)"),
    ("a06_countd", lambda: G.countd("l_partkey"), "count(DISTINCT l_partkey)"),
    ("a07_median", lambda: r(G.median("l_extendedprice"), 4), "round(median(l_extendedprice), 4)"),
    ("a08_stdev", lambda: r(G.stdev("l_extendedprice"), 4), "round(stddev_samp(l_extendedprice), 4)"),
    ("a08_stdevp", lambda: r(G.stdevp("l_extendedprice"), 4), "round(stddev_pop(l_extendedprice), 4)"),
    ("a09_var", lambda: r(G.var("l_quantity"), 6), "round(var_samp(l_quantity), 6)"),
    ("a10_varp", lambda: r(G.varp("l_quantity"), 6), "round(var_pop(l_quantity), 6)"),
    ("a11_percentile", lambda: r(G.percentile("l_extendedprice", 0.9), 4), "round(quantile_cont(l_extendedprice, 0.9), 4)"),
    ("a13_corr", lambda: r(G.corr("l_quantity", "l_extendedprice")), "round(corr(l_quantity, l_extendedprice), 6)"),
    ("a14_covar", lambda: r(G.covar("l_quantity", "l_extendedprice"), 4), "round(covar_samp(l_quantity, l_extendedprice), 4)"),
    ("a15_covarp", lambda: r(G.covarp("l_quantity", "l_extendedprice"), 4), "round(covar_pop(l_quantity, l_extendedprice), 4)"),
    ("a16_count_if", lambda: G.count_if(F.col("l_discount") > 0.05), "count(*) FILTER (WHERE l_discount > 0.05)"),
    ("a17_unique_count_if", lambda: G.unique_count_if(F.col("l_discount") > 0.05, "l_partkey"), "count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_partkey END)"),
]
# exact percentiles without a group's values in one buffer (A07, A11)
for _name, _p, _sql in (("a07_median_two_phase", 0.5, "median(l_extendedprice)"), ("a11_percentile_two_phase", 0.9, "quantile_cont(l_extendedprice, 0.9)")):

    def _fn(spark, sf_dir, _p=_p):
        out = G.exact_percentile(Tables(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", _p)
        return out.select("l_returnflag", "l_linestatus", F.round("value", 4).alias("v"))

    add(_name, _fn, f"SELECT l_returnflag, l_linestatus, round({_sql}, 4) AS v FROM lineitem GROUP BY 1, 2")

for _name, _mk, _sql in _AGGS:

    def _fn(spark, sf_dir, _mk=_mk):
        return Tables(spark, sf_dir).lineitem.groupBy("l_returnflag", "l_linestatus").agg(_mk().alias("v"))

    add(_name, _fn, f"SELECT l_returnflag, l_linestatus, {_sql} AS v FROM lineitem GROUP BY 1, 2")


def _attr(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(
        G.attr("l_linestatus").alias("status"), G.attr("l_returnflag").alias("flag")
    )


add(
    "a12_attr",
    _attr,
    "SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS y, "
    "CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE '*' END AS status, "
    "CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE '*' END AS flag "
    "FROM lineitem GROUP BY 1, 2",
)


# =========================================================== G-01 … G-09
def _g01(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return G.dedupe(li.select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")))


add("g01_group_dedupe", _g01, "SELECT DISTINCT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem")


def _g02(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return G.having(c, ["c_nationkey"], {"n": F.count(F.lit(1)), "bal": F.round(F.sum("c_acctbal"), 2)}, F.col("n") > 60)


add(
    "g02_group_having",
    _g02,
    "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY c_nationkey HAVING count(*) > 60",
)


def _g03(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    out = G.auto_agg(p.select("p_type", "p_name", "p_brand", "p_size", "p_retailprice"), ["p_type"])
    return out.withColumn("sum_p_retailprice", F.round("sum_p_retailprice", 2))


add(
    "g03_default_aggregation",
    _g03,
    "SELECT p_type, count(p_name) AS count_p_name, count(p_brand) AS count_p_brand, CAST(sum(p_size) AS BIGINT) AS sum_p_size, "
    "round(sum(p_retailprice), 2) AS sum_p_retailprice FROM part GROUP BY p_type",
)


def _g04(spark, sf_dir):
    # one nested document per nation: the customer segments present (bounded list)
    c = Tables(spark, sf_dir).customer.select("c_nationkey", "c_mktsegment").distinct()
    out = G.nested(c, "c_nationkey", ["c_mktsegment"])
    return out.select("c_nationkey", F.to_json("items").alias("doc"))


add(
    "g04_nested_grouping",
    _g04,
    "SELECT c_nationkey, CAST(to_json(list({'c_mktsegment': c_mktsegment} ORDER BY c_mktsegment)) AS VARCHAR) AS doc "
    "FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey",
)


def _g05(spark, sf_dir):
    t = Tables(spark, sf_dir)
    v = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers_in_nation"))
    return v.join(base, "n_name", "left")


add(
    "g05_group_at_other_grain",
    _g05,
    "WITH cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT v.n_name, v.c_mktsegment, v.n, g.customers_in_nation FROM "
    "(SELECT n_name, c_mktsegment, count(*) AS n FROM cn GROUP BY 1, 2) v LEFT JOIN "
    "(SELECT n_name, count(DISTINCT c_custkey) AS customers_in_nation FROM cn GROUP BY 1) g ON v.n_name = g.n_name",
)


def _g06(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    v = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return G.share_of_total(v, "n").withColumn("share", F.round("share", 6))


add(
    "g06_share_of_total",
    _g06,
    "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
)


def _g07(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"))


add("g07_global_kpi", _g07, "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders")


def _g08(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.agg(
        (G.count_if(F.col("o_orderstatus") == "F") + G.count_if(F.col("o_orderpriority") == "1-URGENT") + G.unique_count_if(F.col("o_totalprice") > 400000, "o_custkey")).alias("kpi_sum")
    )


add(
    "g08_sum_of_kpis",
    _g08,
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') "
    "+ count(DISTINCT CASE WHEN o_totalprice > 400000 THEN o_custkey END) AS kpi_sum FROM orders",
)


def _g09(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return G.first_by(o, ["o_custkey"], "o_orderpriority", "o_orderkey", "first_priority")


add("g09_first_value_per_group", _g09, "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey")

# =========================================================== monthly view for LOD / W
MV_SQL = f"""WITH star AS ({STAR_SQL}),
mv AS (SELECT r_name, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym,
  round(sum(l_extendedprice), 2) AS revenue, round(sum(l_quantity), 2) AS qty, count(*) AS n_lines,
  CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS rev_c
  FROM star GROUP BY 1, 2)"""


def monthly_view(spark, sf_dir):
    """Region x month measures; lineitem is pre-aggregated per order (eager
    aggregation), every grouping key comes from the order's dimensions."""
    s = Tables(spark, sf_dir).order_star
    return s.groupBy("r_name", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")).agg(
        F.round(F.sum("ext"), 2).alias("revenue"),
        F.round(F.sum("qty"), 2).alias("qty"),
        F.sum("lines").alias("n_lines"),
        F.round(F.sum("ext") * 100).cast("bigint").alias("rev_c"),
    )


W_PART = tc.addressing(["r_name"], [F.col("ym")])
P_PART = tc.addressing(["r_name"])
W_SQL = "PARTITION BY r_name ORDER BY ym"


def _w(name: str, col_builder, sql_expr: str, digits: int | None = 4):
    def fn(spark, sf_dir):
        mv = monthly_view(spark, sf_dir)
        c = col_builder()
        return mv.select("r_name", "ym", (F.round(c, digits) if digits is not None else c).alias("v"))

    s = f"round({sql_expr}, {digits})" if digits is not None else sql_expr
    add(name, fn, f"{MV_SQL}\nSELECT r_name, ym, {s} AS v FROM mv")


RANK_W = tc.addressing(["r_name"], [F.col("n_lines").desc()])
RANK_SQL = "PARTITION BY r_name ORDER BY n_lines DESC"
_w("w01_rank", lambda: tc.rank(RANK_W), f"CAST(rank() OVER ({RANK_SQL}) AS INTEGER)", None)
_w("w02_rank_dense", lambda: tc.rank_dense(RANK_W), f"CAST(dense_rank() OVER ({RANK_SQL}) AS INTEGER)", None)
_w("w03_rank_modified", lambda: tc.rank_modified(RANK_W), f"count(*) OVER ({RANK_SQL} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", None)
_w(
    "w04_rank_unique",
    lambda: tc.rank_unique(tc.addressing(["r_name"], [F.col("n_lines").desc(), F.col("ym")])),
    "CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_lines DESC, ym) AS INTEGER)",
    None,
)
RUN = f"{W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_w("w05_running_sum", lambda: tc.running_sum("rev_c", W_PART), f"CAST(sum(rev_c) OVER ({RUN}) AS BIGINT)", None)
_w("w06_running_avg", lambda: tc.running_avg("rev_c", W_PART), f"avg(rev_c) OVER ({RUN})", 4)
_w("w07_running_count", lambda: tc.running_count("revenue", W_PART), f"count(revenue) OVER ({RUN})", None)
_w("w08_running_max", lambda: tc.running_max("revenue", W_PART), f"max(revenue) OVER ({RUN})", None)
_w("w09_running_min", lambda: tc.running_min("revenue", W_PART), f"min(revenue) OVER ({RUN})", None)
_w("w10_lookup_previous", lambda: tc.lookup("revenue", -1, W_PART), f"lag(revenue, 1) OVER ({W_SQL})", None)
_w("w10_lookup_next2", lambda: tc.lookup("revenue", 2, W_PART), f"lead(revenue, 2) OVER ({W_SQL})", None)
_w("w11_first", lambda: tc.first(W_PART), f"CAST(1 - row_number() OVER ({W_SQL}) AS INTEGER)", None)
_w("w12_last", lambda: tc.last(W_PART, P_PART), f"count(*) OVER (PARTITION BY r_name) - row_number() OVER ({W_SQL})", None)
_w("w13_index", lambda: tc.index(W_PART), f"CAST(row_number() OVER ({W_SQL}) AS INTEGER)", None)
_w("w14_size", lambda: tc.size(P_PART), "count(*) OVER (PARTITION BY r_name)", None)
_w("w15_total_share", lambda: F.col("rev_c") / tc.total("rev_c", P_PART), "rev_c / sum(rev_c) OVER (PARTITION BY r_name)", 6)
_w("w16_previous_value_sum", lambda: tc.previous_value_sum("rev_c", W_PART, 100), f"CAST(100 + sum(rev_c) OVER ({RUN}) AS BIGINT)", None)

def _w16r(spark, sf_dir):
    mv = monthly_view(spark, sf_dir)
    v = tc.previous_value("revenue", W_PART, 0.0, lambda acc, x: acc * 0.5 + x)
    # halving produces exact half-cent ties; truncate (identical IEEE steps in both engines)
    return mv.select("r_name", "ym", (F.floor(v * 100) / 100).alias("v"))


add(
    "w16_previous_value_recurrence",
    _w16r,
    "WITH RECURSIVE " + MV_SQL[len("WITH "):] + f", n AS (SELECT *, row_number() OVER ({W_SQL}) AS rn FROM mv),\n"
    "rec AS (SELECT r_name, ym, rn, CAST(0.0 AS DOUBLE) * CAST(0.5 AS DOUBLE) + revenue AS v FROM n WHERE rn = 1 UNION ALL "
    "SELECT n.r_name, n.ym, n.rn, rec.v * CAST(0.5 AS DOUBLE) + n.revenue FROM rec JOIN n ON n.r_name = rec.r_name AND n.rn = rec.rn + 1)\n"
    "SELECT r_name, ym, floor(v * 100) / 100 AS v FROM rec",
)


def _w16_fold(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey")
    return tc.previous_value_fold(o, ["o_custkey"], ["o_orderkey"], "o_orderkey", 7, lambda v, x: (3 * v + x) % 1000003, "v", "bigint")


add(
    "w16_previous_value_fold",
    _w16_fold,
    "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),\n"
    "r AS (SELECT o_custkey, o_orderkey, i, CAST((21 + o_orderkey) % 1000003 AS BIGINT) AS v FROM o WHERE i = 1 UNION ALL "
    "SELECT o.o_custkey, o.o_orderkey, o.i, CAST((3 * r.v + o.o_orderkey) % 1000003 AS BIGINT) FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)\n"
    "SELECT o_custkey, o_orderkey, v FROM r",
)
MOV = f"{W_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
_w("w17_window_avg", lambda: tc.window_avg("rev_c", W_PART, -2, 0), f"avg(rev_c) OVER ({MOV})", 4)
_w("w18_window_sum", lambda: tc.window_sum("rev_c", W_PART, -2, 0), f"CAST(sum(rev_c) OVER ({MOV}) AS BIGINT)", None)
_w("w19_window_min", lambda: tc.window_min("revenue", W_PART, -2, 0), f"min(revenue) OVER ({MOV})", None)
_w("w20_window_max", lambda: tc.window_max("revenue", W_PART, -2, 0), f"max(revenue) OVER ({MOV})", None)
_w("w21_window_count", lambda: tc.window_count("revenue", W_PART, -2, 0), f"count(revenue) OVER ({MOV})", None)
_w("w22_window_median", lambda: tc.window_median("rev_c", W_PART, -2, 0), f"median(rev_c) OVER ({MOV})", 4)
_w("w23_window_percentile", lambda: tc.window_percentile("rev_c", 0.9, W_PART, -2, 0), f"quantile_cont(rev_c, 0.9) OVER ({MOV})", 2)
_w("w24_window_stdev", lambda: tc.window_stdev("n_lines", W_PART, -2, 0), f"stddev_samp(n_lines) OVER ({MOV})", 6)
_w("w25_window_stdevp", lambda: tc.window_stdevp("n_lines", W_PART, -2, 0), f"stddev_pop(n_lines) OVER ({MOV})", 6)
_w("w26_window_var", lambda: tc.window_var("n_lines", W_PART, -2, 0), f"var_samp(n_lines) OVER ({MOV})", 6)
_w("w26_window_varp", lambda: tc.window_varp("n_lines", W_PART, -2, 0), f"var_pop(n_lines) OVER ({MOV})", 6)
_w("w27_window_corr", lambda: tc.window_corr("n_lines", "qty", W_PART, -2, 0), f"CASE WHEN count(*) OVER ({MOV}) > 1 THEN corr(n_lines, qty) OVER ({MOV}) END", 6)
_w("w28_window_covar", lambda: tc.window_covar("n_lines", "qty", W_PART, -2, 0), f"covar_samp(n_lines, qty) OVER ({MOV})", 4)
_w("w29_window_covarp", lambda: tc.window_covarp("n_lines", "qty", W_PART, -2, 0), f"covar_pop(n_lines, qty) OVER ({MOV})", 4)


# =========================================================== LOD-01 … LOD-08
def _lod01(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    v = s.groupBy("r_name").agg(F.sum("l_extendedprice").alias("revenue"))
    v = lod.table_wide(v, {"grand": F.sum("l_extendedprice")}, base=s)
    return v.select("r_name", F.round("revenue", 2).alias("revenue"), F.round(F.col("revenue") / F.col("grand"), 6).alias("share"))


add(
    "lod01_table_wide",
    _lod01,
    f"WITH star AS ({STAR_SQL}) SELECT r_name, round(sum(l_extendedprice), 2) AS revenue, "
    "round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM star), 6) AS share FROM star GROUP BY r_name",
)


def _lod02(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    f = apply_filters(s, [FilterSpec("o_orderpriority", members=["1-URGENT", "2-HIGH"])])
    # to the view's grain first: the five totals meet a row a nation, not the fact rows
    view = f.groupBy("r_name", "n_name").agg(F.sum("l_extendedprice").alias("revenue"))
    rows = lod.fixed(view, ["r_name"], {"region_total": F.sum("l_extendedprice")}, base=s)
    return rows.select("n_name", F.round("revenue", 2).alias("revenue"), F.round("region_total", 2).alias("region_total"))


add(
    "lod02_fixed",
    _lod02,
    f"WITH star AS ({STAR_SQL}), fx AS (SELECT r_name, sum(l_extendedprice) AS region_total FROM star GROUP BY r_name) "
    "SELECT n_name, round(sum(l_extendedprice), 2) AS revenue, round(max(fx.region_total), 2) AS region_total "
    "FROM star LEFT JOIN fx ON star.r_name IS NOT DISTINCT FROM fx.r_name "
    "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY n_name",
)


def _lod03(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    out = lod.include(s, ["r_name"], ["o_custkey"], {"cust_rev": F.sum("l_extendedprice")}, {"avg_customer_revenue": ("cust_rev", F.avg)})
    return out.select("r_name", F.round("avg_customer_revenue", 4).alias("avg_customer_revenue"))


add(
    "lod03_include",
    _lod03,
    f"WITH star AS ({STAR_SQL}) SELECT r_name, round(avg(cust_rev), 4) AS avg_customer_revenue FROM "
    "(SELECT r_name, o_custkey, sum(l_extendedprice) AS cust_rev FROM star GROUP BY 1, 2) GROUP BY r_name",
)


def _lod04(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    f = s.filter(F.col("l_returnflag") == "R")
    view = f.groupBy("r_name", "n_name").agg(F.sum("l_extendedprice").alias("revenue"))
    out = lod.exclude(f, ["r_name", "n_name"], ["n_name"], {"region_revenue": F.sum("l_extendedprice")}, view)
    return out.select("r_name", "n_name", F.round(F.col("revenue") / F.col("region_revenue"), 6).alias("share_in_region"))


add(
    "lod04_exclude",
    _lod04,
    f"WITH star AS ({STAR_SQL}), f AS (SELECT * FROM star WHERE l_returnflag = 'R') "
    "SELECT r_name, n_name, round(sum(l_extendedprice) / max(rr), 6) AS share_in_region FROM "
    "(SELECT f.*, sum(l_extendedprice) OVER (PARTITION BY r_name) AS rr FROM f) GROUP BY r_name, n_name",
)


def _lod05(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    f = s.filter(F.col("o_orderstatus") != "P")
    return lod.group_aggregate(f, ["r_name"], ["c_mktsegment"], {"orders": F.count_distinct("l_orderkey")})


add(
    "lod05_query_groups",
    _lod05,
    f"WITH star AS ({STAR_SQL}) SELECT r_name, CAST(sum(orders) AS BIGINT) AS orders FROM "
    "(SELECT r_name, c_mktsegment, count(DISTINCT l_orderkey) AS orders FROM star WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY r_name",
)


def _lod06(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    rows = lod.fixed(o, ["o_custkey"], {"first_order": F.min("o_orderdate")})
    return rows.groupBy(F.year("first_order").alias("cohort")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))


add(
    "lod06_fixed_in_field",
    _lod06,
    "SELECT CAST(year(fo) AS INTEGER) AS cohort, count(*) AS orders, count(DISTINCT o.o_custkey) AS customers FROM orders o "
    "LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS fo FROM orders GROUP BY 1) f ON o.o_custkey IS NOT DISTINCT FROM f.o_custkey GROUP BY 1",
)


def _lod07(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    view = s.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.sum("l_extendedprice").alias("revenue"))
    out = lod.ratio_to_fixed(view, "revenue", ["r_name"], s, F.sum("l_extendedprice"), "ratio")
    return out.select("r_name", "y", F.round("ratio", 6).alias("ratio"))


add(
    "lod07_ratio_to_fixed",
    _lod07,
    f"WITH star AS ({STAR_SQL}) SELECT v.r_name, v.y, round(v.revenue / nullif(t.tot, 0), 6) AS ratio FROM "
    "(SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS y, sum(l_extendedprice) AS revenue FROM star GROUP BY 1, 2) v "
    "LEFT JOIN (SELECT r_name, sum(l_extendedprice) AS tot FROM star GROUP BY 1) t ON v.r_name IS NOT DISTINCT FROM t.r_name",
)


def _lod08(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    return lod.group_aggregate(s, ["r_name"], ["n_name"], {"big_orders": G.unique_count_if(F.col("o_totalprice") > 300000, "l_orderkey")})


add(
    "lod08_conditional_distinct",
    _lod08,
    f"WITH star AS ({STAR_SQL}) SELECT r_name, CAST(sum(b) AS BIGINT) AS big_orders FROM "
    "(SELECT r_name, n_name, count(DISTINCT CASE WHEN o_totalprice > 300000 THEN l_orderkey END) AS b FROM star GROUP BY 1, 2) GROUP BY r_name",
)


# =========================================================== T-01 … T-06
def _t01(spark, sf_dir):
    return G.top_n(Tables(spark, sf_dir).part, ["p_brand"], F.round(F.sum("p_retailprice"), 2), 5)


add(
    "t01_top_n_members",
    _t01,
    "SELECT p_brand, round(sum(p_retailprice), 2) AS measure FROM part GROUP BY p_brand ORDER BY measure DESC NULLS LAST, p_brand LIMIT 5",
)


def _t02(spark, sf_dir):
    return G.top_n(Tables(spark, sf_dir).part, ["p_brand"], F.round(F.sum("p_retailprice"), 2), 5, bottom=True)


add(
    "t02_bottom_n_members",
    _t02,
    "SELECT p_brand, round(sum(p_retailprice), 2) AS measure FROM part GROUP BY p_brand ORDER BY measure ASC NULLS LAST, p_brand LIMIT 5",
)


def _t03(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.withColumn("ym", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    return G.top_n(o, ["ym"], F.round(F.sum("o_totalprice"), 2), 4)


add(
    "t03_top_n_date_part",
    _t03,
    "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym, round(sum(o_totalprice), 2) AS measure FROM orders "
    "GROUP BY 1 ORDER BY measure DESC NULLS LAST, ym LIMIT 4",
)


def _t04(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c_mktsegment")


add("t04_tile_sort", _t04, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment")


def _t05(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    order = ["o_orderstatus", "o_orderpriority", "o_orderkey"]  # ranges of the whole order, not one task a status
    return o.repartitionByRange(*order).sortWithinPartitions(*order)


add("t05_ordered_load", _t05, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus, o_orderpriority, o_orderkey")


def _t06(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    long = s.unpivot("s_suppkey", ["nation", "balance"], "property", "value")
    return long.orderBy("s_suppkey", "property")


add(
    "t06_sorted_unpivot",
    _t06,
    "SELECT s_suppkey, property, value FROM (SELECT s_suppkey, 'nation' AS property, CAST(s_nationkey AS DOUBLE) AS value FROM supplier "
    "UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier) ORDER BY s_suppkey, property",
)


def _topk_group(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    out = G.top_n_per_group(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return out.select("o_orderpriority", "o_orderkey", "o_totalprice")


add(
    "t01_top_n_per_group",
    _topk_group,
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
)


# =========================================================== SO-01 … SO-06
def _so01(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.union_distinct(t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select(F.col("s_nationkey").alias("nationkey")))


add("so01_union_distinct", _so01, "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")


def _so02(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return G.union_all_by_name(a, b).groupBy(F.col("bal").isNull().alias("bal_missing")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")
    )


add(
    "so02_union_all_by_name",
    _so02,
    "SELECT bal IS NULL AS bal_missing, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM "
    "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer UNION ALL BY NAME SELECT s_name AS name, s_suppkey AS id FROM supplier) GROUP BY 1",
)


def _so03(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.minus(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k")))


add("so03_minus", _so03, "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")


def _so04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lj = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment")
    return G.minus(lj, t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "inner").select("c_custkey", "c_mktsegment"))


add(
    "so04_minus_outer_join",
    _so04,
    "SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey EXCEPT "
    "SELECT c_custkey, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey",
)


def _so04_large(spark, sf_dir):
    t = Tables(spark, sf_dir)
    large = t.orders.filter(F.col("o_totalprice") > 300000)
    lj = t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment")
    return G.minus(lj, t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "inner").select("c_custkey", "c_mktsegment"))


add(
    "so04_minus_outer_join_large_orders",
    _so04_large,
    "SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey EXCEPT "
    "SELECT c_custkey, c_mktsegment FROM customer JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey",
)


def _so05(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_type", "p_size").distinct()


add("so05_distinct", _so05, "SELECT DISTINCT p_type, p_size FROM part")


def _so06(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return G.distinct_on(o, ["o_custkey"], "o_orderkey")


add(
    "so06_distinct_on_key",
    _so06,
    "SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn "
    "FROM orders) WHERE rn = 1",
)


# =========================================================== J-01 … J-16
def _j_basic(how):
    def fn(spark, sf_dir):
        t = Tables(spark, sf_dir)
        c = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey", "c_mktsegment")
        o = t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
        j = J.equi_join(c, o, [("c_custkey", "o_custkey")], how)
        return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_orders"), F.count("c_custkey").alias("n_customers"))

    return fn


_JSQL = (
    "SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS n_orders, count(c_custkey) AS n_customers FROM "
    "(SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING') c {how} JOIN "
    "(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey GROUP BY 1"
)
add("j01_inner_join", _j_basic("inner"), _JSQL.format(how="INNER"))
add("j02_left_join", _j_basic("left"), _JSQL.format(how="LEFT"))
add("j03_right_join", _j_basic("right"), _JSQL.format(how="RIGHT"))
add("j04_full_join", _j_basic("full"), _JSQL.format(how="FULL"))


def _j05(spark, sf_dir):
    s = Tables(spark, sf_dir).order_star  # J-05 star join, facts pre-aggregated per order
    return s.groupBy("r_name", "c_mktsegment").agg(F.sum("lines").alias("n"), F.round(F.sum("ext"), 2).alias("revenue"))


add(
    "j05_star_join",
    _j05,
    f"SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM ({STAR_SQL}) GROUP BY 1, 2",
)


_STAR_COLS = (
    "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate,"
    "o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority,c_name,c_nationkey,c_acctbal,c_mktsegment,n_name,n_regionkey,r_name"
)


def _j05_full(spark, sf_dir):
    """Keys of rows without a partner, on either side, survive the projection."""
    t = Tables(spark, sf_dir)
    c = t.customer.filter(F.col("c_custkey") % 3 != 0).select("c_custkey", "c_mktsegment")
    o = t.orders.filter(F.col("o_totalprice") > 150000).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return J.star_join({"c": c, "o": o}, [J.Relationship("c", "o", [("c_custkey", "o_custkey")], "full")])


add(
    "j05_star_join_full",
    _j05_full,
    "SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_mktsegment, orders FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) c "
    "FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 150000 GROUP BY 1) o ON c_custkey = o_custkey",
)


def _j13_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("k"))  # unique but for NULLs
    return J.cardinality(c, t.customer.select(F.col("c_custkey").alias("k")), ["k"], ["k"])


add("j13_cardinality_null_keys", _j13_null, "SELECT CAST(1 AS BIGINT) AS left_max, CAST(1 AS BIGINT) AS right_max, 'ONE_TO_ONE' AS cardinality FROM customer LIMIT 1")


def _p01v(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    return s.groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("o_custkey") + F.col("l_partkey") + F.col("l_suppkey")).alias("keys"),
        F.round(F.sum("l_tax"), 4).alias("tax"),
        F.max("o_orderdate").cast("string").alias("last_order"),
        F.min("c_name").alias("first_customer"),
        F.max("l_shipdate").cast("string").alias("last_ship"),
    )


add(
    "p01_projected_values",
    _p01v,
    "SELECT r_name, n_name, count(*) AS n, CAST(sum(l_orderkey * 7 + l_linenumber * 3 + o_custkey + l_partkey + l_suppkey) AS BIGINT) AS keys, round(sum(l_tax), 4) AS tax, "
    f"CAST(max(o_orderdate) AS VARCHAR) AS last_order, min(c_name) AS first_customer, CAST(max(l_shipdate) AS VARCHAR) AS last_ship FROM ({STAR_SQL}) GROUP BY 1, 2",
)


def _p01c(spark, sf_dir):
    s = Tables(spark, sf_dir).star
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.lit(",".join(s.columns)).alias("projection"), "n")


add("p01_model_projection", _p01c, f"SELECT '{_STAR_COLS}' AS projection, count(*) AS n FROM ({STAR_SQL})")


def _j06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    ps = t.lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.avg("l_quantity").alias("ps_avgqty"))
    j = J.star_join({"li": li, "ps": ps}, [J.Relationship("li", "ps", [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")], "inner")])
    return j.groupBy((F.col("l_quantity") > F.col("ps_avgqty")).alias("above_avg")).agg(F.count(F.lit(1)).alias("n"))


add(
    "j06_composite_keys",
    _j06,
    "SELECT l_quantity > ps_avgqty AS above_avg, count(*) AS n FROM lineitem JOIN "
    "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, avg(l_quantity) AS ps_avgqty FROM lineitem GROUP BY 1, 2) ps "
    "ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey GROUP BY 1",
)

_KIND = 10**12


def _graph_edges(t):
    """Vertices namespaced by kind: region 0, nation 1, customer 2, order 3."""
    e1 = t.orders.select((F.lit(3 * _KIND) + F.col("o_orderkey")).alias("src"), (F.lit(2 * _KIND) + F.col("o_custkey")).alias("dst"))
    e2 = t.customer.select((F.lit(2 * _KIND) + F.col("c_custkey")).alias("src"), (F.lit(1 * _KIND) + F.col("c_nationkey")).alias("dst"))
    e3 = t.nation.select((F.lit(1 * _KIND) + F.col("n_nationkey")).alias("src"), F.col("n_regionkey").cast("bigint").alias("dst"))
    return e1.unionByName(e2).unionByName(e3)


def _j07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    comp = J.connected_components(_graph_edges(t))
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))


_J07_SQL = """
WITH v AS (
  SELECT c.c_nationkey AS nk FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL SELECT c_nationkey FROM customer
  UNION ALL SELECT n_nationkey FROM nation)
SELECT CAST(n.n_regionkey AS BIGINT) AS component, count(*) + 1 AS vertices
FROM v JOIN nation n ON v.nk = n.n_nationkey GROUP BY n.n_regionkey
"""
add("j07_connected_components", _j07, _J07_SQL)


def _j08(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = _graph_edges(t)
    comp = J.connected_components(edges)
    return J.edges_of_component(edges, comp).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))


_J08_SQL = """
WITH e AS (
  SELECT c.c_nationkey AS nk FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL SELECT c_nationkey FROM customer
  UNION ALL SELECT n_nationkey FROM nation)
SELECT CAST(n.n_regionkey AS BIGINT) AS component, count(*) AS edges
FROM e JOIN nation n ON e.nk = n.n_nationkey GROUP BY n.n_regionkey
"""
add("j08_edge_selection", _j08, _J08_SQL)


def _j09(spark, sf_dir):
    t = Tables(spark, sf_dir)
    big = t.lineitem.filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi_join(t.orders, big, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


add(
    "j09_semi_join",
    _j09,
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
)


def _j10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.anti_join(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


add(
    "j10_anti_join",
    _j10,
    "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
)


def _j10_large(spark, sf_dir):
    t = Tables(spark, sf_dir)
    large = t.orders.filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_join(t.customer, large, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


add(
    "j10_anti_join_large_orders",
    _j10_large,
    "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1",
)


def _j11(spark, sf_dir):
    from lodestar.sources.mappings import joins_map

    t = Tables(spark, sf_dir)
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("inner", "left", "right", "full")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = t.supplier.select("s_suppkey", kinds.alias("join_kind"))
    m = joins_map(spark).select(F.col("workbook_join").alias("join_kind"), "target_join")
    return J.lookup_join(s, m, "join_kind").select("s_suppkey", "join_kind", "target_join")


add(
    "j11_lookup_join",
    _j11,
    "SELECT s_suppkey, k AS join_kind, CASE k WHEN 'inner' THEN 'INNER' WHEN 'left' THEN 'LEFT_OUTER' WHEN 'right' THEN 'RIGHT_OUTER' ELSE 'OUTER' END AS target_join "
    "FROM (SELECT s_suppkey, ['inner', 'left', 'right', 'full'][s_suppkey % 4 + 1] AS k FROM supplier)",
)


def _j12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"))
    lk = o.groupBy(F.col("prio").alias("lk_prio")).agg(F.count(F.lit(1)).alias("lk_n"))
    per_prio = o.groupBy("prio").agg(F.count(F.lit(1)).alias("n"))  # a row a key before the join, not the orders
    return J.null_safe_join(per_prio, lk, [("prio", "lk_prio")], "left").select("prio", "n", "lk_n")


add(
    "j12_null_safe_join",
    _j12,
    "WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders), lk AS (SELECT prio AS lk_prio, count(*) AS lk_n FROM o GROUP BY 1) "
    "SELECT prio, count(*) AS n, max(lk_n) AS lk_n FROM o LEFT JOIN lk ON o.prio IS NOT DISTINCT FROM lk.lk_prio GROUP BY prio",
)


def _j13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = J.cardinality(t.orders, t.customer, ["o_custkey"], ["c_custkey"]).withColumn("pair", F.lit("orders-customer"))
    b = J.cardinality(t.nation, t.region, ["n_regionkey"], ["r_regionkey"]).withColumn("pair", F.lit("nation-region"))
    c = J.cardinality(t.customer, t.customer, ["c_custkey"], ["c_custkey"]).withColumn("pair", F.lit("customer-customer"))
    return a.unionByName(b).unionByName(c)


def _card_sql(pair, lt, lk, rt, rk):
    return (
        f"SELECT CAST(l AS BIGINT) AS left_max, CAST(r AS BIGINT) AS right_max, CASE WHEN l <= 1 AND r <= 1 THEN 'ONE_TO_ONE' WHEN l <= 1 THEN 'ONE_TO_MANY' "
        f"WHEN r <= 1 THEN 'MANY_TO_ONE' ELSE 'MANY_TO_MANY' END AS cardinality, '{pair}' AS pair FROM "
        f"(SELECT max(n) AS l FROM (SELECT count(*) AS n FROM {lt} GROUP BY {lk})), (SELECT max(n) AS r FROM (SELECT count(*) AS n FROM {rt} GROUP BY {rk}))"
    )


add(
    "j13_cardinality",
    _j13,
    " UNION ALL ".join(
        [
            _card_sql("orders-customer", "orders", "o_custkey", "customer", "c_custkey"),
            _card_sql("nation-region", "nation", "n_regionkey", "region", "r_regionkey"),
            _card_sql("customer-customer", "customer", "c_custkey", "customer", "c_custkey"),
        ]
    ),
)


def _j14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t.supplier.select("s_suppkey", F.concat(F.lit("[S"), F.col("s_nationkey").cast("string"), F.lit("].[s_suppkey]::[N"), F.col("s_suppkey").cast("string"), F.lit("].[n_nationkey]")).alias("v"))
    p = J.parse_join_operands(F.col("v"))
    return s.select("s_suppkey", p.left_table.alias("lt"), p.left_column.alias("lc"), p.right_table.alias("rt"), p.right_column.alias("rc"))


add(
    "j14_join_operand_parse",
    _j14,
    "SELECT s_suppkey, 'S' || CAST(s_nationkey AS VARCHAR) AS lt, 's_suppkey' AS lc, 'N' || CAST(s_suppkey AS VARCHAR) AS rt, 'n_nationkey' AS rc FROM supplier",
)


def _j16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # nation is bounded by definition (25 rows), so the broadcast hint is safe
    j = J.star_join(
        {"customer": t.customer, "nation": t.nation},
        [J.Relationship("customer", "nation", [("c_nationkey", "n_nationkey")], "inner", hint="broadcast")],
    )
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


add("j16_broadcast_hint", _j16, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")


# =========================================================== P-02 … P-08
def _p02(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.concat_ws("::", "n_name", "s_name").alias("column_id"))


add("p02_column_id", _p02, "SELECT s_suppkey, n_name || '::' || s_name AS column_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")


def _p04(spark, sf_dir):
    from lodestar.operators.projections import clean_name

    t = Tables(spark, sf_dir)
    raw = F.concat(F.lit("[db].[sch].["), F.col("s_name"), F.lit(" (T"), F.col("s_nationkey").cast("string"), F.lit(")]"))
    return t.supplier.select("s_suppkey", clean_name(raw).alias("name"))


add("p04_name_cleanup", _p04, "SELECT s_suppkey, s_name AS name FROM supplier")


def _p05(spark, sf_dir):
    from lodestar.operators.projections import split_qualified

    t = Tables(spark, sf_dir)
    q = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("DB"), F.col("s_nationkey").cast("string"), F.lit(".SCH."), F.col("s_name"))).otherwise(F.col("s_name"))
    sp = split_qualified(q)
    return t.supplier.select("s_suppkey", sp.database.alias("db"), sp.schema.alias("sch"), sp.table.alias("tbl"))


add(
    "p05_qualified_name_split",
    _p05,
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'DB' || CAST(s_nationkey AS VARCHAR) END AS db, CASE WHEN s_suppkey % 3 = 0 THEN 'SCH' END AS sch, s_name AS tbl FROM supplier",
)


def _p06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cols = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("tbl"), F.col("s_suppkey").alias("pos"))
    cols = cols.withColumn("name", F.concat(F.lit("col_"), (F.col("pos") % 17).cast("string")))
    out = J.first_wins(cols, ["tbl", "name"], "pos")
    return out.select("tbl", "name", "pos")


add(
    "p06_first_wins_dedupe",
    _p06,
    "SELECT tbl, name, pos FROM (SELECT s_nationkey AS tbl, 'col_' || CAST(s_suppkey % 17 AS VARCHAR) AS name, s_suppkey AS pos, "
    "row_number() OVER (PARTITION BY s_nationkey, 'col_' || CAST(s_suppkey % 17 AS VARCHAR) ORDER BY s_suppkey) AS rn FROM supplier) WHERE rn = 1",
)


def _p07(spark, sf_dir):
    from lodestar.operators.projections import parse_part_reference

    t = Tables(spark, sf_dir)
    parts = F.element_at(F.array(*[F.lit(p) for p in ("yr", "mn", "qr", "none")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    ref = F.concat(F.lit("["), parts, F.lit(":"), F.upper(F.col("o_orderpriority")), F.lit(":ok]"))
    pr = parse_part_reference(ref)
    return t.orders.select("o_orderkey", pr.part.alias("part"), pr.column.alias("col"), pr.kind.alias("kind"))


add(
    "p07_part_reference_parse",
    _p07,
    "SELECT o_orderkey, ['yr', 'mn', 'qr', 'none'][o_orderkey % 4 + 1] AS part, upper(o_orderpriority) AS col, 'ok' AS kind FROM orders",
)


def _p08(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lit_txt = F.concat(F.lit("#"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"))
    return t.orders.select("o_orderkey", clean_date_literal_col(lit_txt).alias("d"))


add("p08_date_literal_cleanup", _p08, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
