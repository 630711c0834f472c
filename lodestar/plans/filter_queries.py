"""Filter operators FT01…FT76 and FX-01…FX-15 on the orders/customer tables.

Fixture columns (derived identically in Spark and in the oracle SQL):
  o_prio_n = nullif(o_orderpriority, '5-LOW')                      string with NULLs
  o_date_n = date of o_orderdate, NULL when o_orderstatus = 'P'     date with NULLs
Every query returns per ``o_orderstatus``: n_rows and key_sum (sum of keys),
an exact checksum of the rows a filter keeps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.filters import FilterSpec, apply_filter, apply_filters, chip_filter, live_predicate, parameter_filter
from lodestar.plans.registry import add
from lodestar.sources.tables import Tables

FX_SQL = """fx AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
         nullif(o_orderpriority, '5-LOW') AS o_prio_n,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_date_n,
         CAST(o_orderdate AS DATE) AS o_date
  FROM orders)"""


def fixture(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_prio_n"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date")).otherwise(F.to_date("o_orderdate")).alias("o_date_n"),
        F.to_date("o_orderdate").alias("o_date"),
    )


def summary(df):
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def summary_sql(where: str) -> str:
    return (
        f"WITH {FX_SQL}\nSELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum\n"
        f"FROM fx WHERE {where}\nGROUP BY o_orderstatus"
    )


# Date-part code -> DuckDB expression of the part on column d.
PART_SQL = {
    "yr": "year({c})",
    "mn": "month({c})",
    "qr": "quarter({c})",
    "wk": "week({c})",
    "dy": "day({c})",
    "wd": "dayofweek({c})",
    "my": "(year({c}) * 100 + month({c}))",
    "md": "(year({c}) * 10000 + month({c}) * 100 + day({c}))",
}

PART_MEMBERS = {
    "yr": ["1996", "1998"],
    "mn": ["1", "2", "12"],
    "qr": ["2", "3"],
    "wk": ["1", "10", "53"],
    "dy": ["1", "15", "31"],
    "wd": ["0", "6"],
    "my": ["199601", "199712", "200002"],
    "md": ["19960101", "19970315", "19991231", "20000229"],
}

STR_MEMBERS = ["1-URGENT", "3-MEDIUM"]


def _member_sql(p: str, members, mode: str, with_null: bool) -> str:
    lst = ", ".join(members)
    if mode == "exclusive":
        return f"({p} NOT IN ({lst}) AND {p} IS NOT NULL)" if with_null else f"({p} NOT IN ({lst}))"
    return f"({p} IN ({lst}) OR {p} IS NULL)" if with_null else f"({p} IN ({lst}))"


def _register_member(qid: str, label: str, part: str | None, mode: str, with_null: bool):
    col = "o_prio_n" if part is None else "o_date_n"
    members = list(STR_MEMBERS if part is None else PART_MEMBERS[part])
    spec_members = members + (["%null%"] if with_null else [])

    def fn(spark, sf_dir):
        return summary(apply_filter(fixture(spark, sf_dir), FilterSpec(col, mode=mode, part=part, members=spec_members)))

    p = col if part is None else PART_SQL[part].format(c=col)
    lits = [f"'{m}'" for m in members] if part is None else members
    add(f"{qid}_{label}", fn, summary_sql(_member_sql(p, lits, mode, with_null)))


def _register_top(qid: str, label: str, part: str | None, end: str):
    col = "o_prio_n" if part is None else "o_date_n"
    n = 3

    def fn(spark, sf_dir):
        fx = fixture(spark, sf_dir)
        spec = FilterSpec(col, kind="top", part=part, end=end, count=n, expression=F.sum("o_totalprice"))
        return summary(apply_filter(fx, spec))

    p = col if part is None else PART_SQL[part].format(c=col)
    direction = "DESC" if end == "top" else "ASC"
    where = (
        f"{p} IN (SELECT k FROM (SELECT {p} AS k, sum(o_totalprice) AS m FROM fx GROUP BY 1 "
        f"ORDER BY m {direction} NULLS LAST, k ASC NULLS FIRST LIMIT {n}))"
    )
    add(f"{qid}_{label}", fn, summary_sql(where))


def _register_condition(qid: str, label: str, part: str | None):
    col = "o_prio_n" if part is None else "o_date_n"

    def fn(spark, sf_dir):
        spec = FilterSpec(col, kind="condition", part=part, expression=F.avg("o_totalprice"), condition=F.col("_measure") > 250000)
        return summary(apply_filter(fixture(spark, sf_dir), spec))

    p = col if part is None else PART_SQL[part].format(c=col)
    where = f"{p} IN (SELECT {p} FROM fx GROUP BY {p} HAVING avg(o_totalprice) > 250000)"
    add(f"{qid}_{label}", fn, summary_sql(where))


def _register_wildcard(qid: str, label: str, ptype: str, pattern: str, mode: str):
    def fn(spark, sf_dir):
        spec = FilterSpec("o_prio_n", kind="wildcard", mode=mode, pattern_type=ptype, pattern=pattern)
        return summary(apply_filter(fixture(spark, sf_dir), spec))

    like = {"contains": f"%{pattern}%", "starts-with": f"{pattern}%", "ends-with": f"%{pattern}", "exact-match": pattern}[ptype]
    op = "LIKE" if mode == "inclusive" else "NOT LIKE"
    add(f"{qid}_{label}", fn, summary_sql(f"o_prio_n {op} '{like}'"))


def _register_range(qid: str, label: str, lo, hi, column="o_totalprice", sql_lo=None, sql_hi=None):
    def fn(spark, sf_dir):
        return summary(apply_filter(fixture(spark, sf_dir), FilterSpec(column, kind="quantitative", min=lo, max=hi)))

    slo = sql_lo if sql_lo is not None else lo
    shi = sql_hi if sql_hi is not None else hi
    if lo is not None and hi is not None:
        where = f"{column} BETWEEN {slo} AND {shi}"
    elif lo is not None:
        where = f"{column} > {slo}"
    else:
        where = f"{column} < {shi}"
    add(f"{qid}_{label}", fn, summary_sql(where))


# ---- FT01-FT04 -----------------------------------------------------------------
_register_member("ft01", "general_exclusive_null_dropped", None, "exclusive", True)
_register_member("ft02", "general_inclusive_null_kept", None, "inclusive", True)
_register_member("ft03", "general_exclusive", None, "exclusive", False)
_register_member("ft04", "general_inclusive", None, "inclusive", False)


# ---- FT05/FT06 intersection: the template keeps no row --------------------------
def _intersection(include_all):
    def fn(spark, sf_dir):
        return summary(apply_filter(fixture(spark, sf_dir), FilterSpec("o_prio_n", kind="intersection", include_all=include_all)))

    return fn


add("ft05_intersection_exclude_all", _intersection(False), summary_sql("o_prio_n NOT LIKE '%'"))
add("ft06_intersection_include_all", _intersection(False), summary_sql("o_prio_n NOT LIKE '%'"))
add("ft06_intersection_include_all_option", _intersection(True), summary_sql("TRUE"))  # the option: empty means all

# ---- FT07-FT14 wildcard --------------------------------------------------------
_register_wildcard("ft07", "wildcard_contains", "contains", "I", "inclusive")
_register_wildcard("ft08", "wildcard_starts_with", "starts-with", "2-", "inclusive")
_register_wildcard("ft09", "wildcard_ends_with", "ends-with", "NT", "inclusive")
_register_wildcard("ft10", "wildcard_exact_match", "exact-match", "3-MEDIUM", "inclusive")
_register_wildcard("ft11", "wildcard_not_contains", "contains", "I", "exclusive")
_register_wildcard("ft12", "wildcard_not_starts_with", "starts-with", "2-", "exclusive")
_register_wildcard("ft13", "wildcard_not_ends_with", "ends-with", "NT", "exclusive")
_register_wildcard("ft14", "wildcard_not_exact_match", "exact-match", "3-MEDIUM", "exclusive")

# ---- FT15-FT17 -----------------------------------------------------------------
_register_top("ft15", "top_n", None, "top")
_register_top("ft16", "bottom_n", None, "bottom")
_register_condition("ft17", "condition", None)

# ---- FT18-FT20 -----------------------------------------------------------------
_register_range("ft18", "range_atleast", 400000.0, None)
_register_range("ft19", "range_atmost", None, 20000.0)
_register_range("ft20", "range_between", 100000.0, 150000.0)
_register_range("fx07", "range_dates_between", "#1996-01-01#", "#1996-03-31#", "o_date_n", "DATE '1996-01-01'", "DATE '1996-03-31'")

# ---- FT21-FT52 member filters on date parts (order as the template table) -------
_n = 21
for _part in ("yr", "mn", "wk", "dy", "qr", "wd", "my", "md"):
    for _mode, _null, _lab in (
        ("exclusive", True, "exclusive_null_dropped"),
        ("inclusive", True, "inclusive_null_kept"),
        ("exclusive", False, "exclusive"),
        ("inclusive", False, "inclusive"),
    ):
        _register_member(f"ft{_n:02d}", f"{_part}_{_lab}", _part, _mode, _null)
        _n += 1

# ---- FT53-FT68 top / bottom per date part ---------------------------------------
_n = 53
for _part in ("yr", "mn", "qr", "wk", "dy", "wd", "my", "md"):
    for _end in ("top", "bottom"):
        _register_top(f"ft{_n:02d}", f"{_part}_{_end}_n", _part, _end)
        _n += 1

# ---- FT69-FT76 condition per date part ------------------------------------------
_n = 69
for _part in ("yr", "mn", "qr", "wk", "dy", "wd", "my", "md"):
    _register_condition(f"ft{_n:02d}", f"{_part}_condition", _part)
    _n += 1


# ---- FX-06…FX-10 live filters on customer ---------------------------------------
def _cust_summary(df):
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("key_sum"))


def _cust_sql(where: str) -> str:
    return (
        "SELECT c_mktsegment, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer "
        f"WHERE {where} GROUP BY c_mktsegment"
    )


_LIVE = [
    ("fx06_live_in", "c_mktsegment", "in", ["BUILDING", "MACHINERY"], None, "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("fx06_live_not_in", "c_mktsegment", "not in", ["BUILDING", "MACHINERY"], None, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("fx07_live_greater", "c_acctbal", ">", 5000.0, None, "c_acctbal > 5000.0"),
    ("fx07_live_less", "c_acctbal", "<", 0.0, None, "c_acctbal < 0.0"),
    ("fx07_live_between", "c_acctbal", "between", (1000.0, 2000.0), None, "c_acctbal BETWEEN 1000.0 AND 2000.0"),
    ("fx08_live_not_null", "c_acctbal", "not null", None, None, "c_acctbal IS NOT NULL"),
    ("fx09_live_left_in", "c_name", "left in", ["Customer#0000001"], None, "left(c_name, 16) IN ('Customer#0000001')"),
    ("fx09_live_left_not_in", "c_name", "left not in", ["Customer#0000001"], None, "left(c_name, 16) NOT IN ('Customer#0000001')"),
    ("fx09_live_right_in", "c_name", "right in", ["7"], None, "right(c_name, 1) IN ('7')"),
    ("fx09_live_right_not_in", "c_name", "right not in", ["7"], None, "right(c_name, 1) NOT IN ('7')"),
    ("fx10_live_equal", "c_mktsegment", "=", "HOUSEHOLD", None, "c_mktsegment = 'HOUSEHOLD'"),
    ("fx10_live_not_equal", "c_mktsegment", "!=", "HOUSEHOLD", None, "c_mktsegment <> 'HOUSEHOLD'"),
]

for _name, _col, _op, _val, _n_chars, _sql in _LIVE:

    def _fn(spark, sf_dir, _col=_col, _op=_op, _val=_val, _n_chars=_n_chars):
        c = Tables(spark, sf_dir).customer
        return _cust_summary(c.filter(live_predicate(_col, _op, _val, _n_chars)))

    add(_name, _fn, _cust_sql(_sql))


# ---- FX-11 relative dates (anchor fixed for reproducibility) ---------------------
_REL = [
    ("day", -10, 0, "DATE '1998-06-15' + INTERVAL (-10) DAY", "DATE '1998-06-15' + INTERVAL 1 DAY"),
    ("week", -2, 0, "(DATE '1998-06-15' - CAST(dayofweek(DATE '1998-06-15') AS INTEGER)) + INTERVAL (-14) DAY",
     "(DATE '1998-06-15' - CAST(dayofweek(DATE '1998-06-15') AS INTEGER)) + INTERVAL 7 DAY"),
    ("month", -3, 0, "date_trunc('month', DATE '1998-06-15') + INTERVAL (-3) MONTH", "date_trunc('month', DATE '1998-06-15') + INTERVAL 1 MONTH"),
    ("quarter", -1, 1, "date_trunc('quarter', DATE '1998-06-15') + INTERVAL (-3) MONTH", "date_trunc('quarter', DATE '1998-06-15') + INTERVAL 6 MONTH"),
    ("year", -1, 0, "date_trunc('year', DATE '1998-06-15') + INTERVAL (-1) YEAR", "date_trunc('year', DATE '1998-06-15') + INTERVAL 1 YEAR"),
]
for _period, _first, _last, _lo, _hi in _REL:

    def _fn(spark, sf_dir, _period=_period, _first=_first, _last=_last):
        spec = FilterSpec("o_date_n", kind="relative_date", period=_period, first_period=_first, last_period=_last, anchor="1998-06-15", include_future=False)
        return summary(apply_filter(fixture(spark, sf_dir), spec))

    add(f"fx11_relative_{_period}", _fn, summary_sql(f"o_date_n >= CAST({_lo} AS DATE) AND o_date_n < CAST({_hi} AS DATE)"))


# ---- FX-12 filter on a calculated column -----------------------------------------
def _calc_filter(spark, sf_dir):
    fx = fixture(spark, sf_dir).withColumn(
        "size_class", F.when(F.col("o_totalprice") > 300000, "big").when(F.col("o_totalprice") > 100000, "mid").otherwise("small")
    )
    return summary(apply_filter(fx, FilterSpec("size_class", members=["big", "small"])))


add(
    "fx12_calculated_column_filter",
    _calc_filter,
    summary_sql("(CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END) IN ('big', 'small')"),
)


# ---- FX-13 parameter, FX-14/15 chips ---------------------------------------------
def _param(spark, sf_dir):
    return summary(parameter_filter(fixture(spark, sf_dir), "o_orderstatus", "F"))


add("fx13_parameter_filter", _param, summary_sql("o_orderstatus = 'F'"))


def _chips(spark, sf_dir):
    return summary(chip_filter(fixture(spark, sf_dir), o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus=["O", "F"]))


add("fx14_chip_filters", _chips, summary_sql("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'F')"))


# ---- combined filters: AND of row predicates + set filters (Q2) -------------------
def _combined(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    specs = [
        FilterSpec("o_prio_n", members=["1-URGENT", "2-HIGH", "%null%"]),
        FilterSpec("o_date_n", part="yr", mode="exclusive", members=["1995"]),
        FilterSpec("o_totalprice", kind="quantitative", min=50000.0),
        FilterSpec("o_date_n", kind="top", part="mn", count=6, expression=F.sum("o_totalprice")),
    ]
    return summary(apply_filters(fx, specs))


add(
    "fx05_combined_filters",
    _combined,
    summary_sql(
        "(o_prio_n IN ('1-URGENT', '2-HIGH') OR o_prio_n IS NULL) AND (year(o_date_n) NOT IN (1995)) AND o_totalprice > 50000.0 "
        "AND month(o_date_n) IN (SELECT k FROM (SELECT month(o_date_n) AS k, sum(o_totalprice) AS m FROM fx GROUP BY 1 "
        "ORDER BY m DESC NULLS LAST, k ASC NULLS FIRST LIMIT 6))"
    ),
)
