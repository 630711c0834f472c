"""Calculated-field functions (2.12) applied to whole driver tables.

Each query returns the table key plus one or more function results; doubles
are rounded to 6 digits on both sides.  Timestamps are returned as text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import calc as C
from lodestar.plans.registry import add
from lodestar.sources.tables import Tables

_KEYS = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}


def _reg(qid: str, table: str, cols: dict, prelude_spark=None, prelude_sql: str | None = None):
    """cols: name -> (spark Column builder taking the frame, SQL expression)."""
    key = _KEYS[table]

    def fn(spark, sf_dir):
        df = getattr(Tables(spark, sf_dir), table)
        if prelude_spark is not None:
            df = prelude_spark(df)
        return df.select(F.col(key), *[b(df).alias(n) if callable(b) else b.alias(n) for n, (b, _) in cols.items()])

    src = f"({prelude_sql}) t" if prelude_sql else table
    sql = f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in cols.items()) + f" FROM {src}"
    add(qid, fn, sql)


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------------ math
X = F.col("c_acctbal")
_reg("m01_abs", "customer", {"v": (C.abs_("c_acctbal"), "abs(c_acctbal)")})
_reg("m02_acos", "customer", {"v": (r6(C.acos(X / 5000)), "round(CASE WHEN c_acctbal / 5000 BETWEEN -1 AND 1 THEN acos(c_acctbal / 5000) END, 6)")})
_reg("m03_asin", "customer", {"v": (r6(C.asin(X / 5000)), "round(CASE WHEN c_acctbal / 5000 BETWEEN -1 AND 1 THEN asin(c_acctbal / 5000) END, 6)")})
_reg("m04_atan", "customer", {"v": (r6(C.atan(X / 1000)), "round(atan(c_acctbal / 1000), 6)")})
_reg("m05_atan2", "customer", {"v": (r6(C.atan2(X, F.col("c_custkey") + 1)), "round(atan2(c_acctbal, c_custkey + 1), 6)")})
_reg("m06_ceiling", "customer", {"v": (C.ceiling(X / 7), "CAST(ceil(c_acctbal / 7) AS BIGINT)")})
_reg("m07_cos", "customer", {"v": (r6(C.cos(X)), "round(cos(c_acctbal), 6)")})
_reg("m08_cot", "customer", {"v": (r6(C.cot(X / 1000)), "round(CASE WHEN tan(c_acctbal / 1000) <> 0 THEN cot(c_acctbal / 1000) END, 6)")})
_reg("m09_degrees", "customer", {"v": (r6(C.degrees(X / 1000)), "round(degrees(c_acctbal / 1000), 6)")})
_reg(
    "m10_div",
    "customer",
    {
        "safe": (r6(C.div("c_acctbal", "c_nationkey")), "round(c_acctbal / nullif(c_nationkey, 0), 6)"),
        "intdiv": (C.int_div("c_custkey", "c_nationkey"), "c_custkey // nullif(c_nationkey, 0)"),
    },
)
_reg("m11_exp", "customer", {"v": (r6(C.exp(X / 10000)), "round(exp(c_acctbal / 10000), 6)")})
_reg("m12_floor", "customer", {"v": (C.floor(X / 7), "CAST(floor(c_acctbal / 7) AS BIGINT)")})
_reg("m13_ln", "customer", {"v": (r6(C.ln(X)), "round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6)")})
_reg(
    "m14_log",
    "customer",
    {
        "log10": (r6(C.log(X)), "round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6)"),
        "log2": (r6(C.log(X, 2)), "round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) / ln(2) END, 6)"),
    },
)
_reg("m15_pi", "customer", {"v": (r6(C.pi() * F.col("c_nationkey")), "round(pi() * c_nationkey, 6)")})
_reg(
    "m16_power",
    "customer",
    {
        "sq": (C.power("c_nationkey", 2), "pow(c_nationkey, 2)"),
        "cube": (r6(C.power(X / 1000, 3)), "round(pow(c_acctbal / 1000, 3), 6)"),
    },
)
_reg("m17_radians", "customer", {"v": (r6(C.radians(X)), "round(radians(c_acctbal), 6)")})
_reg("m18_round", "customer", {"v": (C.round_(X / 4, 1), "round(c_acctbal / 4, 1)")})
_reg("m19_sign", "customer", {"v": (C.sign(X), "CAST(sign(c_acctbal) AS DOUBLE)")})
_reg("m20_sin", "customer", {"v": (r6(C.sin(X)), "round(sin(c_acctbal), 6)")})
_reg("m21_sqrt", "customer", {"v": (r6(C.sqrt(X)), "round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6)")})
_reg("m22_square", "customer", {"v": (r6(C.square(X / 100)), "round((c_acctbal / 100) * (c_acctbal / 100), 6)")})
_reg("m23_tan", "customer", {"v": (r6(C.tan(X / 1000)), "round(tan(c_acctbal / 1000), 6)")})
_reg(
    "m24_zn",
    "customer",
    {"v": (C.zn(F.when(F.col("c_mktsegment") != "BUILDING", X)), "coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END, 0)")},
)
_LAT = "(c_acctbal / 10000 * 80)"
_LON = "(c_nationkey * 7.0 - 80)"
_reg(
    "m25_distance",
    "customer",
    {
        "km": (
            r6(C.distance(X / 10000 * 80, F.col("c_nationkey") * 7.0 - 80, F.lit(40.7), F.lit(-74.0))),
            f"round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(40.7) - radians({_LAT})) / 2), 2) + "
            f"cos(radians({_LAT})) * cos(radians(40.7)) * pow(sin((radians(-74.0) - radians({_LON})) / 2), 2)))), 6)",
        )
    },
)
_HX = "(c_acctbal / 1000)"
_HY = "(c_nationkey / 3)"
_AX = f"(round({_HX} / sqrt(3)) * sqrt(3))"
_AY = f"(round({_HY} / 3.0) * 3.0)"
_BX = f"(floor({_HX} / sqrt(3)) * sqrt(3) + sqrt(3) / 2)"
_BY = f"(floor({_HY} / 3.0) * 3.0 + 1.5)"
_USE_A = f"(pow({_HX} - {_AX}, 2) + pow({_HY} - {_AY}, 2) <= pow({_HX} - {_BX}, 2) + pow({_HY} - {_BY}, 2))"
_reg(
    "m26_hexbinx",
    "customer",
    {"v": (r6(C.hexbinx(X / 1000, F.col("c_nationkey") / 3)), f"round(CASE WHEN {_USE_A} THEN {_AX} ELSE {_BX} END, 6)")},
)
_reg(
    "m27_hexbiny",
    "customer",
    {"v": (r6(C.hexbiny(X / 1000, F.col("c_nationkey") / 3)), f"round(CASE WHEN {_USE_A} THEN {_AY} ELSE {_BY} END, 6)")},
)

# ---------------------------------------------------------------------- string
_reg("s01_ascii", "part", {"v": (C.ascii_("p_name"), "ascii(p_name)")})
_reg("s02_char", "part", {"v": (C.char(F.col("p_size") + 64), "chr(p_size + 64)")})
_reg(
    "s03_contains",
    "part",
    {
        "cs": (C.contains("p_name", F.lit("ring")), "contains(p_name, 'ring')"),
        "ci": (C.contains("p_name", F.lit("RING"), case_insensitive=True), "contains(lower(p_name), lower('RING'))"),
    },
)
_reg("s04_concat", "part", {"v": (C.concat("p_brand", F.lit("-"), "p_type"), "concat(p_brand, '-', p_type)")})
_reg("s05_endswith", "part", {"v": (C.endswith("p_name", F.lit("bolt")), "ends_with(p_name, 'bolt')")})
_reg(
    "s06_find",
    "part",
    {
        "pos": (C.find("p_name", "e"), "CAST(strpos(p_name, 'e') AS INTEGER)"),
        "pos_from3": (
            C.find("p_name", "e", 3),
            "CAST(CASE WHEN strpos(substr(p_name, 3), 'e') > 0 THEN strpos(substr(p_name, 3), 'e') + 2 ELSE 0 END AS INTEGER)",
        ),
    },
)
_reg(
    "s07_findnth",
    "part",
    {
        "v": (
            C.findnth("p_name", "e", 2),
            "CAST(CASE WHEN length(p_name) - length(replace(p_name, 'e', '')) >= 2 "
            "THEN strpos(p_name, 'e') + strpos(substr(p_name, strpos(p_name, 'e') + 1), 'e') ELSE 0 END AS INTEGER)",
        )
    },
)
_reg("s08_left", "part", {"v": (C.left("p_name", F.lit(4)), "left(p_name, 4)")})
_reg("s09_right", "part", {"v": (C.right("p_name", F.lit(3)), "right(p_name, 3)")})
_reg("s10_len", "part", {"v": (C.len_("p_name"), "CAST(length(p_name) AS INTEGER)")})
_reg("s11_lower", "part", {"v": (C.lower("p_brand"), "lower(p_brand)")})
_reg("s12_ltrim", "part", {"v": (C.ltrim(F.concat(F.lit("  "), F.col("p_name"))), "ltrim(concat('  ', p_name))")})
_reg(
    "s13_mid",
    "part",
    {
        "with_len": (C.mid("p_name", F.lit(3), F.lit(4)), "substr(p_name, 3, 4)"),
        "to_end": (C.mid("p_name", F.lit(3)), "substr(p_name, 3)"),
    },
)
_reg("s14_replace", "part", {"v": (C.replace("p_name", F.lit("e"), F.lit("E")), "replace(p_name, 'e', 'E')")})
_reg("s15_rtrim", "part", {"v": (C.rtrim(F.concat(F.col("p_name"), F.lit("  "))), "rtrim(concat(p_name, '  '))")})
_reg("s16_space", "part", {"v": (F.concat(C.space(F.col("p_size") % 4), F.lit("|")), "concat(repeat(' ', p_size % 4), '|')")})
_reg(
    "s17_split",
    "part",
    {
        "second": (C.split("p_brand", "#", 2), "split_part(p_brand, '#', 2)"),
        "last": (C.split("p_name", " ", -1), "split_part(p_name, ' ', -1)"),
    },
)
_reg("s18_startswith", "part", {"v": (C.startswith("p_name", F.lit("small")), "starts_with(p_name, 'small')")})
_reg("s19_str", "part", {"v": (C.str_("p_size"), "CAST(p_size AS VARCHAR)")})
_reg("s20_trim", "part", {"v": (C.trim(F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))), "trim(concat(' ', p_type, ' '))")})
_reg("s21_upper", "part", {"v": (C.upper("p_name"), "upper(p_name)")})

# ----------------------------------------------------------------------- dates
D = F.col("o_orderdate")
DSQL = "CAST(o_orderdate AS DATE)"
B_DATE = F.to_date(F.lit("1999-12-31"))
B_TS = F.to_timestamp_ntz(F.lit("1999-12-31 13:45:30"))
ISOQ = "least((week({d}) - 1) // 13 + 1, 4)"
ISO_START = "(make_date({y}, 1, 4) - CAST(isodow(make_date({y}, 1, 4)) - 1 AS INTEGER))"


def _ts_text(c):
    return c.cast("string")


_reg("d01_date", "orders", {"v": (C.date(D), DSQL)})
_reg("d05_datepart", "orders", {"v": (C.datepart("month", D), f"CAST(month({DSQL}) AS INTEGER)")})
_reg("d06_day", "orders", {"v": (C.day(D), f"CAST(day({DSQL}) AS INTEGER)")})
_reg(
    "d07_isdate",
    "orders",
    {
        "v": (
            C.isdate(F.when(F.col("o_orderstatus") == "F", F.date_format(D, "yyyy-MM-dd")).otherwise(F.concat(F.year(D).cast("string"), F.lit("-02-30")))),
            f"TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN strftime({DSQL}, '%Y-%m-%d') ELSE concat(CAST(year({DSQL}) AS VARCHAR), '-02-30') END AS DATE) IS NOT NULL",
        )
    },
)
_reg("d08_isoquarter", "orders", {"v": (C.isoquarter(D), "CAST(" + ISOQ.format(d=DSQL) + " AS INTEGER)")})
_reg("d09_isoweek", "orders", {"v": (C.isoweek(D), f"CAST(week({DSQL}) AS INTEGER)")})
_reg("d10_isoweekday", "orders", {"v": (C.isoweekday(D), f"CAST(isodow({DSQL}) AS INTEGER)")})
_reg("d11_isoyear", "orders", {"v": (C.isoyear(D), f"CAST(isoyear({DSQL}) AS INTEGER)")})
_reg("d12_makedate", "orders", {"v": (C.makedate(F.year(D), F.month(D), F.lit(1)), f"make_date(year({DSQL}), month({DSQL}), 1)")})
_reg(
    "d13_makedatetime",
    "orders",
    {"v": (_ts_text(C.makedatetime(D, B_TS)), f"CAST(CAST({DSQL} AS TIMESTAMP) + INTERVAL '13:45:30' AS VARCHAR)")},
)
_reg(
    "d14_maketime",
    "orders",
    {
        "v": (
            _ts_text(C.maketime(F.pmod(F.col("o_orderkey"), F.lit(24)), F.lit(30), F.lit(15))),
            "CAST(make_timestamp(1899, 12, 30, o_orderkey % 24, 30, 15) AS VARCHAR)",
        )
    },
)
_reg("d15_month", "orders", {"v": (C.month(D), f"CAST(month({DSQL}) AS INTEGER)")})
_reg("d16_now", "orders", {"v": (C.now().cast("date") > C.date(D), f"current_date > {DSQL}")})
_reg("d16_now_as_of", "orders", {"v": (C.now("1996-07-01 12:00:00") > F.col("o_orderdate"), "TIMESTAMP '1996-07-01 12:00:00' > o_orderdate")})
_reg("d17_quarter", "orders", {"v": (C.quarter(D), f"CAST(quarter({DSQL}) AS INTEGER)")})
_reg("d18_today", "orders", {"v": (C.today() > C.date(D), f"current_date > {DSQL}")})
_reg("d18_today_as_of", "orders", {"v": (C.today("1996-07-01") > C.date(D), f"DATE '1996-07-01' > {DSQL}")})
_reg("d19_week", "orders", {"v": (C.week(D), f"CAST(week({DSQL}) AS INTEGER)")})
_reg("d20_year", "orders", {"v": (C.year(D), f"CAST(year({DSQL}) AS INTEGER)")})
_reg(
    "d21_diff_time",
    "orders",
    {"v": (C.diff_time(B_TS, D), "CAST(epoch(TIMESTAMP '1999-12-31 13:45:30') - epoch(o_orderdate) AS BIGINT)")},
)

# DATEADD parts (DP01-DP14): fixed values  part -> (n, DuckDB expression)
_ADD = [
    ("dp01", "day", 10, f"{DSQL} + INTERVAL 10 DAY", False),
    ("dp02", "dayofyear", 40, f"{DSQL} + INTERVAL 40 DAY", False),
    ("dp03", "hour", 5, "CAST(o_orderdate + INTERVAL 5 HOUR AS VARCHAR)", True),
    ("dp04", "iso-quarter", 2, f"{DSQL} + INTERVAL 6 MONTH", False),
    ("dp05", "iso-week", 3, f"{DSQL} + INTERVAL 21 DAY", False),
    ("dp06", "iso-weekday", 4, f"{DSQL} + INTERVAL 4 DAY", False),
    (
        "dp07",
        "iso-year",
        1,
        f"{DSQL} + CAST({ISO_START.format(y=f'isoyear({DSQL}) + 1')} - {ISO_START.format(y=f'isoyear({DSQL})')} AS INTEGER)",
        False,
    ),
    ("dp08", "minute", 90, "CAST(o_orderdate + INTERVAL 90 MINUTE AS VARCHAR)", True),
    ("dp09", "month", 5, f"{DSQL} + INTERVAL 5 MONTH", False),
    ("dp10", "quarter", -3, f"{DSQL} + INTERVAL (-9) MONTH", False),
    ("dp11", "second", 3725, "CAST(o_orderdate + INTERVAL 3725 SECOND AS VARCHAR)", True),
    ("dp12", "week", -2, f"{DSQL} + INTERVAL (-14) DAY", False),
    ("dp13", "weekday", 3, f"{DSQL} + INTERVAL 3 DAY", False),
    ("dp14", "year", 2, f"{DSQL} + INTERVAL 2 YEAR", False),
]
for _id, _part, _n, _sql, _ts in _ADD:
    _spark = C.dateadd(_part, _n, D)
    if _ts:
        _spark = _ts_text(_spark)
    sql_expr = _sql if _ts else f"CAST({_sql} AS DATE)"
    _reg(f"{_id}_dateadd_{_part.replace('-', '_')}", "orders", {"v": (_spark, sql_expr)})

# DATEDIFF parts (DP15-DP28) from o_orderdate to 1999-12-31 (13:45:30 for time parts)
B = "DATE '1999-12-31'"
BT = "TIMESTAMP '1999-12-31 13:45:30'"
_DIFF = [
    ("dp15", "day", f"CAST({B} - {DSQL} AS INTEGER)", False),
    ("dp16", "dayofyear", f"CAST({B} - {DSQL} AS INTEGER)", False),
    ("dp17", "hour", f"date_diff('hour', o_orderdate, {BT})", True),
    ("dp18", "iso-quarter", f"CAST((isoyear({B}) - isoyear({DSQL})) * 4 + {ISOQ.format(d=B)} - {ISOQ.format(d=DSQL)} AS INTEGER)", False),
    ("dp19", "iso-week", f"CAST((CAST(date_trunc('week', {B}) AS DATE) - CAST(date_trunc('week', {DSQL}) AS DATE)) // 7 AS INTEGER)", False),
    ("dp20", "iso-weekday", f"CAST({B} - {DSQL} AS INTEGER)", False),
    ("dp21", "iso-year", f"CAST(isoyear({B}) - isoyear({DSQL}) AS INTEGER)", False),
    ("dp22", "minute", f"date_diff('minute', o_orderdate, {BT})", True),
    ("dp23", "month", f"CAST((year({B}) - year({DSQL})) * 12 + month({B}) - month({DSQL}) AS INTEGER)", False),
    ("dp24", "quarter", f"CAST((year({B}) - year({DSQL})) * 4 + quarter({B}) - quarter({DSQL}) AS INTEGER)", False),
    ("dp25", "second", f"date_diff('second', o_orderdate, {BT})", True),
    (
        "dp26",
        "week",
        f"CAST((({B} - CAST(dayofweek({B}) AS INTEGER)) - ({DSQL} - CAST(dayofweek({DSQL}) AS INTEGER))) // 7 AS INTEGER)",
        False,
    ),
    ("dp27", "weekday", f"CAST({B} - {DSQL} AS INTEGER)", False),
    ("dp28", "year", f"CAST(year({B}) - year({DSQL}) AS INTEGER)", False),
]
for _id, _part, _sql, _ts in _DIFF:
    _spark = C.datediff(_part, D, B_TS if _ts else B_DATE)
    _reg(f"{_id}_datediff_{_part.replace('-', '_')}", "orders", {"v": (_spark, _sql)})

# DATENAME parts (DP29-DP42) on o_orderdate shifted by a key-dependent time of day
TSX = F.timestamp_add("SECOND", F.col("o_orderkey") * 37 % 86400, D.cast("timestamp_ntz"))
TSX_SQL = "(o_orderdate + to_seconds(o_orderkey * 37 % 86400))"
_NAME = [
    ("dp29", "day", f"CAST(day({TSX_SQL}) AS VARCHAR)"),
    ("dp30", "dayofyear", f"CAST(dayofyear({TSX_SQL}) AS VARCHAR)"),
    ("dp31", "hour", f"CAST(hour({TSX_SQL}) AS VARCHAR)"),
    ("dp32", "iso-quarter", "CAST(" + ISOQ.format(d=TSX_SQL) + " AS VARCHAR)"),
    ("dp33", "iso-week", f"CAST(week({TSX_SQL}) AS VARCHAR)"),
    ("dp34", "iso-weekday", f"CAST(isodow({TSX_SQL}) AS VARCHAR)"),
    ("dp35", "iso-year", f"CAST(isoyear({TSX_SQL}) AS VARCHAR)"),
    ("dp36", "minute", f"CAST(minute({TSX_SQL}) AS VARCHAR)"),
    ("dp37", "month", f"monthname({TSX_SQL})"),
    ("dp38", "quarter", f"CAST(quarter({TSX_SQL}) AS VARCHAR)"),
    ("dp39", "second", f"CAST(second({TSX_SQL}) AS VARCHAR)"),
    ("dp40", "week", f"CAST(week({TSX_SQL}) AS VARCHAR)"),
    ("dp41", "weekday", f"dayname({TSX_SQL})"),
    ("dp42", "year", f"CAST(year({TSX_SQL}) AS VARCHAR)"),
]
for _id, _part, _sql in _NAME:
    _reg(f"{_id}_datename_{_part.replace('-', '_')}", "orders", {"v": (C.datename(_part, TSX), _sql)})

# DP43 start-of-week argument: weeks starting Monday (1) and Saturday (6)
_reg(
    "dp43_start_of_week",
    "orders",
    {
        "mon": (C.datetrunc("week", D, week_start=1), f"CAST(date_trunc('week', {DSQL}) AS DATE)"),
        "sat": (C.datetrunc("week", D, week_start=6), f"{DSQL} - CAST((dayofweek({DSQL}) + 1) % 7 AS INTEGER)"),
        "diff_mon": (C.datediff("week", D, B_DATE, week_start=1), f"CAST((CAST(date_trunc('week', {B}) AS DATE) - CAST(date_trunc('week', {DSQL}) AS DATE)) // 7 AS INTEGER)"),
    },
)
# DP44 double-quoted part spelling
_reg("dp44_quoted_part", "orders", {"v": (C.datediff('"month"', D, B_DATE), f"CAST((year({B}) - year({DSQL})) * 12 + month({B}) - month({DSQL}) AS INTEGER)")})

# ------------------------------------------------------------------ logic (L)
P = F.col("o_totalprice")
PRIO_N = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
PRIO_N_SQL = "nullif(o_orderpriority, '5-LOW')"
_reg("l01_if", "orders", {"v": (C.if_(P > 250000, F.lit("high")), "CASE WHEN o_totalprice > 250000 THEN 'high' END")})
_reg(
    "l02_elseif",
    "orders",
    {
        "v": (
            C.if_chain([(P > 400000, F.lit("xl")), (P > 250000, F.lit("l")), (P > 100000, F.lit("m"))], F.lit("s")),
            "CASE WHEN o_totalprice > 400000 THEN 'xl' WHEN o_totalprice > 250000 THEN 'l' WHEN o_totalprice > 100000 THEN 'm' ELSE 's' END",
        )
    },
)
_reg(
    "l03_case",
    "orders",
    {
        "v": (
            C.case("o_orderstatus", [("F", F.lit("final")), ("O", F.lit("open"))], F.lit("pending")),
            "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END",
        )
    },
)
_reg(
    "l04_iif",
    "orders",
    {
        "v": (
            C.iif(PRIO_N == "1-URGENT", F.lit("urgent"), F.lit("other"), F.lit("unknown")),
            f"CASE WHEN ({PRIO_N_SQL} = '1-URGENT') IS NULL THEN 'unknown' WHEN {PRIO_N_SQL} = '1-URGENT' THEN 'urgent' ELSE 'other' END",
        )
    },
)
_reg("l05_ifnull", "orders", {"v": (C.ifnull(PRIO_N, F.lit("none")), f"coalesce({PRIO_N_SQL}, 'none')")})
_reg("l06_isnull", "orders", {"v": (C.isnull(PRIO_N), f"{PRIO_N_SQL} IS NULL")})
_reg(
    "l07_and",
    "orders",
    {"v": (C.and_(P > 100000, PRIO_N == "2-HIGH"), f"o_totalprice > 100000 AND {PRIO_N_SQL} = '2-HIGH'")},
)
_reg(
    "l08_or",
    "orders",
    {"v": (C.or_(P > 400000, PRIO_N == "2-HIGH"), f"o_totalprice > 400000 OR {PRIO_N_SQL} = '2-HIGH'")},
)
_reg("l09_not", "orders", {"v": (C.not_(PRIO_N == "2-HIGH"), f"NOT ({PRIO_N_SQL} = '2-HIGH')")})
_reg("l10_in", "orders", {"v": (C.in_("o_orderstatus", ["F", "P"]), "o_orderstatus IN ('F', 'P')")})
_reg(
    "l11_comparison",
    "orders",
    {
        "eq": (P == 112946.26, "o_totalprice = 112946.26"),
        "ne": (F.col("o_orderstatus") != "F", "o_orderstatus <> 'F'"),
        "gt": (P > 250000, "o_totalprice > 250000"),
        "ge": (P >= 250000, "o_totalprice >= 250000"),
        "lt": (P < 250000, "o_totalprice < 250000"),
        "le": (P <= 250000, "o_totalprice <= 250000"),
    },
)
_reg(
    "l12_arithmetic",
    "orders",
    {
        "plus": (r6(P + 1.5), "round(o_totalprice + 1.5, 6)"),
        "minus": (r6(P - F.col("o_orderkey")), "round(o_totalprice - o_orderkey, 6)"),
        "times": (r6(P * 0.07), "round(o_totalprice * 0.07, 6)"),
        "divide": (r6(C.safe_divide(P, F.col("o_orderkey") % 7)), "round(o_totalprice / nullif(o_orderkey % 7, 0), 6)"),
        "modulo": (F.col("o_orderkey") % 7, "o_orderkey % 7"),
    },
)
_reg("l13_power_operator", "orders", {"v": (r6(C.power(P / 100000, 2)), "round(pow(o_totalprice / 100000, 2), 6)")})
_reg(
    "l14_literals",
    "orders",
    {
        "after": (C.date(D) >= C.date_literal("#1998-01-01#"), f"{DSQL} >= DATE '1998-01-01'"),
        "flag": (F.lit(True) & (P > 0), "true AND o_totalprice > 0"),
        "txt": (F.lit("x"), "'x'"),
        "num": (F.lit(1.5) * 2, "CAST(1.5 * 2 AS DOUBLE)"),
    },
)

# -------------------------------------------------------------- helpers (N)
_reg("n01_null_to_blank", "orders", {"v": (C.null_to_blank(PRIO_N), f"coalesce({PRIO_N_SQL}, ' ')")})
_reg("n02_null_test", "orders", {"v": (F.when(PRIO_N.isNull(), F.lit("  ")).otherwise(PRIO_N), f"CASE WHEN {PRIO_N_SQL} IS NULL THEN '  ' ELSE {PRIO_N_SQL} END")})
_reg(
    "n06_regex_capture",
    "part",
    {
        "v": (
            C.regex_capture(F.concat(F.lit('<connection class="'), F.col("p_type"), F.lit('" dbname="x"/>')), 'class="([^"]+)"'),
            "regexp_extract(concat('<connection class=\"', p_type, '\" dbname=\"x\"/>'), 'class=\"([^\"]+)\"', 1)",
        )
    },
)
_reg(
    "n07_md5_key",
    "part",
    {"v": (C.md5_key("p_partkey", "p_name", "p_size"), "md5(concat(coalesce(CAST(p_partkey AS VARCHAR), ''), coalesce(p_name, ''), coalesce(CAST(p_size AS VARCHAR), '')))")},
)
_reg(
    "n08_char_replacement",
    "part",
    {"v": (C.clean_table_name(F.concat(F.col("p_brand"), F.lit("$x"))), "replace(replace(concat(p_brand, '$x'), '#', '.'), '$', '')")},
)
_reg(
    "io08_file_name_normaliser",
    "part",
    {"v": (C.normalize_file_name(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"))), "lower(replace(regexp_replace(concat(p_brand, ' ', p_name), '[^a-zA-Z0-9\\s]', '', 'g'), ' ', '_'))")},
)
