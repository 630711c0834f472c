"""Workbook filters as DataFrame operators (FT01…FT76, FX-01…FX-15).

Each ``FilterSpec`` is what a workbook stores for one filter.  Row-level
kinds (member, wildcard, range, relative date, live filters) become one
Column predicate, so Catalyst pushes them into the parquet scan.  Set-level
kinds (top/bottom-N, condition) aggregate the base table by the filter key
and keep matching rows with a ``left_semi`` join — a filter never multiplies
rows (Q1).  The top-N key set has at most ``count`` rows, so it is broadcast
with a proven bound; a condition's key set has no bound and is left to AQE.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dateparts import member_value, part_key

NULL_MEMBER = "%null%"


@dataclass
class FilterSpec:
    column: str
    kind: str = "general"  # general | wildcard | top | condition | intersection | quantitative | relative_date
    mode: str = "inclusive"  # inclusive | exclusive (ui-enumeration)
    part: str | None = None  # date part code (FX-04)
    members: list = field(default_factory=list)
    include_null: bool | None = None  # None: decided by a %null% member (FX-01)
    pattern_type: str | None = None  # contains | starts-with | ends-with | exact-match
    pattern: str | None = None
    end: str = "top"  # top | bottom
    count: int | None = None
    expression: Column | None = None  # aggregate for top / condition
    condition: Column | None = None  # predicate on the aggregate column "_measure"
    min: object = None
    max: object = None
    inclusive_range: bool = False  # Q10: strict > / < by default
    include_all: bool = False  # intersection: empty means all
    # relative date (FX-11)
    period: str | None = None  # day | week | month | quarter | year
    first_period: int = 0
    last_period: int = 0
    anchor: object = None
    include_future: bool = True
    keep_null_dates: bool = False
    week_start: int = 0
    keep_null: bool = False  # Q21 option for exclusive member filters


def clean_date_literal(v):
    """P-08: ``#2020-01-31#`` -> date; other values unchanged."""
    if isinstance(v, str):
        m = re.fullmatch(r"\s*#?(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}:\d{2}))?#?\s*", v)
        if m:
            if m.group(2):
                return _dt.datetime.fromisoformat(f"{m.group(1)} {m.group(2)}")
            return _dt.date.fromisoformat(m.group(1))
    return v


def clean_date_literal_col(col: Column) -> Column:
    """P-08 as a Column: extract ``YYYY-MM-DD`` between ``#`` marks."""
    return F.try_to_date(F.regexp_extract(col, r"#?(\d{4}-\d{2}-\d{2})", 1))


def _members(spec: FilterSpec):
    include_null = spec.include_null
    vals = []
    for m in spec.members:
        if m == NULL_MEMBER or m is None:
            include_null = True if include_null is None else include_null
            continue
        vals.append(member_value(spec.part, m))
    return vals, bool(include_null)


#: Members of a top-N set up to which it is broadcast.
MAX_BROADCAST_MEMBERS = 100_000
#: Date parts whose members are contiguous periods.
RANGE_PARTS = ("yr", "my", "md")


def _periods(part: str, members: list[int]) -> list[tuple[_dt.date, _dt.date]]:
    """[first day, day after the last) of year, month and day members; neighbours are
    merged, members that are no date match nothing."""
    spans = []
    for m in sorted(set(members)):
        try:
            if part == "yr":
                lo, hi = _dt.date(m, 1, 1), _dt.date(m + 1, 1, 1)
            elif part == "my":
                lo = _dt.date(m // 100, m % 100, 1)
                hi = _dt.date(lo.year + lo.month // 12, lo.month % 12 + 1, 1)
            else:
                lo = _dt.date(m // 10000, m // 100 % 100, m % 100)
                hi = lo + _dt.timedelta(days=1)
        except (ValueError, OverflowError):
            continue
        if spans and spans[-1][1] == lo:
            spans[-1] = (spans[-1][0], hi)
        else:
            spans.append((lo, hi))
    return spans


def member_predicate(spec: FilterSpec) -> Column | None:
    """FT01-FT04, FT21-FT52: member lists, optional date part, null handling."""
    p = part_key(spec.column, spec.part, spec.week_start)
    vals, with_null = _members(spec)
    if not vals and not with_null:
        return None  # Q27: empty member list -> no filter
    inside = p.isin(vals) if vals else F.lit(False)
    if spec.mode != "exclusive" and vals and spec.part in RANGE_PARTS:
        # whole periods are ranges of the raw column, which the scan can prune by
        ranges = [(F.col(spec.column) >= F.lit(lo)) & (F.col(spec.column) < F.lit(hi)) for lo, hi in _periods(spec.part, vals)]
        inside = reduce(lambda a, b: a | b, ranges, F.lit(False)) if len(ranges) != 1 else ranges[0]
        p = F.col(spec.column)
    if spec.mode == "exclusive":
        pred = ~inside
        if with_null:
            # FT01: NOT IN members AND NOT NULL
            return pred & p.isNotNull()
        if spec.keep_null:
            return pred | p.isNull()
        return pred  # Q21: three-valued logic drops NULL
    if with_null:
        return inside | p.isNull()  # FT02
    return inside


def _escape_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def wildcard_predicate(spec: FilterSpec) -> Column:
    """FT07-FT14: contains / starts-with / ends-with / exact-match, negated when exclusive."""
    c = F.col(spec.column)
    pat = F.lit(spec.pattern)
    t = spec.pattern_type
    if t == "contains":
        pred = F.contains(c, pat)
    elif t == "starts-with":
        pred = F.startswith(c, pat)
    elif t == "ends-with":
        pred = F.endswith(c, pat)
    elif t == "exact-match":
        pred = c == pat
    else:
        raise ValueError(f"unknown pattern type {t!r}")
    return ~pred if spec.mode == "exclusive" else pred


def range_predicate(spec: FilterSpec) -> Column | None:
    """FT18-FT20: atleast / atmost (strict unless ``inclusive_range``) / between."""
    c = part_key(spec.column, spec.part)
    lo = clean_date_literal(spec.min)
    hi = clean_date_literal(spec.max)
    if lo is not None and hi is not None:
        return c.between(F.lit(lo), F.lit(hi))
    if lo is not None:
        return c >= F.lit(lo) if spec.inclusive_range else c > F.lit(lo)
    if hi is not None:
        return c <= F.lit(hi) if spec.inclusive_range else c < F.lit(hi)
    return c.isNotNull()  # FX-08: undefined range -> non-null


def quantitative_kind(min_col: Column, max_col: Column) -> Column:
    """EX-19: min and max -> between; min -> atleast; max -> atmost; none -> undefined."""
    return (
        F.when(min_col.isNotNull() & max_col.isNotNull(), "between")
        .when(min_col.isNotNull(), "atleast")
        .when(max_col.isNotNull(), "atmost")
        .otherwise("undefined")
    )


def _period_start(anchor: Column, period: str, week_start: int) -> Column:
    if period == "day":
        return anchor
    if period == "week":
        # start of week relative to week_start (0 = Sunday)
        dow = F.pmod(F.dayofweek(anchor) - 1 - F.lit(week_start), F.lit(7))
        return F.date_sub(anchor, dow)
    if period == "month":
        return F.trunc(anchor, "month")
    if period == "quarter":
        return F.trunc(anchor, "quarter")
    if period == "year":
        return F.trunc(anchor, "year")
    raise ValueError(period)


def _shift(d: Column, period: str, n: int) -> Column:
    if period == "day":
        return F.date_add(d, n)
    if period == "week":
        return F.date_add(d, 7 * n)
    if period == "month":
        return F.add_months(d, n)
    if period == "quarter":
        return F.add_months(d, 3 * n)
    if period == "year":
        return F.add_months(d, 12 * n)
    raise ValueError(period)


def relative_date_predicate(spec: FilterSpec) -> Column:
    """FX-11: keep dates in [anchor period + first, anchor period + last].

    The anchor defaults to ``current_date()``; pass ``anchor`` (an as-of date)
    for reproducible results.
    """
    anchor = F.lit(clean_date_literal(spec.anchor)).cast("date") if spec.anchor is not None else F.current_date()
    start = _period_start(anchor, spec.period, spec.week_start)
    lo = _shift(start, spec.period, spec.first_period)
    hi = _shift(start, spec.period, spec.last_period + 1)
    d = F.col(spec.column)  # the bounds are days, so the raw column compares alike and the scan can prune by it
    pred = (d >= lo) & (d < hi)
    if spec.include_future:
        pred = pred | (d >= hi)
    if spec.keep_null_dates:
        pred = pred | d.isNull()
    return pred


def row_predicate(spec: FilterSpec) -> Column | None:
    if spec.kind == "general":
        return member_predicate(spec)
    if spec.kind == "wildcard":
        return wildcard_predicate(spec)
    if spec.kind == "quantitative":
        return range_predicate(spec)
    if spec.kind == "relative_date":
        return relative_date_predicate(spec)
    if spec.kind == "intersection":
        # FT05/FT06: the template "NOT LIKE '%'" keeps no row; include_all keeps all.
        return None if spec.include_all else F.lit(False)
    return None


def key_set(base: DataFrame, spec: FilterSpec) -> DataFrame:
    """Key values kept by a top/bottom-N (FT15/16, FT53-68) or condition filter
    (FT17, FT69-76), aggregated on the unfiltered ``base`` table."""
    key = part_key(spec.column, spec.part, spec.week_start).alias("_key")
    agg = base.groupBy(key).agg(spec.expression.alias("_measure"))
    if spec.kind == "top":
        order = F.col("_measure").desc_nulls_last() if spec.end == "top" else F.col("_measure").asc_nulls_last()
        # Q3: ties broken by the member, ascending.  TakeOrderedAndProject:
        # each task keeps its best n, the driver merges n x tasks rows.
        keys = agg.orderBy(order, F.col("_key").asc_nulls_first()).limit(int(spec.count)).select("_key")
        return F.broadcast(keys) if int(spec.count) <= MAX_BROADCAST_MEMBERS else keys  # at most `count` rows
    if spec.kind == "condition":
        return agg.filter(spec.condition).select("_key")
    raise ValueError(spec.kind)


def apply_filter(df: DataFrame, spec: FilterSpec, base: DataFrame | None = None) -> DataFrame:
    if spec.kind in ("top", "condition"):
        keys = key_set(base if base is not None else df, spec)
        k = part_key(spec.column, spec.part, spec.week_start)
        return df.join(keys, k == keys["_key"], "left_semi")
    pred = row_predicate(spec)
    return df if pred is None else df.filter(pred)


def apply_filters(df: DataFrame, specs: list[FilterSpec], base: DataFrame | None = None) -> DataFrame:
    """All filters AND-ed (each predicate parenthesised, Q2).  Row predicates are
    combined into one ``filter``; set filters follow as semi-joins."""
    preds = [p for p in (row_predicate(s) for s in specs if s.kind not in ("top", "condition")) if p is not None]
    out = df.filter(reduce(lambda a, b: a & b, preds)) if preds else df
    for s in specs:
        if s.kind in ("top", "condition"):
            out = apply_filter(out, s, base if base is not None else df)
    return out


# ---------------------------------------------------------------- live filters
def live_predicate(column: str, operation: str, value=None, n: int | None = None) -> Column:
    """FX-06…FX-10: the live-connection filter forms.

    operation: in, not in, >, <, between, not null, left in, right in,
    left not in, right not in, =, !=.
    """
    c = F.col(column)
    if operation in ("in", "not in"):
        vals = list(value)
        has_null = NULL_MEMBER in vals  # Q26: same null handling as FX-01
        vals = [v for v in vals if v != NULL_MEMBER]
        if operation == "in":
            p = c.isin(vals)
            return p | c.isNull() if has_null else p
        p = ~c.isin(vals)
        return p & c.isNotNull() if has_null else p
    if operation == ">":
        return c > F.lit(clean_date_literal(value))
    if operation == "<":
        return c < F.lit(clean_date_literal(value))
    if operation == "between":
        lo, hi = value
        return c.between(F.lit(clean_date_literal(lo)), F.lit(clean_date_literal(hi)))
    if operation == "not null":
        return c.isNotNull()
    if operation in ("left in", "left not in"):
        vals = [value] if isinstance(value, str) else list(value)
        p = F.left(c, F.lit(n if n is not None else len(vals[0]))).isin(vals)
        return p if operation == "left in" else ~p
    if operation in ("right in", "right not in"):
        vals = [value] if isinstance(value, str) else list(value)
        p = F.right(c, F.lit(n if n is not None else len(vals[0]))).isin(vals)
        return p if operation == "right in" else ~p
    if operation == "=":
        return c == F.lit(value)
    if operation == "!=":
        return c != F.lit(value)
    raise ValueError(operation)


def parameter_filter(df: DataFrame, column: str, param) -> DataFrame:
    """FX-13: rows where the key equals a runtime parameter."""
    return df.filter(F.col(column) == F.lit(param))


def chip_filter(df: DataFrame, **chips) -> DataFrame:
    """FX-14/FX-15: optional ``column=[values]`` chips; None means no filter."""
    preds = [F.col(c).isin(list(v)) for c, v in chips.items() if v]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df
