"""Calculated-field functions as Spark Columns (2.12: M, S, D, DP, L, N).

Every function is a thin composition of built-in ``pyspark.sql.functions``
so it stays inside whole-stage codegen.  Domain errors give NULL (never an
exception under ANSI mode): division by zero, ``LN``/``LOG`` of a
non-positive number, ``SQRT`` of a negative number, ``ACOS``/``ASIN``
outside [-1, 1], unparsable dates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# ------------------------------------------------------------------------ math
def abs_(x):
    return F.abs(_c(x))  # M01


def acos(x):
    x = _c(x)
    return F.when(x.between(-1, 1), F.acos(x))  # M02


def asin(x):
    x = _c(x)
    return F.when(x.between(-1, 1), F.asin(x))  # M03


def atan(x):
    return F.atan(_c(x))  # M04


def atan2(y, x):
    return F.atan2(_c(y), _c(x))  # M05


def ceiling(x):
    return F.ceil(_c(x))  # M06


def cos(x):
    return F.cos(_c(x))  # M07


def cot(x):
    x = _c(x)
    return F.when(F.tan(x) != 0, F.cot(x))  # M08


def degrees(x):
    return F.degrees(_c(x))  # M09


def div(a, b):
    """M10 as the reference maps it: a safe divide (NULL when b is 0 or NULL)."""
    return F.try_divide(_c(a), _c(b))


def int_div(a, b):
    """M10 source meaning: integer division truncated toward zero, NULL for b = 0."""
    a = _c(a).cast("long")
    nb = F.nullif(_c(b).cast("long"), F.lit(0))
    return ((a - a % nb) / nb).cast("long")


def exp(x):
    return F.exp(_c(x))  # M11


def floor(x):
    return F.floor(_c(x))  # M12


def ln(x):
    x = _c(x)
    return F.when(x > 0, F.ln(x))  # M13


def log(x, base=None):
    """M14: base 10 by default, else log in ``base``."""
    x = _c(x)
    if base is None:
        return F.when(x > 0, F.log10(x))
    return F.when(x > 0, F.log(float(base), x))


def pi():
    return F.pi()  # M15


def power(x, y):
    return F.pow(_c(x), _c(y))  # M16 / L13


def radians(x):
    return F.radians(_c(x))  # M17


def round_(x, digits: int = 0):
    return F.round(_c(x), digits)  # M18


def sign(x):
    return F.signum(_c(x))  # M19


def sin(x):
    return F.sin(_c(x))  # M20


def sqrt(x):
    x = _c(x)
    return F.when(x >= 0, F.sqrt(x))  # M21


def square(x):
    x = _c(x)
    return x * x  # M22


def tan(x):
    return F.tan(_c(x))  # M23


def zn(x):
    return F.coalesce(_c(x), F.lit(0))  # M24


EARTH_RADIUS_KM = 6371.0  # fixed value: mean earth radius used by DISTANCE


def distance(lat1, lon1, lat2, lon2, unit: str = "km"):
    """M25 great-circle (haversine) distance in km (or ``mi``)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    d = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return d / F.lit(1.609344) if unit == "mi" else d


_SQ3 = math.sqrt(3.0)


def _hex_center(x, y):
    """Nearest centre of a pointy-top hexagon grid with side 1: the nearer of
    the nearest points of the two rectangular sub-lattices
    (sqrt3*i, 3*j) and (sqrt3*(i+1/2), 3*j + 3/2)."""
    x, y = _c(x), _c(y)
    ax = F.round(x / _SQ3) * _SQ3
    ay = F.round(y / 3.0) * 3.0
    bx = F.floor(x / _SQ3) * _SQ3 + _SQ3 / 2
    by = F.floor(y / 3.0) * 3.0 + 1.5
    da = F.pow(x - ax, 2) + F.pow(y - ay, 2)
    db = F.pow(x - bx, 2) + F.pow(y - by, 2)
    use_a = da <= db
    return use_a, ax, ay, bx, by


def hexbinx(x, y):
    use_a, ax, _, bx, _ = _hex_center(x, y)
    return F.when(use_a, ax).otherwise(bx)  # M26


def hexbiny(x, y):
    use_a, _, ay, _, by = _hex_center(x, y)
    return F.when(use_a, ay).otherwise(by)  # M27


# ---------------------------------------------------------------------- string
def ascii_(s):
    return F.ascii(_c(s))  # S01


def char(n):
    return F.char(_c(n))  # S02


def contains(s, sub, case_insensitive: bool = False):
    """S03; the report's ``contains`` is case-insensitive."""
    if case_insensitive:
        return F.contains(F.lower(_c(s)), F.lower(_c(sub)))
    return F.contains(_c(s), _c(sub))


def concat(*parts):
    return F.concat(*[_c(p) for p in parts])  # S04 (NULL in -> NULL out)


def endswith(s, suffix):
    return F.endswith(_c(s), _c(suffix))  # S05


def find(s, sub, start=None):
    """S06 1-based position of ``sub`` (0 if absent), searching from ``start``."""
    if start is None:
        return F.locate(sub, _c(s)) if isinstance(sub, str) else F.instr(_c(s), sub)
    return F.locate(sub, _c(s), int(start))


def findnth(s, sub: str, n: int):
    """S07 position of the n-th (non-overlapping) occurrence, 0 if fewer."""
    s = _c(s)
    occurrences = F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub)))
    pos = F.length(F.substring_index(s, sub, n)) + 1
    return F.when(s.isNull(), None).when(occurrences >= n, pos).otherwise(F.lit(0))


def left(s, n):
    return F.left(_c(s), _c(n))  # S08


def right(s, n):
    return F.right(_c(s), _c(n))  # S09


def len_(s):
    return F.length(_c(s))  # S10


def lower(s):
    return F.lower(_c(s))  # S11


def ltrim(s):
    return F.ltrim(_c(s))  # S12


def mid(s, start, length=None):
    """S13 substring from a 1-based start, optional length."""
    if length is None:
        return F.substr(_c(s), _c(start))
    return F.substr(_c(s), _c(start), _c(length))


def replace(s, old, new):
    return F.replace(_c(s), _c(old), _c(new))  # S14


def rtrim(s):
    return F.rtrim(_c(s))  # S15


def space(n):
    return F.repeat(F.lit(" "), _c(n))  # S16


def split(s, delim: str, token: int):
    """S17 n-th token (1-based); negative counts from the end."""
    return F.split_part(_c(s), F.lit(delim), F.lit(token))


def startswith(s, prefix):
    return F.startswith(_c(s), _c(prefix))  # S18


def str_(x):
    return _c(x).cast("string")  # S19


def trim(s):
    return F.trim(_c(s))  # S20


def upper(s):
    return F.upper(_c(s))  # S21


# ----------------------------------------------------------------- dates/times
def date(x):
    """D01 cast to date; unparsable text -> NULL."""
    x = _c(x)
    return F.to_date(x)


def try_date(s, fmt: str | None = None):
    return F.try_to_date(_c(s), fmt) if fmt else F.try_to_date(_c(s))


def isdate(s):
    return try_date(s).isNotNull()  # D07


def day(d):
    return F.dayofmonth(_c(d))  # D06


def month(d):
    return F.month(_c(d))  # D15


def year(d):
    return F.year(_c(d))  # D20


def quarter(d):
    return F.quarter(_c(d))  # D17


def week(d):
    return F.weekofyear(_c(d))  # D19 (ISO week, Q12)


def isoweek(d):
    return F.weekofyear(_c(d))  # D09


def isoyear(d):
    return F.extract(F.lit("YEAROFWEEK"), _c(d))  # D11


def isoquarter(d):
    """D08 ISO week-based quarter: weeks 1-13 -> 1, ..., 40-53 -> 4."""
    return F.least(F.floor((F.weekofyear(_c(d)) - 1) / 13) + 1, F.lit(4)).cast("int")


def isoweekday(d):
    return (F.weekday(_c(d)) + 1).cast("int")  # D10 (1 = Monday)


def weekday(d, week_start: int = 0):
    """Day of week 1..7 where 1 is ``week_start`` (0 = Sunday)."""
    return (F.pmod(F.dayofweek(_c(d)) - 1 - F.lit(week_start), F.lit(7)) + 1).cast("int")


def makedate(y, m, d):
    return F.make_date(_c(y), _c(m), _c(d))  # D12


def makedatetime(d, t):
    """D13 timestamp from a date and the time of day of ``t``."""
    d, t = F.to_date(_c(d)), _c(t)
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.hour(t), F.minute(t), F.second(t))


def maketime(h, m, s):
    """D14 time of day on the epoch day 1899-12-30."""
    return F.make_timestamp_ntz(F.lit(1899), F.lit(12), F.lit(30), _c(h), _c(m), _c(s))


def now(as_of=None):
    """D16; ``as_of`` (a timestamp literal) instead of the clock for reproducible runs."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def today(as_of=None):
    """D18; ``as_of`` (a date literal) instead of the clock for reproducible runs."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def diff_time(end, start):
    """D21 seconds between two timestamps."""
    return F.unix_timestamp(_c(end).cast("timestamp")) - F.unix_timestamp(_c(start).cast("timestamp"))


def _norm_part(part: str) -> str:
    return part.strip().strip("'\"").lower()  # DP44: either quote style


def _week_start_date(d, week_start: int):
    return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - F.lit(week_start), F.lit(7)))


def _iso_year_start(y):
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    return F.date_sub(jan4, F.weekday(jan4))


def dateadd(part: str, n, d):
    """D02 / DP01-DP14."""
    p = _norm_part(part)
    n = _c(n)
    d = _c(d)
    if p in ("day", "dayofyear", "weekday", "iso-weekday"):
        return F.date_add(F.to_date(d), n)
    if p in ("week", "iso-week"):
        return F.date_add(F.to_date(d), n * 7)
    if p == "month":
        return F.add_months(F.to_date(d), n)
    if p in ("quarter", "iso-quarter"):
        return F.add_months(F.to_date(d), n * 3)
    if p == "year":
        return F.add_months(F.to_date(d), n * 12)
    if p == "iso-year":
        dd = F.to_date(d)
        y = isoyear(dd)
        shift = F.date_diff(_iso_year_start(y + n), _iso_year_start(y))
        return F.date_add(dd, shift)
    if p in ("hour", "minute", "second"):
        return F.timestamp_add(p.upper(), n, d.cast("timestamp_ntz"))
    raise ValueError(f"unknown date part {part!r}")


def datediff(part: str, a, b, week_start: int = 0):
    """D03 / DP15-DP28: number of ``part`` boundaries crossed from a to b (Q11)."""
    p = _norm_part(part)
    a, b = _c(a), _c(b)
    da, db = F.to_date(a), F.to_date(b)
    if p in ("day", "dayofyear", "weekday", "iso-weekday"):
        return F.date_diff(db, da)
    if p == "week":
        return (F.date_diff(_week_start_date(db, week_start), _week_start_date(da, week_start)) / 7).cast("int")
    if p == "iso-week":
        return (F.date_diff(_week_start_date(db, 1), _week_start_date(da, 1)) / 7).cast("int")
    if p == "month":
        return (F.year(db) - F.year(da)) * 12 + (F.month(db) - F.month(da))
    if p == "quarter":
        return (F.year(db) - F.year(da)) * 4 + (F.quarter(db) - F.quarter(da))
    if p == "year":
        return F.year(db) - F.year(da)
    if p == "iso-year":
        return (isoyear(db) - isoyear(da)).cast("int")
    if p == "iso-quarter":
        return ((isoyear(db) - isoyear(da)) * 4 + (isoquarter(db) - isoquarter(da))).cast("int")
    if p in ("hour", "minute", "second"):
        unit = {"hour": 3600, "minute": 60, "second": 1}[p]
        ta = F.unix_timestamp(F.date_trunc(p, a.cast("timestamp")))
        tb = F.unix_timestamp(F.date_trunc(p, b.cast("timestamp")))
        return ((tb - ta) / unit).cast("long")
    raise ValueError(f"unknown date part {part!r}")


def datepart(part: str, d, week_start: int = 0):
    """D05 numeric date part."""
    p = _norm_part(part)
    d = _c(d)
    fns = {
        "year": F.year,
        "quarter": F.quarter,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofyear": F.dayofyear,
        "week": F.weekofyear,
        "hour": F.hour,
        "minute": F.minute,
        "second": lambda x: F.second(x),
        "iso-year": isoyear,
        "iso-quarter": isoquarter,
        "iso-week": isoweek,
        "iso-weekday": isoweekday,
    }
    if p == "weekday":
        return weekday(d, week_start)
    return fns[p](d)


def datename(part: str, d, week_start: int = 0):
    """D04 / DP29-DP42: the part as text; month and weekday by name."""
    p = _norm_part(part)
    d = _c(d)
    if p == "month":
        return F.date_format(d, "MMMM")
    if p == "weekday":
        return F.date_format(d, "EEEE")
    return datepart(p, d, week_start).cast("string")


def datetrunc(part: str, d, week_start: int = 0):
    p = _norm_part(part)
    dd = F.to_date(_c(d))
    if p == "week":
        return _week_start_date(dd, week_start)
    return F.trunc(dd, p)


# ------------------------------------------------------------------ logic/misc
def if_(cond, then, else_=None):
    """L01 IF cond THEN a ELSE b END (no ELSE -> NULL, Q4)."""
    w = F.when(_c(cond), _c(then))
    return w if else_ is None else w.otherwise(_c(else_))


def if_chain(branches, else_=None):
    """L02 IF … ELSEIF … ELSE … END: ``branches`` = [(cond, value), ...]."""
    w = None
    for cond, val in branches:
        w = F.when(_c(cond), _c(val)) if w is None else w.when(_c(cond), _c(val))
    return w if else_ is None else w.otherwise(_c(else_))


def case(term, pairs, else_=None):
    """L03 CASE term WHEN v THEN r ... ELSE e END."""
    t = _c(term)
    return if_chain([(t == (v if isinstance(v, Column) else F.lit(v)), r) for v, r in pairs], else_)


def iif(cond, then, else_, unknown=None):
    """L04 IIF(cond, a, b[, unknown]): ``unknown`` when cond is NULL."""
    c = _c(cond)
    return F.when(c.isNull(), _c(unknown) if unknown is not None else F.lit(None)).when(c, _c(then)).otherwise(_c(else_))


def ifnull(x, y):
    return F.coalesce(_c(x), _c(y))  # L05


def isnull(x):
    return F.isnull(_c(x))  # L06


def and_(*xs):
    return reduce(lambda a, b: a & b, [_c(x) for x in xs])  # L07


def or_(*xs):
    return reduce(lambda a, b: a | b, [_c(x) for x in xs])  # L08


def not_(x):
    return ~_c(x)  # L09


def in_(x, values):
    return _c(x).isin(list(values))  # L10


def safe_divide(a, b):
    """L12 ``/``: NULL instead of an error for a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def date_literal(text: str):
    """L14 ``#2020-01-31#`` literal."""
    return F.to_date(F.lit(text.strip("#")))


# ---------------------------------------------------------------- N01 … N08
def null_to_blank(x):
    return F.coalesce(_c(x), F.lit(" "))  # N01


def regex_capture(s, pattern: str, group: int = 1):
    return F.regexp_extract(_c(s), pattern, group)  # N06


def md5_key(*cols):
    """N07 ``md5(concat(coalesce(cast(x as text), ''), ...))`` (Q16: unseparated)."""
    return F.md5(F.concat(*[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]))


def clean_table_name(s):
    """N08 ``#`` -> ``.``, ``$`` removed."""
    return F.translate(_c(s), "#$", ".")


def normalize_file_name(s):
    """IO-08: drop non-alphanumerics, blanks -> ``_``, lower case."""
    return F.lower(F.replace(F.regexp_replace(_c(s), r"[^a-zA-Z0-9\s]", ""), F.lit(" "), F.lit("_")))
