"""FX-04 date-part keys used by member, top-N and condition filters.

Fixed values (the workbook's date-part codes):
    yr = year, mn = month, qr = quarter, wk = ISO week, dy = day of month,
    wd = day of week with 0 = Sunday, my = year and month, md = year, month, day.

``my`` and ``md`` are kept as single sortable integers (YYYYMM, YYYYMMDD), so a
member list of ``YYYYMM`` strings (FX-02) or ``YYYYMMDD`` strings (FX-03)
compares with one ``isin`` and a NULL date gives a NULL key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_CODES = ("yr", "mn", "qr", "wk", "dy", "wd", "my", "md")


def part_key(col: Column | str, part: str | None, week_start: int = 0) -> Column:
    """Column of the date part; ``part=None`` returns the column itself.

    ``week_start`` shifts the day-of-week base (0 = Sunday, Q12).
    """
    c = F.col(col) if isinstance(col, str) else col
    if part is None:
        return c
    if part == "yr":
        return F.year(c)
    if part == "mn":
        return F.month(c)
    if part == "qr":
        return F.quarter(c)
    if part == "wk":
        return F.weekofyear(c)
    if part == "dy":
        return F.dayofmonth(c)
    if part == "wd":
        return F.pmod(F.dayofweek(c) - 1 - F.lit(week_start), F.lit(7))
    if part == "my":
        return F.year(c) * 100 + F.month(c)
    if part == "md":
        return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
    raise ValueError(f"unknown date part {part!r}")


def member_value(part: str | None, member):
    """Convert one member string to the key's type (FX-02, FX-03)."""
    if part is None or member is None:
        return member
    return int(str(member).strip())
