"""Table calculations that address the whole table (W01…W15, W17…W29), as a two-pass scan.

A window without partition columns is one task.  Here the rows are dealt to
ranges of their order, each range is calculated by itself, and one state a range
(rows, distinct keys, first and last key, sums) is scanned over the ranges: what
comes before a range is then added to its rows.  Only the states, at most
``ranges`` rows of fixed width, are ever in one task or broadcast.

The ranged rows are checkpointed: range borders are sampled, so rows and states
must come from the same dealing, also after a lost executor.

The order is ``by`` (``descending`` applies to it), then ``then``; nulls last.  Ranks
compare ``by`` only; ``then`` should make the order unique, which also lets a key
with a third of the rows be split over ranges.  Repeated rows come in any order
among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestar.operators import tablecalc as tc
from lodestar.session import checkpoint_dir

_OWN = ("_range", "_idx", "_rank", "_dense", "_upto", "_at", "_sent", "_to")


@dataclass(frozen=True)
class Calc:
    """One table calculation: its kind, and the column it reads where it reads one."""

    kind: str
    x: str | None = None


def rank() -> Calc:
    return Calc("rank")  # W01


def rank_dense() -> Calc:
    return Calc("rank_dense")  # W02


def rank_modified() -> Calc:
    return Calc("rank_modified")  # W03


def rank_unique() -> Calc:
    return Calc("index")  # W04


def running_sum(x: str) -> Calc:
    return Calc("sum", x)  # W05


def running_avg(x: str) -> Calc:
    return Calc("avg", x)  # W06


def running_count(x: str) -> Calc:
    return Calc("count", x)  # W07


def running_max(x: str) -> Calc:
    return Calc("max", x)  # W08


def running_min(x: str) -> Calc:
    return Calc("min", x)  # W09


def first() -> Calc:
    return Calc("first")  # W11


def last() -> Calc:
    return Calc("last")  # W12


def index() -> Calc:
    return Calc("index")  # W13


def size() -> Calc:
    return Calc("size")  # W14


def total(x: str) -> Calc:
    return Calc("total", x)  # W15


_RUNNING = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
#: The running values that a kind is made of.
_PARTS = {"avg": ("sum", "count"), "total": ("sum",), **{k: (k,) for k in _RUNNING}}


def _ranged(df: DataFrame, by: list[str], then: list[str], descending: bool, ranges: int | None) -> tuple[DataFrame, WindowSpec]:
    """The rows with the number of their range, and the order within a range."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    clash = [c for c in df.columns if c in _OWN or c.startswith("_run_")]
    if clash:
        raise ValueError(f"columns {clash} have names that the scan uses")
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by]
    order += [F.col(c).asc_nulls_last() for c in then]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    return dealt, Window.partitionBy("_range").orderBy(*order)


def _before() -> WindowSpec:
    """All earlier ranges (over the states: at most ``ranges`` rows)."""
    return Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _rank_states(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row a range: rows before it, all rows, distinct keys before it, and rank and rows (over the
    whole table) of its first and its last key, which may go on in other ranges."""
    key = F.struct(*by)
    per = rows.groupBy("_range").agg(
        F.max("_idx").alias("_n"),
        F.max("_dense").alias("_d"),
        F.max("_rank").alias("_last_at"),
        F.sum(F.when(F.col("_rank") == 1, 1)).alias("_n_first"),
        F.min_by(key, "_idx").alias("_first_key"),
        F.max_by(key, "_idx").alias("_last_key"),
    )
    joined = F.lag("_last_key").over(Window.partitionBy().orderBy("_range")).eqNullSafe(F.col("_first_key"))  # a key goes on
    per = per.withColumn("_joined", F.when((F.row_number().over(Window.partitionBy().orderBy("_range")) > 1) & joined, 1).otherwise(0))
    per = per.withColumns({"_off": F.coalesce(F.sum("_n").over(_before()), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    upto = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_d_off", F.coalesce(F.sum("_d").over(_before()), F.lit(0)) - F.sum("_joined").over(upto))
    ends = [
        F.struct(F.lit(True).alias("is_first"), F.col("_first_key").alias("key"), F.col("_off").alias("at"), F.col("_n_first").alias("n")),
        F.struct(F.lit(False).alias("is_first"), F.col("_last_key").alias("key"), (F.col("_off") + F.col("_last_at") - 1).alias("at"), (F.col("_n") - F.col("_last_at") + 1).alias("n")),
    ]
    both = F.when(F.col("_last_at") == 1, F.array(ends[0])).otherwise(F.array(*ends))  # one key only: one end
    kept = ["_range", "_n", "_off", "_all", "_d_off", "_last_at"]
    borders = per.select(*kept, F.explode(both).alias("_e"))
    same = Window.partitionBy("_e.key")
    borders = borders.withColumns({"_k_rank": F.min("_e.at").over(same) + 1, "_k_rows": F.sum("_e.n").over(same)})
    end = lambda c, is_first: F.max(F.when(F.col("_e.is_first") == is_first, F.col(c)))
    return borders.groupBy(*kept).agg(
        end("_k_rank", True).alias("_first_rank"), end("_k_rows", True).alias("_first_rows"), end("_k_rows", False).alias("_last_rows")
    )


def _value(calc: Calc) -> Column:
    """The calculation from a row's place in its range and the state before the range."""
    at = F.col("_off") + F.col("_idx")
    if calc.kind == "index":
        return at
    if calc.kind == "first":
        return F.lit(1) - at
    if calc.kind == "last":
        return F.col("_all") - at
    if calc.kind == "size":
        return F.col("_all")
    if calc.kind == "rank":
        return F.when(F.col("_rank") == 1, F.col("_first_rank")).otherwise(F.col("_off") + F.col("_rank"))
    if calc.kind == "rank_dense":
        return F.col("_d_off") + F.col("_dense")
    if calc.kind == "rank_modified":
        of_last = F.col("_off") + F.col("_rank") - 1 + F.col("_last_rows")
        return (
            F.when(F.col("_rank") == 1, F.col("_first_rank") + F.col("_first_rows") - 1)
            .when(F.col("_rank") == F.col("_last_at"), of_last)
            .otherwise(F.col("_off") + F.col("_upto"))
        )
    here = {k: F.col(f"_run_{k}_{calc.x}") for k in _PARTS[calc.kind]}
    past = {k: F.col(f"_past_{k}_{calc.x}") for k in _PARTS[calc.kind]}
    if calc.kind == "total":
        return F.col(f"_total_{calc.x}")
    if calc.kind == "min":
        return F.least(here["min"], past["min"])
    if calc.kind == "max":
        return F.greatest(here["max"], past["max"])
    if calc.kind == "count":
        return here["count"] + F.coalesce(past["count"], F.lit(0))
    both = F.coalesce(here["sum"] + past["sum"], here["sum"], past["sum"])
    return both if calc.kind == "sum" else F.try_divide(both, here["count"] + F.coalesce(past["count"], F.lit(0)))


def with_columns(df: DataFrame, calcs: dict[str, Calc], by: list[str], then: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``calcs`` (name -> calculation), addressed over the whole table.

    Equal to the windows of ``tablecalc`` without partition columns.  Null values take no
    part in sums, counts, minima and maxima; an empty table gives an empty result."""
    rows, w = _ranged(df, by, then, descending, ranges)
    keys = Window.partitionBy("_range").orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = sorted({(k, c.x) for c in calcs.values() if c.x for k in _PARTS[c.kind]})
    rows = rows.withColumns(
        {
            "_idx": F.row_number().over(w).cast("long"),
            "_rank": F.rank().over(keys).cast("long"),
            "_dense": F.dense_rank().over(keys).cast("long"),
            "_upto": F.count(F.lit(1)).over(keys.rangeBetween(Window.unboundedPreceding, 0)),
            **{f"_run_{k}_{x}": _RUNNING[k](F.col(x)).over(running) for k, x in parts},
        }
    ).checkpoint()
    states = _rank_states(rows, by)
    if parts:
        ends = rows.groupBy("_range").agg(*[F.max_by(f"_run_{k}_{x}", "_idx").alias(f"_s_{k}_{x}") for k, x in parts])
        over = lambda k: F.sum if k in ("sum", "count") else _RUNNING[k]
        past = [over(k)(f"_s_{k}_{x}").over(_before()).alias(f"_past_{k}_{x}") for k, x in parts]
        whole = [F.sum(f"_s_sum_{x}").over(Window.partitionBy()).alias(f"_total_{x}") for k, x in parts if k == "sum"]
        states = states.join(ends.select("_range", *past, *whole), "_range")
    out = rows.join(F.broadcast(states), "_range")  # at most ``ranges`` rows
    return out.select(*df.columns, *[_value(c).alias(name) for name, c in calcs.items()])


def _lent(df: DataFrame, start: int, end: int, by: list[str], then: list[str], descending: bool, ranges: int | None) -> DataFrame:
    """The rows with ``_at``, their place in the table, and ``_to``: the range they are sent to, and whether it is their own.

    Each range gets the rows of its neighbours that frames from ``start`` to ``end``
    reach into, however many ranges these are."""
    if start > 0 or end < 0:
        raise ValueError("the frame must hold the current row: start <= 0 <= end")
    rows, w = _ranged(df, by, then, descending, ranges)
    rows = rows.withColumn("_idx", F.row_number().over(w).cast("long")).checkpoint()
    sizes = rows.groupBy("_range").agg(F.max("_idx").alias("_n"))
    spans = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(_before()), F.lit(0)))
    listed = spans.agg(F.collect_list(F.struct("_range", "_off", "_n")).alias("_spans"))  # at most ``ranges`` entries
    # the ranges whose frames reach into a range's rows (at positions _off + 1 to _off + _n)
    reach = lambda s, lo, hi: (lo <= s["_off"] + s["_n"] + end) & (hi > s["_off"] + start)
    near = F.filter("_spans", lambda s: (s["_range"] != F.col("_range")) & reach(s, F.col("_off") + 1, F.col("_off") + F.col("_n")))
    states = spans.select("*", listed.scalar().alias("_spans")).select("_range", "_n", "_off", near.alias("_near"))
    placed = rows.join(F.broadcast(states), "_range").withColumn("_at", F.col("_off") + F.col("_idx"))
    at = F.col("_at")
    edge = (F.col("_idx") > F.col("_n") + start) | (F.col("_idx") <= F.lit(end))
    own = F.array(F.struct(F.col("_range").alias("range"), F.lit(True).alias("own")))
    lent = F.transform(F.filter("_near", lambda s: reach(s, at, at)), lambda s: F.struct(s["_range"].alias("range"), F.lit(False).alias("own")))
    sent = placed.withColumn("_sent", F.when(edge, F.concat(own, lent)).otherwise(own))
    return sent.select(*df.columns, "_at", F.explode("_sent").alias("_to"))


def with_frames(df: DataFrame, frames: dict, start: int, end: int, by: list[str], then: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``frames`` (name -> function of a window), over the whole table.

    A function builds a Column over the window it is given, with offsets from
    ``start`` (rows before, at most 0) to ``end`` (rows after, at least 0), such as
    ``lambda w: tablecalc.window_avg("x", w, -2, 0)`` or a lookup (W10, W17…W29)."""
    sent = _lent(df, start, end, by, then, descending, ranges)
    over = Window.partitionBy("_to.range").orderBy("_at")
    return sent.select(*df.columns, "_to", *[fn(over).alias(name) for name, fn in frames.items()]).filter("_to.own").drop("_to")


def with_percentile(df: DataFrame, out: str, x: str, p: float, start: int, end: int, by: list[str], then: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """W22 / W23 over wide frames of the whole table: ``df`` with ``out``, as ``tablecalc.window_percentile_wide``."""
    sent = _lent(df, start, end, by, then, descending, ranges).withColumn("_range", F.col("_to.range"))
    framed = tc.window_percentile_wide(sent, ["_range"], ["_at"], x, p, start, end, out)
    return framed.filter("_to.own").select(*df.columns, out)
