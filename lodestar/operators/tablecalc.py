"""Table calculations (W01…W29) as window Columns.

Table calculations run after the query's aggregation: ``groupBy().agg()``
first, then these windows over the (much smaller) aggregated frame.
Addressing = ``partition_by`` + ``order_by``; every order list should end in a
unique key so results are deterministic.  A table calc without partition
columns runs in one task (it addresses the whole table); use it only on
aggregated views, and ``tablewide`` for fact rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.session import ship_library

UNBOUNDED_PRECEDING = Window.unboundedPreceding
UNBOUNDED_FOLLOWING = Window.unboundedFollowing


def addressing(partition_by=(), order_by=()) -> WindowSpec:
    w = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()
    return w.orderBy(*order_by) if order_by else w


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ranks -----------------------------------------------------------------------
def rank(w: WindowSpec) -> Column:
    """W01 competition rank (1,2,2,4)."""
    return F.rank().over(w)


def rank_dense(w: WindowSpec) -> Column:
    """W02 dense rank (1,2,2,3)."""
    return F.dense_rank().over(w)


def rank_modified(w: WindowSpec) -> Column:
    """W03 modified competition rank (1,3,3,4): rows ordered at or before this one."""
    return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def rank_unique(w: WindowSpec) -> Column:
    """W04 unique rank; the window order must contain a tie-break key."""
    return F.row_number().over(w)


# running ---------------------------------------------------------------------
def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(x, w):
    return F.sum(_col(x)).over(_running(w))  # W05


def running_avg(x, w):
    return F.avg(_col(x)).over(_running(w))  # W06


def running_count(x, w):
    return F.count(_col(x)).over(_running(w))  # W07


def running_max(x, w):
    return F.max(_col(x)).over(_running(w))  # W08


def running_min(x, w):
    return F.min(_col(x)).over(_running(w))  # W09


# navigation ------------------------------------------------------------------
def lookup(x, offset: int, w: WindowSpec) -> Column:
    """W10 value at a relative offset (-1 = previous row)."""
    if offset < 0:
        return F.lag(_col(x), -offset).over(w)
    if offset > 0:
        return F.lead(_col(x), offset).over(w)
    return _col(x)


def first(w: WindowSpec) -> Column:
    """W11 offset from the current row to the first row (0, -1, -2, ...)."""
    return F.lit(1) - F.row_number().over(w)


def last(w: WindowSpec, partition: WindowSpec) -> Column:
    """W12 offset from the current row to the last row."""
    return F.count(F.lit(1)).over(partition) - F.row_number().over(w)


def index(w: WindowSpec) -> Column:
    """W13 1-based position in the partition."""
    return F.row_number().over(w)


def size(partition: WindowSpec) -> Column:
    """W14 rows in the partition."""
    return F.count(F.lit(1)).over(partition)


def total(x, partition: WindowSpec, fn=F.sum) -> Column:
    """W15 aggregate over the whole partition (additive aggregates)."""
    return fn(_col(x)).over(partition)


def previous_value_sum(x, w: WindowSpec, init=0) -> Column:
    """W16 ``PREVIOUS_VALUE(init) + x`` closed form: init + running sum."""
    return F.lit(init) + running_sum(x, w)


def previous_value(x, w: WindowSpec, init, step) -> Column:
    """W16 general recurrence v_i = step(v_{i-1}, x_i), v_0 = init, folded over
    the running frame.  Quadratic in the partition length: for small
    aggregated partitions only (``previous_value_fold`` takes any length)."""
    xs = F.collect_list(_col(x)).over(_running(w))
    return F.aggregate(xs, F.lit(init), step)


def previous_value_fold(df: DataFrame, partition_by: list[str], order_by: list[str], x: str, init, step: Callable, out: str, kind: str) -> DataFrame:
    """W16 for partitions of any length: ``df`` with ``out`` (of type ``kind``), v_i = step(v_{i-1}, x_i) from v_0 = init.

    The rows of a partition come sorted, in Arrow batches, and only the last value
    is carried from batch to batch: linear time, constant memory.  A recurrence with
    any step is sequential, so a partition is one task; ``order_by`` must be unique
    in it.  Null values of ``x`` reach the step as None."""
    dealt = df.repartition(*partition_by) if partition_by else df.repartition(1)
    ordered = dealt.sortWithinPartitions(*partition_by, *order_by)

    def run(batches):
        of, v = None, init
        for b in batches:
            at = [b.schema.get_field_index(c) for c in (*partition_by, x)]
            values = []
            for *key, value in zip(*(b.column(i).to_pylist() for i in at)):
                if key != of:
                    of, v = key, init
                v = step(v, value)
                values.append(v)
            made = pa.array(values, to_arrow_type(result))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, out])

    result = T.StructType.fromDDL(f"v {kind}")["v"].dataType
    ship_library(ordered.sparkSession)
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, result)]))


# moving windows (offsets relative to the current row) -------------------------
def _frame(w: WindowSpec, start, end) -> WindowSpec:
    return w.rowsBetween(start, end)


def window_sum(x, w, start, end):
    return F.sum(_col(x)).over(_frame(w, start, end))  # W18


def window_avg(x, w, start, end):
    return F.avg(_col(x)).over(_frame(w, start, end))  # W17


def window_min(x, w, start, end):
    return F.min(_col(x)).over(_frame(w, start, end))  # W19


def window_max(x, w, start, end):
    return F.max(_col(x)).over(_frame(w, start, end))  # W20


def window_count(x, w, start, end):
    return F.count(_col(x)).over(_frame(w, start, end))  # W21


def window_median(x, w, start, end):
    return F.percentile(_col(x), F.lit(0.5)).over(_frame(w, start, end))  # W22


def window_percentile(x, p: float, w, start, end):
    return F.percentile(_col(x), F.lit(p)).over(_frame(w, start, end))  # W23


class _SlidingOrder:
    """The ordered values of a frame that moves over a partition, row by row."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        self.rows = self.done = self.lo = self.hi = 0  # rows seen and answered; the frame holds positions lo to hi - 1
        self.kept, self.first = deque(), 0  # values from position ``first`` on
        self.ordered, self.nans = [], 0

    def add(self, value) -> None:
        self.kept.append(None if value is None else float(value))
        self.rows += 1

    def _enter(self, v) -> None:
        if v is not None and v == v:
            insort(self.ordered, v)
        elif v is not None:
            self.nans += 1

    def _leave(self, v) -> None:
        if v is not None and v == v:
            del self.ordered[bisect_left(self.ordered, v)]
        elif v is not None:
            self.nans -= 1

    def percentile(self, p: float):
        n = len(self.ordered) + self.nans
        if not n:
            return None
        value = lambda i: self.ordered[i] if i < len(self.ordered) else float("nan")
        at = (n - 1) * p
        below, above = value(floor(at)), value(ceil(at))
        return below if below == above else below + (above - below) * (at - floor(at))

    def answers(self, p: float, whole: bool):
        """The percentiles of the rows whose frame has come, in order (all of them once the partition is ``whole``)."""
        while self.done < self.rows and (whole or self.done + self.end < self.rows):
            while self.hi < self.rows and self.hi <= self.done + self.end:
                self._enter(self.kept[self.hi - self.first])
                self.hi += 1
            while self.lo < self.hi and self.lo < self.done + self.start:
                self._leave(self.kept[self.lo - self.first])
                self.lo += 1
            while self.first < self.lo:
                self.kept.popleft()
                self.first += 1
            yield self.percentile(p)
            self.done += 1


def window_percentile_wide(df: DataFrame, partition_by: list[str], order_by: list[str], x: str, p: float, start: int, end: int, out: str) -> DataFrame:
    """W22 / W23 for wide frames: ``df`` with ``out``, the interpolated percentile of ``x`` over the rows from ``start`` to ``end``.

    The frame is kept in order while it moves, a row entering and a row leaving, so
    the time is near linear, where ``window_percentile`` orders every frame anew.  A
    task holds the frame and the rows that wait for its end.  ``order_by`` must be
    unique in a partition.  Nulls are left out (a frame of nulls, or of no rows, has
    NULL); NaN comes after all numbers."""
    dealt = df.repartition(*partition_by) if partition_by else df.repartition(1)

    def run(batches):
        of, frame, waiting, made = None, None, deque(), []
        for b in batches:
            waiting.append(b)
            at = [b.schema.get_field_index(c) for c in (*partition_by, x)]
            for *key, value in zip(*(b.column(i).to_pylist() for i in at)):
                if frame is None or key != of:
                    made.extend(frame.answers(p, True) if frame else ())
                    of, frame = key, _SlidingOrder(start, end)
                frame.add(value)
                made.extend(frame.answers(p, False))
            while waiting and len(made) >= waiting[0].num_rows:
                ready = waiting.popleft()
                yield _with_column(ready, out, made[: ready.num_rows])
                del made[: ready.num_rows]
        made.extend(frame.answers(p, True) if frame else ())
        for ready in waiting:
            yield _with_column(ready, out, made[: ready.num_rows])
            del made[: ready.num_rows]

    ordered = dealt.sortWithinPartitions(*partition_by, *order_by)
    ship_library(ordered.sparkSession)
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def _with_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])


def window_stdev(x, w, start, end):
    return F.stddev_samp(_col(x)).over(_frame(w, start, end))  # W24


def window_stdevp(x, w, start, end):
    return F.stddev_pop(_col(x)).over(_frame(w, start, end))  # W25


def window_var(x, w, start, end):
    return F.var_samp(_col(x)).over(_frame(w, start, end))  # W26


def window_varp(x, w, start, end):
    return F.var_pop(_col(x)).over(_frame(w, start, end))


def window_corr(x, y, w, start, end):
    return F.corr(_col(x), _col(y)).over(_frame(w, start, end))  # W27


def window_covar(x, y, w, start, end):
    return F.covar_samp(_col(x), _col(y)).over(_frame(w, start, end))  # W28


def window_covarp(x, y, w, start, end):
    return F.covar_pop(_col(x), _col(y)).over(_frame(w, start, end))  # W29
