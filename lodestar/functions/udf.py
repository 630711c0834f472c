"""Pass-through families (U01 … U16): RAWSQL_*, RAWSQLAGG_*, SCRIPT_*.

RAWSQL_* hand a SQL expression to the engine: here ``F.expr`` (JVM-side, same
optimizer as everything else) with the declared result type.  SCRIPT_* run a
user function in Python; they are vectorised ``pandas_udf``s over Arrow
batches (never row-at-a-time).  A script that needs partition-level context
gets it as extra columns computed by Spark first (aggregates joined back), so
no partition is ever gathered into one Python worker.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import ship_library

_TYPES = {"BOOL": "boolean", "DATE": "date", "DATETIME": "timestamp", "INT": "bigint", "REAL": "double", "STR": "string"}


def rawsql(kind: str, sql: str) -> Column:
    """U01-U06 ``RAWSQL_<kind>(sql)``: a scalar SQL expression with a declared type."""
    return F.expr(sql).cast(_TYPES[kind])


def rawsqlagg(kind: str, sql: str) -> Column:
    """U07-U12 ``RAWSQLAGG_<kind>(sql)``: an aggregate SQL expression for ``agg``."""
    return F.expr(sql).cast(_TYPES[kind])


def script(kind: str, fn: Callable[..., pd.Series]):
    """U13-U16 ``SCRIPT_<kind>``: wrap ``fn(*pandas.Series) -> pandas.Series``
    as a vectorised pandas UDF returning the declared type."""
    return F.pandas_udf(fn, _TYPES[kind])


def script_over(df: DataFrame, partition_by: list[str], order_by: list[str], kind: str, fn: Callable[..., pd.Series], args: list[str], out: str) -> DataFrame:
    """U13-U16 over an addressing: ``df`` with ``out``, the script's answer for each whole partition.

    ``fn`` gets the columns ``args`` of one partition, in ``order_by``, whatever the
    size of Arrow batches, and gives a value a row.  A partition is one call by
    definition and must fit a task; scripts that judge row by row take ``script``.
    Spark sorts the rows by partition and order, and a task calls the script for one
    partition after the other, so a small partition costs little more than its call."""
    spark, schema = df.sparkSession, T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{out}` {_TYPES[kind]}").fields])
    ship_library(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    # a task has many partitions, in order and one behind the other; the first row of each has place 1
    w = Window.partitionBy(*partition_by).orderBy(*([F.col(c).asc_nulls_last() for c in order_by] or [F.lit(1)]))
    ordered = df.withColumn(_PLACE, F.row_number().over(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a partition that may go on
        for b in batches:
            starts = np.flatnonzero(b.column(_PLACE).to_numpy(zero_copy_only=False) == 1)
            if not len(starts):
                held += [b] if b.num_rows else []
                continue
            if starts[-1]:
                held.append(b.slice(0, starts[-1]))
            if held:
                yield from _answered(held, kind, fn, args, out, zone)
            held = [b.slice(starts[-1])]
        if held:
            yield from _answered(held, kind, fn, args, out, zone)

    return ordered.mapInArrow(run, schema)


_PLACE = "_script_place"
_ARROW = {"BOOL": pa.bool_(), "DATE": pa.date32(), "DATETIME": pa.timestamp("us", tz="UTC"), "INT": pa.int64(), "REAL": pa.float64(), "STR": pa.string()}
_ROWS = 10_000


def _series(column: pa.ChunkedArray, zone: str) -> pd.Series:
    """A partition's column as pandas has it: whole numbers stay whole where none is null, times are local."""
    x = column.to_pandas()
    return x.dt.tz_convert(zone).dt.tz_localize(None) if isinstance(x.dtype, pd.DatetimeTZDtype) else x


def _answered(held: list[pa.RecordBatch], kind: str, fn: Callable[..., pd.Series], args: list[str], out: str, zone: str) -> Iterator[pa.RecordBatch]:
    """Whole partitions, one behind the other, with the script's answer for each."""
    rows = pa.Table.from_batches(held).combine_chunks()
    ends = [*np.flatnonzero(rows.column(_PLACE).to_numpy() == 1).tolist(), rows.num_rows]
    # columns without nulls are turned into numbers once for all partitions
    plain = {a: rows.column(a).to_numpy().copy() for a in args if rows.column(a).null_count == 0 and (pa.types.is_integer(rows.column(a).type) or pa.types.is_floating(rows.column(a).type))}
    answers = []
    for i, j in zip(ends, ends[1:]):
        given = fn(*(pd.Series(plain[a][i:j]) if a in plain else _series(rows.column(a).slice(i, j - i), zone) for a in args))
        if not isinstance(given, pd.Series):
            given = pd.Series(given, index=range(j - i))
        elif not (isinstance(given.index, pd.RangeIndex) and given.index.equals(pd.RangeIndex(j - i))):
            given = given.reindex(range(j - i))
        if kind == "DATETIME":
            given = pd.to_datetime(given)
            given = given.dt.tz_localize(zone) if given.dt.tz is None else given
        answers.append(given)
    runs = [list(same) for _, same in itertools.groupby(answers, key=lambda a: a.dtype)]  # values of one type are turned at once
    turned = [_turned(pd.Series(np.concatenate([a.to_numpy() for a in same])) if isinstance(same[0].dtype, np.dtype) else pd.concat(same), kind) for same in runs]
    yield from rows.drop_columns([_PLACE]).append_column(out, pa.chunked_array(turned)).combine_chunks().to_batches(max_chunksize=_ROWS)


def _turned(answer: pd.Series, kind: str) -> pa.Array:
    return pa.Array.from_pandas(answer, mask=answer.isna().to_numpy(), type=_ARROW[kind], safe=False)
