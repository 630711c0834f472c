"""Whole-table calculations equal the one-task windows, whatever the ranges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import tablecalc as tc
from lodestar.operators import tablewide as tw

CALCS = {
    "rk": tw.rank(), "dr": tw.rank_dense(), "mr": tw.rank_modified(), "ur": tw.rank_unique(),
    "rs": tw.running_sum("x"), "ra": tw.running_avg("x"), "rc": tw.running_count("x"), "hi": tw.running_max("x"), "lo": tw.running_min("x"),
    "f": tw.first(), "l": tw.last(), "i": tw.index(), "n": tw.size(), "t": tw.total("x"),
}


def _rows(shape):
    """(k, v, x): unique k, tied v (nulls too), x with nulls."""
    if shape == "hot":  # one key has most rows and spans many ranges
        return [(k, 5 if k % 10 else k, k % 7 or None) for k in range(300)]
    if shape == "ties":
        return [(k, (k * 7) % 9 if k % 11 else None, k) for k in range(200)]
    if shape == "few":
        return [(1, 2, None), (2, 2, 4)]
    if shape == "equal":
        return [(k, 1, k) for k in range(50)]
    return []


def _expected(df, descending):
    v = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    w, p, r = Window.partitionBy().orderBy(v, "k"), Window.partitionBy(), Window.partitionBy().orderBy(v)
    return df.select(
        "k", tc.rank(r).alias("rk"), tc.rank_dense(r).alias("dr"), tc.rank_modified(r).alias("mr"), tc.rank_unique(w).alias("ur"),
        tc.running_sum("x", w).alias("rs"), tc.running_avg("x", w).alias("ra"), tc.running_count("x", w).alias("rc"),
        tc.running_max("x", w).alias("hi"), tc.running_min("x", w).alias("lo"),
        tc.first(w).alias("f"), tc.last(w, p).alias("l"), tc.index(w).alias("i"), tc.size(p).alias("n"), tc.total("x", p).alias("t"),
    )


@pytest.mark.parametrize("shape", ["hot", "ties", "few", "equal", "none"])
@pytest.mark.parametrize("descending", [False, True])
def test_equal_to_one_window(spark, shape, descending):
    df = spark.createDataFrame(_rows(shape), "k int, v int, x long").repartition(4).checkpoint()
    got = tw.with_columns(df, CALCS, ["v"], ["k"], descending, ranges=13)
    assert got.columns == [*df.columns, *CALCS]
    exp = _expected(df, descending)
    assert sorted(map(tuple, got.select(exp.columns).collect())) == sorted(map(tuple, exp.collect()))


@pytest.mark.parametrize("shape", ["hot", "few", "none"])
@pytest.mark.parametrize("start,end", [(-2, 0), (0, 2), (-40, 30)])
def test_frames_reach_over_ranges(spark, shape, start, end):
    df = spark.createDataFrame(_rows(shape), "k int, v int, x long").repartition(4).checkpoint()
    frames = {"s": lambda w: tc.window_sum("x", w, start, end), "m": lambda w: tc.window_median("x", w, start, end), "at": lambda w: tc.lookup("k", start or end, w)}
    got = tw.with_frames(df, frames, start, end, ["v"], ["k"], ranges=11)
    w = Window.partitionBy().orderBy(F.col("v").asc_nulls_last(), "k")
    exp = df.select("k", "v", "x", *[fn(w).alias(name) for name, fn in frames.items()])
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, exp.collect()), key=key)


def test_names_that_clash_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "_range int, v int")
    with pytest.raises(ValueError):
        tw.with_columns(df, {"i": tw.index()}, ["v"], [])
