"""Distinct counts from mergeable states; percentiles over frames that move."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import grouping as G
from lodestar.operators import tablecalc as tc
from lodestar.operators import tablewide as tw

ROWS = [("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("a", "y", 40000), (None, "y", -5), ("b", "x", None), ("b", None, 2**40)]
GRAINS = [["g", "h"], ["g"], []]


def _plain(rows):
    out = {}
    for grain, dims in enumerate(GRAINS):
        for g, h, x in rows:
            key = (grain, g if "g" in dims else None, h if "h" in dims else None)
            out.setdefault(key, set()).update([x] if x is not None else [])
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("form", G.DISTINCT_FORMS)
def test_every_grain_from_one_state(spark, form):
    df = spark.createDataFrame(ROWS, "g string, h string, x long")
    got = G.distinct_counts(G.distinct_state(df, ["g", "h"], "x", form), GRAINS, form).collect()
    assert {(r._grain, r.g, r.h): r.n for r in got} == _plain(ROWS)


@pytest.mark.parametrize("form", G.DISTINCT_FORMS)
def test_loads_are_united(spark, form):
    states = [G.distinct_state(spark.createDataFrame(part, "g string, h string, x long"), ["g", "h"], "x", form) for part in (ROWS[:3], ROWS[2:], [])]
    got = G.distinct_counts(G.merge_distinct(states, ["g", "h"], form), GRAINS, form).collect()
    assert {(r._grain, r.g, r.h): r.n for r in got} == _plain(ROWS)


def test_lineitem_is_read_once(spark, sf_small):
    import __spark_entry__ as entry

    plan = entry.queries()["a06_distinct_at_four_grains"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_condition_and_unknown_form(spark):
    df = spark.createDataFrame(ROWS, "g string, h string, x long")
    got = G.distinct_counts(G.distinct_state(df, ["g", "h"], "x", "bitmap", F.col("x") > 0), [["g"]], "bitmap").collect()
    assert {r.g: r.n for r in got} == {"a": 2, None: 0, "b": 1}
    with pytest.raises(ValueError):
        G.distinct_state(df, ["g"], "x", "list")


def _frames(values, start, end, p):
    out = []
    for i in range(len(values)):
        held = [v for v in values[max(0, i + start) : max(0, i + end + 1)] if v is not None]
        out.append(float(np.quantile(held, p)) if held else None)
    return out


@pytest.mark.parametrize("start,end", [(-3, 0), (-2, 4), (1, 3), (-5, -2), (-1000, 1000)])
def test_moving_percentile(spark, start, end):
    groups = {"a": [(i * 37) % 23 if i % 5 else None for i in range(40)], "b": [7], None: [3, 3, 1]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = tc.window_percentile_wide(df, ["g"], ["i"], "v", 0.3, start, end, "q")
    assert got.columns == ["g", "i", "v", "q"]
    of = {(r.g, r.i): r.q for r in got.collect()}
    for g, vs in groups.items():
        for i, q in enumerate(_frames(vs, start, end, 0.3)):
            assert of[g, i] == (None if q is None else pytest.approx(q)), (g, i)


def test_moving_percentile_over_batches_and_ranges(spark):
    values = [(k * 7919) % 1009 for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int").repartition(5)
    exp = _frames(values, -300, 250, 0.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for got in (
            tc.window_percentile_wide(df, [], ["k"], "v", 0.5, -300, 250, "q").collect(),
            tw.with_percentile(df, "q", "v", 0.5, -300, 250, ["k"], [], ranges=17).collect(),
        ):
            assert [r.q for r in sorted(got)] == pytest.approx(exp)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_moving_percentile_with_nan_and_no_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (1, nan), (2, 3.0)], "k int, v double")
    got = [r.q for r in sorted(tc.window_percentile_wide(df, [], ["k"], "v", 0.5, -2, 0, "q").collect())]
    assert got[0] == 1.0 and math.isnan(got[1]) and got[2] == 3.0
    assert tc.window_percentile_wide(df.limit(0), [], ["k"], "v", 0.5, -2, 0, "q").collect() == []
