import datetime as dt

from pyspark.sql import functions as F

from lodestar.operators.filters import FilterSpec, apply_filter, apply_filters, clean_date_literal, live_predicate


def _df(spark):
    rows = [(1, "a", 10.0, dt.date(2020, 1, 31)), (2, "b", 20.0, dt.date(2020, 2, 15)), (3, None, 30.0, None), (4, "ab", 40.0, dt.date(2021, 1, 1)), (5, "b", 50.0, dt.date(2021, 12, 31))]
    return spark.createDataFrame(rows, "k int, s string, x double, d date")


def keys(df):
    return sorted(r.k for r in df.select("k").collect())


def test_member_null_handling(spark):
    df = _df(spark)
    assert keys(apply_filter(df, FilterSpec("s", members=["a"]))) == [1]
    assert keys(apply_filter(df, FilterSpec("s", members=["a", "%null%"]))) == [1, 3]  # FT02
    assert keys(apply_filter(df, FilterSpec("s", mode="exclusive", members=["a"]))) == [2, 4, 5]  # Q21: NULL dropped
    assert keys(apply_filter(df, FilterSpec("s", mode="exclusive", members=["a"], keep_null=True))) == [2, 3, 4, 5]
    assert keys(apply_filter(df, FilterSpec("s", mode="exclusive", members=["a", "%null%"]))) == [2, 4, 5]  # FT01
    assert keys(apply_filter(df, FilterSpec("s", members=[]))) == [1, 2, 3, 4, 5]  # Q27


def test_date_part_members(spark):
    df = _df(spark)
    assert keys(apply_filter(df, FilterSpec("d", part="yr", members=["2021"]))) == [4, 5]
    assert keys(apply_filter(df, FilterSpec("d", part="my", members=["202001", "202112"]))) == [1, 5]  # FX-02
    assert keys(apply_filter(df, FilterSpec("d", part="md", members=["20200215"]))) == [2]  # FX-03
    assert keys(apply_filter(df, FilterSpec("d", part="wd", members=["5"]))) == [1, 4, 5]  # Friday = 5 (0 = Sunday)


def test_wildcards_never_multiply(spark):
    df = _df(spark).unionByName(_df(spark))  # duplicated values
    out = apply_filter(df, FilterSpec("s", kind="wildcard", pattern_type="contains", pattern="a"))
    assert out.count() == 4  # Q1: semi-join meaning
    assert keys(apply_filter(_df(spark), FilterSpec("s", kind="wildcard", mode="exclusive", pattern_type="starts-with", pattern="a"))) == [2, 5]
    assert keys(apply_filter(_df(spark), FilterSpec("s", kind="wildcard", pattern_type="exact-match", pattern="a%"))) == []  # literal


def test_top_n_ties_by_member(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 0.5)], "m string, v double")
    out = apply_filter(df, FilterSpec("m", kind="top", count=1, expression=F.sum("v")))
    assert [r.m for r in out.collect()] == ["x"]  # Q3
    bottom = apply_filter(df, FilterSpec("m", kind="top", end="bottom", count=1, expression=F.sum("v")))
    assert [r.m for r in bottom.collect()] == ["z"]


def test_condition_uses_unfiltered_base(spark):
    df = _df(spark)
    spec = FilterSpec("s", kind="condition", expression=F.sum("x"), condition=F.col("_measure") > 60)
    assert keys(apply_filter(df, spec)) == [2, 5]  # b: 20 + 50


def test_ranges_strict_by_default(spark):
    df = _df(spark)
    assert keys(apply_filter(df, FilterSpec("x", kind="quantitative", min=20.0))) == [3, 4, 5]  # Q10
    assert keys(apply_filter(df, FilterSpec("x", kind="quantitative", min=20.0, inclusive_range=True))) == [2, 3, 4, 5]
    assert keys(apply_filter(df, FilterSpec("x", kind="quantitative", min=20.0, max=40.0))) == [2, 3, 4]
    assert keys(apply_filter(df, FilterSpec("d", kind="quantitative", min="#2020-02-01#", max="#2021-01-01#"))) == [2, 4]


def test_relative_date_and_intersection(spark):
    df = _df(spark)
    spec = FilterSpec("d", kind="relative_date", period="month", first_period=-1, last_period=0, anchor="2020-02-20", include_future=False)
    assert keys(apply_filter(df, spec)) == [1, 2]
    assert keys(apply_filter(df, FilterSpec("s", kind="intersection"))) == []
    assert keys(apply_filter(df, FilterSpec("s", kind="intersection", include_all=True))) == [1, 2, 3, 4, 5]


def test_and_of_filters_parenthesised(spark):
    df = _df(spark)
    specs = [FilterSpec("s", members=["a", "%null%"]), FilterSpec("x", kind="quantitative", max=25.0)]
    assert keys(apply_filters(df, specs)) == [1]  # (s IN a OR s IS NULL) AND x < 25


def test_live_predicates(spark):
    df = _df(spark)
    assert keys(df.filter(live_predicate("s", "left in", ["a"], 1))) == [1, 4]
    assert keys(df.filter(live_predicate("s", "right not in", ["b"], 1))) == [1]
    assert keys(df.filter(live_predicate("s", "not in", ["a", "%null%"]))) == [2, 4, 5]
    assert clean_date_literal("#2020-01-31#") == dt.date(2020, 1, 31)
