import datetime as dt

from pyspark.sql import functions as F

from lodestar.functions import calc as C


def one(spark, col, row=None):
    df = spark.createDataFrame([row or (1,)], "k int") if row is None else row
    return df.select(col.alias("v")).first().v


def test_datediff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 31), dt.date(2021, 1, 1))], "a date, b date")
    r = df.select(
        C.datediff("year", "a", "b").alias("y"),
        C.datediff("quarter", "a", "b").alias("q"),
        C.datediff("month", "a", "b").alias("m"),
        C.datediff("day", "a", "b").alias("d"),
    ).first()
    assert (r.y, r.q, r.m, r.d) == (1, 1, 1, 1)  # Q11


def test_week_boundaries_and_start_of_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7), dt.date(2024, 1, 8))], "a date, b date")  # Sun -> Mon
    r = df.select(C.datediff("week", "a", "b").alias("sun"), C.datediff("iso-week", "a", "b").alias("mon")).first()
    assert (r.sun, r.mon) == (0, 1)


def test_dateadd_and_names(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31),)], "d date")
    r = df.select(
        C.dateadd("month", 1, "d").alias("m"),
        C.dateadd("'year'", 1, "d").alias("y"),
        C.datename("month", "d").alias("mn"),
        C.datename("weekday", "d").alias("wd"),
        C.isoweekday("d").alias("iwd"),
        C.isoquarter("d").alias("iq"),
    ).first()
    assert r.m == dt.date(2020, 2, 29) and r.y == dt.date(2021, 1, 31)
    assert (r.mn, r.wd, r.iwd, r.iq) == ("January", "Friday", 5, 1)


def test_string_functions(spark):
    df = spark.createDataFrame([("a-b-c-b",)], "s string")
    r = df.select(
        C.findnth("s", "b", 2).alias("n2"),
        C.findnth("s", "b", 3).alias("n3"),
        C.split("s", "-", -1).alias("last"),
        C.find("s", "b", 4).alias("f"),
        C.mid("s", F.lit(3), F.lit(3)).alias("mid"),
    ).first()
    assert (r.n2, r.n3, r.last, r.f, r.mid) == (7, 0, "b", 7, "b-c")


def test_null_safe_math_and_logic(spark):
    df = spark.createDataFrame([(-1.0, 0, None)], "x double, z int, n string")
    r = df.select(
        C.ln("x").alias("ln"),
        C.sqrt("x").alias("sq"),
        C.acos(F.lit(2.0)).alias("ac"),
        C.div(F.lit(1.0), "z").alias("dv"),
        C.int_div(F.lit(-7), F.lit(2)).alias("idv"),
        C.iif(F.col("n") == "a", F.lit("y"), F.lit("n"), F.lit("u")).alias("iif"),
        C.if_(F.lit(False), F.lit("y")).alias("no_else"),
        C.zn(F.lit(None).cast("double")).alias("zn"),
    ).first()
    assert r.ln is None and r.sq is None and r.ac is None and r.dv is None
    assert r.idv == -3 and r.iif == "u" and r.no_else is None and r.zn == 0


def test_md5_key_matches_unseparated_concat(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    keys = [r.k for r in df.select(C.md5_key("x", "y").alias("k")).collect()]
    assert keys[0] == keys[1]  # Q16: collision kept for parity


def test_hexbin_centres_are_lattice_points(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.9, 1.4)], "x double, y double")
    pts = [(round(r.hx, 6), round(r.hy, 6)) for r in df.select(C.hexbinx("x", "y").alias("hx"), C.hexbiny("x", "y").alias("hy")).collect()]
    assert pts[0] == (0.0, 0.0) and pts[1] == (round(3**0.5 / 2, 6), 1.5)
