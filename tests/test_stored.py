"""Stored layouts: no exchange of tables that lie by their relationship's keys, and another way for hot keys."""

import contextlib
import io
import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.operators.joins import Relationship, star_join
from lodestar.session import checkpoint_dir
from lodestar.sources import stored

EDGES = [Relationship("f", "o", [("fk", "ok")]), Relationship("o", "c", [("ck", "cid")], "left")]


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue()


def _folder(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def _frames(spark, fact_key="id % 50", n=2_000):
    f = spark.range(n).select(F.expr(fact_key).cast("long").alias("fk"), (F.col("id") % 7).alias("x"))
    o = spark.range(60).select(F.col("id").alias("ok"), (F.col("id") % 9).alias("ck"))
    return {"f": f, "o": o, "c": spark.range(8).select(F.col("id").alias("cid"), F.concat(F.lit("c"), "id").alias("name"))}


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", ["j02_left_join_stored_layout", "j05_star_join_stored_layout", "j05_order_facts_stored_layout"])
def test_no_exchange_on_the_largest_tables(spark, sf_small, name):
    import __spark_entry__ as entry

    text = _plan(entry.queries()[name](spark, sf_small))
    assert "hashpartitioning(l_orderkey" not in text and "hashpartitioning(o_orderkey" not in text
    assert "SortMergeJoin [o_orderkey" in text or "SortMergeJoin [l_orderkey" in text
    assert text.count("Bucketed: true") == 2


def test_equal_to_the_join_of_plain_tables_and_attached_again(spark):
    frames, path = _frames(spark, "CASE WHEN id % 11 > 0 THEN id % 70 END"), _folder(spark)
    layout = stored.store(frames, EDGES, path, buckets=4, least_rows=0)
    assert layout.keys == {"f": ("fk",), "o": ("ok",)} and layout.together(EDGES[0]) and not layout.together(EDGES[1])
    expected = _rows(star_join(frames, EDGES))
    assert _rows(layout.star(EDGES)) == expected
    for t in layout.keys:
        spark.sql(f"DROP TABLE `{layout.names[t]}`")
    again = stored.attach(spark, path)
    assert _rows(again.star(EDGES)) == expected
    assert "hashpartitioning(fk" not in _plan(again.star(EDGES))


def test_tables_with_a_hot_key_are_stored_plainly(spark):
    frames = _frames(spark, "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 50 END")
    assert stored.hot(frames["f"], ("fk",), 16, hot_rows=100, hot_times=4.0)
    layout = stored.store(frames, EDGES, _folder(spark), buckets=16, least_rows=0, hot_rows=100)
    assert layout.keys == {}
    assert _rows(layout.star(EDGES)) == _rows(star_join(frames, EDGES))


def test_empty_tables_types_and_keys(spark):
    frames = _frames(spark, n=0)
    assert _rows(stored.store(frames, EDGES, _folder(spark), buckets=3, least_rows=0).star(EDGES)) == []
    unlike = frames | {"o": frames["o"].withColumn("ok", F.col("ok").cast("int"))}
    with pytest.raises(ValueError, match="f.fk is bigint, o.ok is int"):
        stored.store(unlike, EDGES, _folder(spark))
    assert stored.bucket_keys({"f": 10, "o": 5, "c": 9}, EDGES) == {"f": ("fk",), "o": ("ok",)}
    assert stored.bucket_keys({"f": 10, "o": 5, "c": 99}, EDGES) == {"o": ("ck",), "c": ("cid",)}
    assert stored.bucket_keys({"f": 10, "o": 5, "c": 99}, EDGES, least_rows=6) == {}
    assert stored.store(_frames(spark), EDGES, _folder(spark)).keys == {}
    assert stored.bucket_keys({"f": 1, "o": 1}, [Relationship("f", "o", [], compared=(("fk", "<", "ok"),))]) == {}
