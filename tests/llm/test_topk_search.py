import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk_search as tk


def _brute(rows, is_query, k=10, scale=1024):
    ok = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in ok if is_query(i)}.items():
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def _got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert _got(tk.op6_topk_search(spark, sf_small)) == _brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("size", [1.0, 3e6, 2e10])
def test_ties_repeats_and_odd_vectors_over_many_tiles(spark, size):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) * (size if i % 50 == 7 else 1) for _ in range(3)]) for i in range(400)]
    rows += [(500 + i, [1.0, 0.0, 2.0]) for i in range(60)] + [(3, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (900, None), (901, []), (902, [1.0, None, 1.0]), (903, [float("nan")] * 3), (904, [float("inf"), 0.0, 0.0]), (910, [1.0, 2.0]), (915, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, id int").repartition(4)
    got = tk.search(df, F.coalesce(F.col("vec_id") % 5 == 0, F.lit(False)), query_block=20, shard=13)
    assert _got(got) == _brute(rows, lambda i: i % 5 == 0)


def test_no_float_is_rounded(spark):
    rows = [(0, [3e8, 1.0]), (1, [3e8, 0.5]), (2, [3e8, 0.499])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        tk.search(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)), F.col("vec_id") == 0).collect()
    small = df.withColumn("embedding", F.transform("embedding", lambda x: x / 200))
    assert _got(tk.search(small, F.col("vec_id") == 0)) == _brute([(i, [x / 200 for x in v]) for i, v in rows], lambda i: i == 0)


def test_finite_components_that_leave_the_doubles_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e306, 1.0]), (2, [-1.7e308, 0.0]), (3, [3.0, 1.0]), (5, [1e306, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert _got(tk.search(df, F.col("vec_id") % 5 == 0)) == [(0, 1, 3, 5 * 1024 * 1024)]


def test_fewer_than_k_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert _got(tk.search(df, F.col("vec_id") == 0)) == [(0, 1, 1, 1024 * 2048)]
    assert tk.search(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert tk.search(df, F.col("vec_id") == 5).collect() == []
