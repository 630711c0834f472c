import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as hn


def _brute(rows, is_anchor, scale=256, k=5, m=3):
    ok = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if all(abs(x * scale) * math.sqrt(len(v)) < 2**31 for x in v):
            ok.append((i, label, [math.floor(x * scale) for x in v]))
    out, anchors = [], {}
    for i, label, v in ok:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for i, (label, a) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, other) for j, other, v in ok if j != i and len(v) == len(a))
        for p, pid, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:m]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(fits)]
    return sorted(out)


def _got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    got = hn.op12_hard_negatives(spark, sf_small)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.schema["rank"].dataType.simpleString() == "int"
    assert _got(got) == _brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("dim", [0, 1, 7, 8, 19])
@pytest.mark.parametrize("size", [1, 100, 1 << 30])
def test_lookups_are_the_inner_products(dim, size):
    rng = np.random.default_rng(dim)
    a, c = rng.integers(-size, size, (5, dim), endpoint=True), rng.integers(-size, size, (33, dim), endpoint=True)
    bits, planes = hn.bit_planes(c)
    assert planes.shape == (bits, -(-dim // 8), 33) and bits <= size.bit_length() + 1
    assert (hn.scores(hn.subset_sums(a, np.int64), planes, 5, np.int64) == c @ a.T).all()


def test_subset_sums():
    a = np.array([[3, -5, 7, 11, 13, 17, 19, 23, 100, -200]])
    first, second = hn.subset_sums(a, np.int64)
    for byte in range(256):
        assert first[byte, 0] == sum(a[0, i] for i in range(8) if byte >> i & 1)
        assert second[byte, 0] == sum(a[0, 8 + i] for i in range(2) if byte >> i & 1)


@pytest.mark.parametrize("size", [1.0, 4e3, 3e6])
def test_ties_repeats_hot_label_and_odd_vectors(spark, size):
    rng = random.Random(3)
    rows = [(i, 0 if i % 3 else rng.randrange(5), [float(rng.randint(0, 3)) * (size if i % 40 == 7 else 1) for _ in range(9)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [1.0, 0.0, 2.0] * 3) for i in range(40)] + [(10, 1, [1.0] * 9), (10, 0, [2.0] * 9), (11, 1, [3.0] * 9), (11, 1, [3.0] * 9)]
    rows += [(None, 1, [1.0] * 9), (2000, None, [1.0] * 9), (2001, 1, None), (2002, 1, [None] + [1.0] * 8), (2005, 1, [float("nan")] * 9), (2010, 1, [float("inf")] * 9), (2015, 1, [1e306] * 9), (2020, 1, [-1e9] * 9)]
    rows += [(2025, 1, []), (2026, 1, []), (2027, 2, []), (2030, 1, [1.0, 2.0]), (2031, 1, [1.0, 2.5]), (2032, 2, [1.0, 1.0]), (2050, 7, [1.0] * 9)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, rank int, id string").repartition(5)
    want = _brute(rows, lambda i: i % 5 == 0)
    assert want
    assert _got(hn.mine(df, F.col("vec_id") % 5 == 0, shard=16)) == want
    assert _got(hn.mine(df, F.col("vec_id") % 5 == 0)) == want


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [4.0]), (2, 2, [3.0]), (3, 2, [1.0]), (4, 2, [-9.0])], "vec_id long, label long, embedding array<float>")
    assert _got(hn.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 4 * 65536, 3 * 65536)]
    assert hn.mine(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert hn.mine(df, F.col("vec_id") == 9).collect() == []
    assert hn.mine(df.filter("label = 2"), F.col("vec_id") == 2).collect() == []


def test_bounds_of_negative_scores():
    for p in (-7, 0, 1, 199, 200, 10**18):
        low, high = hn.bounds(p)
        for s in (low - 1, low, high, high + 1):
            assert (low <= s <= high) == (50 * p <= 100 * s <= 95 * p)
