from pyspark.sql import functions as F

from lodestar.operators import joins as J


def test_star_join_projection_and_flip(spark):
    a = spark.createDataFrame([(1, 10)], "a_id int, b_id int")
    b = spark.createDataFrame([(10, "x")], "b_key int, b_name string")
    c = spark.createDataFrame([(5, 1)], "c_id int, c_a int")
    edges = [J.Relationship("a", "b", [("b_id", "b_key")], "left"), J.Relationship("c", "a", [("c_a", "a_id")], "left")]
    out = J.star_join({"a": a, "b": b, "c": c}, edges)
    assert out.columns == ["a_id", "b_id", "b_name", "c_id"]  # right keys dropped, c attached flipped
    assert out.count() == 1


def test_join_order_requeues():
    e1 = J.Relationship("a", "b", [("x", "y")])
    e2 = J.Relationship("c", "d", [("x", "y")])
    e3 = J.Relationship("b", "c", [("x", "y")])
    order = J.join_order([e1, e2, e3])
    assert [(e.left, e.right, f) for e, f in order] == [("a", "b", False), ("b", "c", False), ("c", "d", False)]


def test_connected_components_vs_brute_force(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (7, 5), (10, 11), (11, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.vertex: r.component for r in J.connected_components(df).collect()}
    # brute force union-find
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    expected = {v: find(v) for a, b in edges for v in (a, b)}
    assert got == expected


def test_cardinality_and_null_safe(spark):
    o = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "o int, c int")
    c = spark.createDataFrame([(1,), (2,)], "c int")
    assert J.cardinality(o, c, ["c"], ["c"]).first().cardinality == "MANY_TO_ONE"
    l = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    r = spark.createDataFrame([(None, "n"), ("a", "x")], "rk string, w string")
    assert sorted(x.w for x in J.null_safe_join(l, r, [("k", "rk")]).collect()) == ["n", "x"]


def test_operand_parse(spark):
    df = spark.createDataFrame([("[t1].[a]::[t2].[b]",)], "s string")
    r = df.select(J.parse_join_operands(F.col("s")).alias("p")).first().p
    assert (r.left_table, r.left_column, r.right_table, r.right_column) == ("t1", "a", "t2", "b")


def test_connected_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    got = J.connected_components(chain).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}
    assert J.connected_components(chain.limit(0)).collect() == []


def test_star_join_keeps_keys_of_unmatched_rows(spark):
    a = spark.createDataFrame([(1, "x"), (3, "z")], "k int, av string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "bk int, bv string")
    for how, want in (("full", {(1, "x", "p"), (2, None, "q"), (3, "z", None)}), ("right", {(1, "x", "p"), (2, None, "q")}), ("left", {(1, "x", "p"), (3, "z", None)})):
        got = J.star_join({"a": a, "b": b}, [J.Relationship("a", "b", [("k", "bk")], how)])
        assert {tuple(r) for r in got.collect()} == want


def test_extra_edge_joins_the_condition_and_stays_outer(spark):
    a = spark.createDataFrame([(1, 7), (2, 8)], "a1 int, a2 int")
    b = spark.createDataFrame([(1, 10), (2, 20)], "b1 int, b2 int")
    c = spark.createDataFrame([(10, 7), (20, 9)], "c1 int, c2 int")
    edges = [J.Relationship("a", "b", [("a1", "b1")], "left"), J.Relationship("b", "c", [("b2", "c1")], "left"), J.Relationship("a", "c", [("a2", "c2")], "left")]
    got = J.star_join({"a": a, "b": b, "c": c}, edges, keep_right_keys=True).collect()
    assert {(r.a1, r.c1) for r in got} == {(1, 10), (2, None)}


def test_cardinality_ignores_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (2,)], "k int")
    assert J.cardinality(left, right, ["k"], ["k"]).first().cardinality == "ONE_TO_ONE"
