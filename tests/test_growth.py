"""Steps whose tasks must follow the size of the tables."""

from pyspark.sql import functions as F

from lodestar.functions.udf import script_over
from lodestar.operators import extract as X
from lodestar.operators import grouping as G
from lodestar.plans import warehouse as W
from lodestar.plans.dump_queries import extracted_dump
from lodestar.plans.extract_queries import parsed_corpus
from lodestar.sources.workbooks import odd_corpus, workbook_corpus
from lodestar.streaming import intake


def _tables(spark, folder, suppliers):
    """A small star of its own: every table that the corpus reads."""
    def put(name, df):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    put("region", spark.range(1).selectExpr("id AS r_regionkey", "'R' AS r_name"))
    put("nation", spark.range(5).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "0L AS n_regionkey"))
    put("supplier", spark.range(suppliers).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "id % 5 AS s_nationkey", "0D AS s_acctbal"))
    put("customer", spark.range(10).selectExpr("id AS c_custkey", "id % 5 AS c_nationkey", "'BUILDING' AS c_mktsegment"))
    put("orders", spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus"))
    return str(folder)


def test_documents_are_dealt_over_tasks_by_their_number(spark, tmp_path):
    at = _tables(spark, tmp_path, 6000)
    for docs, n in ((workbook_corpus(spark, at), 600), (odd_corpus(spark, at), 6000)):
        tasks = docs.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == n and max(r["count"] for r in tasks) <= n / 10


def test_a_load_from_documents_does_not_start_a_task_for_each_extractor_and_part(spark, tmp_path):
    at, cores = _tables(spark, tmp_path, 3000), spark.sparkContext.defaultParallelism
    spark.range(1).selectExpr("id AS p_partkey").write.parquet(f"{at}/part.parquet")  # its date is looked at
    parsed = parsed_corpus(spark, at)  # 15 tasks parse 300 documents and 5 truncated copies
    assert parsed.rdd.getNumPartitions() <= max(cores, 2)
    assert parsed.count() == parsed.select("path").distinct().count() == 305
    assert {r.path for r in X.errors(parsed).collect()} == {f"/corpus/R/N{i}_0.twb.bad" for i in range(5)}
    dump = extracted_dump(spark, at)
    assert dump.rdd.getNumPartitions() <= 2 * cores
    assert dump.filter("property_type = 'metadata-record'").count() == 3000 and dump.filter("object_type = 'error'").count() == 5
    detail = W.load(dump)["table_detail"].select("column_name", "data_type").collect()
    assert sorted(detail) == sorted((f"S{i}", ("integer", "real", "string", "date")[i % 4]) for i in range(3000))


def test_scripts_run_over_many_small_partitions_in_one_pass(spark):
    big = 2**53 + 1  # not a double
    df = spark.createDataFrame(
        [("a", 2, big, "x", True), ("a", 1, big - 2, None, None), (None, 1, 5, "y", False), (None, None, 7, "z", True), ("b", 1, None, "w", True), ("b", 2, 3, "v", None)],
        "g string, i int, x long, s string, b boolean",
    )
    def run(kind, fn, arg):
        return sorted(((r.g, r.i, r.x, r.v) for r in script_over(df, ["g"], ["i"], kind, fn, [arg], "v").collect()), key=str)

    last = run("INT", lambda x: x * 0 + x.iloc[-1], "x")
    assert last == sorted([("a", 2, big, big), ("a", 1, big - 2, big), (None, 1, 5, 7), (None, None, 7, 7), ("b", 1, None, None), ("b", 2, 3, 3)], key=str)
    texts = run("STR", lambda s: s.fillna("-") + str(len(s)), "s")
    assert {(g, i): v for g, i, _, v in texts} == {("a", 2): "x2", ("a", 1): "-2", (None, 1): "y2", (None, None): "z2", ("b", 1): "w2", ("b", 2): "v2"}
    assert {(g, i): v for g, i, _, v in run("BOOL", lambda b: b.isna(), "b")} == {("a", 2): False, ("a", 1): True, (None, 1): False, (None, None): False, ("b", 1): False, ("b", 2): True}
    falling = run("REAL", lambda x: x.astype(float).sort_values(ascending=False), "x")  # answers stand by their index
    assert {(g, i): v for g, i, _, v in falling}[(None, 1)] == 5.0
    days = df.selectExpr("g", "i", "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, coalesce(i, 0)) AS t", "date'2024-01-01' AS d")
    moved = script_over(days, ["g"], ["i"], "DATETIME", lambda t: t.dt.normalize(), ["t"], "v").selectExpr("CAST(v AS STRING) AS v", "i").collect()
    assert {r.v for r in moved} == {"2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"}
    many = spark.range(2000).selectExpr("id % 700 AS g", "id AS i", "double(id) AS x")
    out = script_over(many, ["g"], ["i"], "REAL", lambda x: x - x.iloc[0] + len(x), ["x"], "v")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert {r.i: r.v for r in out.collect()} == {i: i - i % 700 + len(range(i % 700, 2000, 700)) for i in range(2000)}


def test_a_batch_of_small_files_is_cut_by_its_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1100):
        (tmp_path / "in" / f"{i}.twb").write_text(f"<workbook>{i % 1000}</workbook>")
    intake.run_dedupe(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.select("twb_key").distinct().count() == 1000
    assert rows.select("batch_id").distinct().count() == 1


def test_distinct_values_cross_the_network_once_for_all_grains(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 4 < 3 THEN id % 4 END AS a", "id % 3 AS b", "CASE WHEN id % 7 > 0 THEN string(id % 50) END AS x")
    grains = [["a", "b"], ["b"], []]
    out = G.distinct_counts(G.distinct_state(rows, ["a", "b"], "x"), grains)
    want = {}
    for r in rows.collect():
        for i, g in enumerate(grains):
            want.setdefault((i, *(r[d] if d in g else None for d in ("a", "b"))), set()).update([r.x] if r.x else [])
    assert {(r._grain, r.a, r.b): r.n for r in out.collect()} == {k: len(v) for k, v in want.items()}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    exchanges = [line for line in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange" in line]
    assert not any("_grain" in line and "_part" in line for line in exchanges), plan
