from pyspark.sql import functions as F

from lodestar.streaming import intake


def _write_docs(spark, folder, docs):
    spark.createDataFrame(docs, "doc string, content string").write.mode("append").partitionBy("doc").format("text").save(folder)


WB = "<workbook><datasources><datasource caption='D' name='d'><connection class='federated'/><metadata-records>{}</metadata-records></datasource></datasources></workbook>"
REC = "<metadata-record class='column'><local-name>[{0}]</local-name><parent-name>[T]</parent-name><local-type>string</local-type></metadata-record>"


def test_intake_is_exactly_once_across_restarts(spark, tmp_path):
    src, out, chk = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk")
    _write_docs(spark, src, [("a.twb", WB.format(REC.format("x") + REC.format("y"))), ("bad.twb", "<workbook>")])
    intake.run_intake(spark, src, out, chk, pattern="*.txt")
    first = spark.createDataFrame(spark.read.parquet(out).collect(), spark.read.parquet(out).schema)
    assert first.filter(F.col("object_type") == "column").count() == 2 and first.filter(F.col("object_type") == "error").count() == 1
    intake.run_intake(spark, src, out, chk, pattern="*.txt")  # restart: nothing new
    assert spark.read.parquet(out).count() == first.count()
    _write_docs(spark, src, [("b.twb", WB.format(REC.format("z")))])
    intake.run_intake(spark, src, out, chk, pattern="*.txt")  # only the new file
    assert spark.read.parquet(out).filter(F.col("object_type") == "column").count() == 3


def test_dedupe_keeps_one_copy_per_content(spark, tmp_path):
    src, out, chk = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk")
    same = WB.format(REC.format("x"))
    _write_docs(spark, src + "/a", [("a.twb", same), ("b.twb", WB.format(REC.format("y")))])
    _write_docs(spark, src + "/b", [("a_copy.twb", same)])
    intake.run_dedupe(spark, src, out, chk, pattern="*.txt")
    assert spark.read.parquet(out).select("twb_key").distinct().count() == spark.read.parquet(out).count() == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.createDataFrame([("a.twb", WB.format(REC.format("x"))), ("bad", "<workbook>")], "path string, content string")
    for _ in range(2):
        intake.write_intake_batch(docs, 3, out)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.object_type, r.local_column_name) for r in rows if r.object_type in ("column", "error")) == [("column", "x"), ("error", None)]
    assert len(rows) == len(set(rows)) and ("datasource property", "ds_type") in {(r.object_type, r.property_type) for r in rows}


def test_dedupe_takes_old_files_and_replays(spark, tmp_path):
    out = str(tmp_path / "out")
    def batch(*rows):
        return spark.createDataFrame(rows, "path string, t string, twb_key string").selectExpr("path", "timestamp(t) AS modificationTime", "twb_key")

    intake.write_dedupe_batch(batch(("n/a", "2024-06-01", "k1"), ("n/b", "2024-06-01", "k1")), 0, out)
    old = batch(("o/a", "2001-01-01", "k2"), ("o/b", "2001-01-01", "k1"))  # far older than what was seen
    for _ in range(2):
        intake.write_dedupe_batch(old, 1, out)
    assert sorted((r.twb_key, r.path) for r in spark.read.parquet(out).collect()) == [("k1", "n/a"), ("k2", "o/a")]


def test_dedupe_state_outlives_restarts_and_new_checkpoints(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    doc = lambda name: WB.format(REC.format(name))
    rows = lambda: {(r.twb_key, r.path, r.batch_id) for r in spark.read.parquet(out).collect()}
    _write_docs(spark, src + "/1", [("b.twb", doc("x")), ("c.twb", doc("y")), ("a.twb", doc("x"))])
    intake.run_dedupe(spark, src, out, str(tmp_path / "chk"), pattern="*.txt")
    first = rows()
    assert len(first) == 2 and any("a.twb" in path for _, path, _ in first) and not any("b.twb" in path for _, path, _ in first)
    _write_docs(spark, src + "/0", [("a.twb", doc("y")), ("z.twb", doc("z"))])  # a seen content under a smaller path
    intake.run_dedupe(spark, src, out, str(tmp_path / "chk"), pattern="*.txt")
    second = rows()
    assert first < second and len(second) == 3
    _write_docs(spark, src + "/2", [("w.twb", doc("w"))])
    intake.run_dedupe(spark, src, out, str(tmp_path / "chk2"), pattern="*.txt")  # a new checkpoint sees every file again
    third = rows()
    assert second < third and len(third) == 4 and len({k for k, _, _ in third}) == 4


def test_dedupe_replays_a_batch_that_was_written_but_not_committed(spark, tmp_path):
    src, out, chk = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "chk"
    _write_docs(spark, src, [("a.twb", WB.format(REC.format("x"))), ("b.twb", WB.format(REC.format("x"))), ("c.twb", WB.format(REC.format("y")))])
    intake.run_dedupe(spark, src, out, str(chk), pattern="*.txt")
    rows = sorted(map(tuple, spark.read.parquet(out).collect()))
    for mark in (chk / "commits").iterdir():  # as after a loss between the batch's write and its commit
        mark.unlink()
    intake.run_dedupe(spark, src, out, str(chk), pattern="*.txt")
    assert len(rows) == 2 and sorted(map(tuple, spark.read.parquet(out).collect())) == rows
