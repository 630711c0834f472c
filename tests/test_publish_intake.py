import pytest
from pyspark.sql import functions as F
from test_streaming import REC, WB, _write_docs

from lodestar.functions.udf import script_over
from lodestar.operators import tablecalc as tc
from lodestar.sources import published as P
from lodestar.streaming import intake


def _tables(spark, rows, details):
    return {"head": spark.createDataFrame(rows, "k long, exec_id string"), "detail": spark.createDataFrame(details, "k long, v string, exec_id string")}


def _seen(spark, out):
    return {n: sorted(map(tuple, P.read_published(spark, out, n).collect())) for n in ("head", "detail")}


def test_readers_see_whole_loads_only(spark, tmp_path):
    out = str(tmp_path / "wh")
    assert P.publish(_tables(spark, [(1, "r1"), (2, "r2")], [(1, "a", "r1")]), ["r1", "r2"], out) == 1
    old = {"head": [(1, "r1"), (2, "r2")], "detail": [(1, "a", "r1")]}
    assert _seen(spark, out) == old
    failing = _tables(spark, [(9, "r1")], [(9, "z", "r1")])
    failing["detail"] = failing["detail"].withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        P.publish(failing, ["r1"], out)
    assert _seen(spark, out) == old  # though the head was staged
    assert P.vacuum(spark, out) >= 1 and _seen(spark, out) == old
    held = P.manifest(spark, out)[1]
    assert P.publish(_tables(spark, [(3, "r1")], []), ["r1"], out) == 2  # the run has no details now
    assert _seen(spark, out) == {"head": [(2, "r2"), (3, "r1")], "detail": []}
    assert sorted(map(tuple, P.at_version(spark, out, "head", held).collect())) == old["head"]  # a reader that began before


def test_a_load_that_comes_second_builds_on_the_first(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "wh")
    commit, late = P._commit, []

    def slow(spark_, out_, version, content):
        if not late:
            late.append(version)
            P.publish(_tables(spark, [(7, "other")], []), ["other"], out)
        return commit(spark_, out_, version, content)

    monkeypatch.setattr(P, "_commit", slow)
    assert P.publish(_tables(spark, [(1, "r1")], [(1, "a", "r1")]), ["r1"], out) == 2
    assert _seen(spark, out) == {"head": [(1, "r1"), (7, "other")], "detail": [(1, "a", "r1")]}


def test_files_are_taken_once_by_any_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_docs(spark, src, [("a.twb", WB.format(REC.format("x"))), ("b.twb", WB.format(REC.format("y")))])
    for checkpoint in ("one", "two", "one"):
        intake.run_intake(spark, src, out, str(tmp_path / checkpoint), pattern="*.txt")
    _write_docs(spark, src, [("c.twb", WB.format(REC.format("z")))])
    for checkpoint in ("three", "one"):
        intake.run_intake(spark, src, out, str(tmp_path / checkpoint), pattern="*.txt")
    columns = spark.read.parquet(out).filter("object_type = 'column'")
    assert sorted(r.local_column_name for r in columns.collect()) == ["x", "y", "z"]
    files = intake.taken_files(spark, out)
    assert files.count() == files.select("path").distinct().count() == 3 and files.filter("length IS NULL OR content_md5 IS NULL").count() == 0


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    docs = spark.createDataFrame([("a", WB.format(REC.format("x"))), ("b", WB.format(REC.format("y")))], "path string, content string")
    rows = intake.extracted_rows
    monkeypatch.setattr(intake, "extracted_rows", lambda parsed: rows(parsed).withColumn("path", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        intake.write_intake_batch(docs, 0, out)
    monkeypatch.setattr(intake, "extracted_rows", rows)
    assert intake.taken_files(spark, out).count() == 0
    intake.write_intake_batch(docs.limit(1), 0, out)  # other batches than before
    intake.write_intake_batch(docs, 1, out)
    changed = spark.createDataFrame([("a", WB.format(REC.format("x2")))], "path string, content string")
    intake.write_intake_batch(changed.union(docs), 2, out)
    names = [r.local_column_name for r in spark.read.parquet(out).filter("object_type = 'column'").collect()]
    assert sorted(names) == ["x", "x2", "y"]


def test_previous_value_over_a_million_rows(spark):
    df = spark.range(1_000_000).selectExpr("id % 2 AS g", "id AS i", "id % 1000 AS x").repartition(8)
    got = tc.previous_value_fold(df, ["g"], ["i"], "x", 1, lambda v, x: (v * 31 + x) % 65_521, "v", "bigint").filter("i >= 999998").collect()
    want = {}
    for g in (0, 1):
        v = 1
        for i in range(g, 1_000_000, 2):
            v = (v * 31 + i % 1000) % 65_521
        want[g] = v
    assert {r.g: r.v for r in got} == want
    odd = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), (None, 1, 3.0)], "g string, i int, x double")
    fold = tc.previous_value_fold(odd, ["g"], ["i"], "x", 0.5, lambda v, x: v + (x or 0.0), "v", "double")
    assert sorted(map(tuple, fold.collect()), key=str) == sorted([("a", 1, None, 0.5), ("a", 2, 2.0, 2.5), (None, 1, 3.0, 3.5)], key=str)
    assert tc.previous_value_fold(odd.limit(0), [], ["i"], "x", 0.0, lambda v, x: v, "v", "double").collect() == []


def test_a_script_sees_its_partition_at_any_batch_size(spark):
    df = spark.range(500).selectExpr("id % 3 AS g", "499 - id AS i", "double(id) AS x").repartition(7)
    seen = set()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            rows = script_over(df, ["g"], ["i"], "REAL", lambda x: x.iloc[0] - x + len(x), ["x"], "v").collect()
            seen.add(tuple(sorted((r.i, r.v) for r in rows)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    first = {g: max(i for i in range(500) if i % 3 == g) for g in range(3)}
    size = {g: sum(i % 3 == g for i in range(500)) for g in range(3)}
    assert seen == {tuple(sorted((499 - i, float(first[i % 3] - i + size[i % 3])) for i in range(500)))}
