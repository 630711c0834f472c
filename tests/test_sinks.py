import pytest
from pyspark.sql import functions as F

from lodestar import session
from lodestar.operators import formulas as FC
from lodestar.plans import warehouse as W
from lodestar.sources import mappings, sinks


def test_checkpoint_folder_must_be_shared_off_local(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="shared folder"):
        session.checkpoint_dir(Session())


def test_custom_sql_keeps_literals_and_comments():
    text = "SELECT 'a >>  b' AS x, \"q == q\" -- keep >> this\n FROM  t WHERE a  == 1 AND b << 2 /* x == y */"
    assert sinks.normalize_custom_sql(text) == "SELECT 'a >>  b' AS x, \"q == q\" -- keep >> this\n FROM t WHERE a = 1 AND b < 2 /* x == y */"


def test_csv_runs_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "csv")
    for run, n in (("1", 3), ("2", 2), ("2", 2)):
        sinks.append_csv(spark.range(n), path, run)
    assert spark.read.option("header", True).csv(path).count() == 5


def test_mapping_folder(spark, tmp_path):
    (tmp_path / "kinds.csv").write_text("a,b\n1,x\n2,\n")
    (tmp_path / "other.txt").write_text("a\n")
    got = mappings.load_mapping_folder(spark, str(tmp_path))
    assert list(got) == ["kinds"] and [tuple(r) for r in got["kinds"].collect()] == [("1", "x"), ("2", None)]


def test_dependency_depth_of_chains_and_cycles(spark):
    rows = [("w", f"[c{i}]", f"[c{i + 1}] + 1" if i < 60 else "1") for i in range(61)]
    rows += [("w", "[x]", "[y]"), ("w", "[y]", "[x]"), ("w", "[z]", "[x] * 2"), ("v", "[c0]", "SUM([other])")]
    got = {(r.path, r.caller): (r.depth, r.error) for r in FC.dependency_depth(spark.createDataFrame(rows, "path string, name string, formula string")).collect()}
    assert got[("w", "c0")] == (60, None) and got[("w", "c60")] == (0, None) and got[("v", "c0")] == (0, None)
    assert {got[("w", n)] for n in "xyz"} == {(None, "reference cycle")}


def test_comment_markers_inside_literals(spark):
    df = spark.createDataFrame([("p", "n", "IIF([a] = 'http://x/SUM(', [b], [c]) // [d]")], "path string, name string, formula string")
    assert {r.field for r in FC.field_usage(df).collect()} == {"a", "b", "c"}
    assert df.select(FC.rename_functions(F.lit("avg([x]) + Len([y])"))).first()[0] == "average([x]) + strlen([y])"


def test_runs_are_kept_apart_in_the_warehouse(spark, tmp_path):
    def dump(run, sheets):
        rows = [("w.twb", "chart", s, "chart property", "mark", "bar", run, "m") for s in sheets] + [("w.twb", "chart property", s, "x", "p", "v", run, "m") for s in sheets]
        return W.conform_dump(spark.createDataFrame(rows, "twb_file_name string, object_type string, worksheet_name string, property_type string, property_name string, property_value string, exec_id string, exec_mode string"))

    out = str(tmp_path / "wh")
    for run, sheets in (("r1", ["a", "b"]), ("r2", ["c"]), ("r1", ["a"])):
        W.write_run(W.load(dump(run, sheets)), out)
    for table, want in (("worksheet_header", {("r1", 1), ("r2", 1)}), ("worksheet_detail", {("r1", 2), ("r2", 2)})):
        assert {(r.exec_id, r["count"]) for r in spark.read.parquet(f"{out}/{table}").groupBy("exec_id").count().collect()} == want
