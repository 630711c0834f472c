import io
import zipfile

from pyspark.sql import functions as F

from lodestar.operators import extract as X
from lodestar.operators import formulas as FC
from lodestar.plans import warehouse as W
from lodestar.sources.dump_fixture import derive_dump
from lodestar.sources.sinks import append_dump, scratch_dir
from lodestar.sources.tables import Tables
from lodestar.sources.workbooks import scan_packaged, workbook_corpus


def test_warehouse_keys_and_idempotent_load(spark, sf_small):
    dump = derive_dump(spark, sf_small).checkpoint()  # cut the lineage: key checks reuse it ~30 times
    w = W.load(dump)
    ki = {(r.table_name, r.check_name): r.violations for r in W.key_integrity(w).collect()}
    # orphans never happen; duplicated detail keys are the parity keys of Q16
    assert all(v == 0 for (t, c), v in ki.items() if c.startswith("orphan"))
    assert ki[("twb_file", "duplicate twb_file_id")] == 0
    path = scratch_dir(spark, "test-dump")
    append_dump(dump, path)
    append_dump(dump, path)  # Q15: same runs again replace their partitions
    assert spark.read.parquet(path).count() == dump.count()


def test_extraction_round_trip(spark, sf_small):
    p = X.parse(workbook_corpus(spark, sf_small))
    cols = X.columns(p)
    sup = Tables(spark, sf_small).supplier
    assert cols.count() == sup.count()  # one metadata record per supplier row
    assert cols.select("local_column_name").subtract(sup.select("s_name")).count() == 0
    assert X.errors(p).count() == 0


def test_bad_documents_become_error_rows(spark):
    docs = spark.createDataFrame([("a.twb", "<workbook><datasources>"), ("b.twb", "junk")], "path string, content string")
    assert sorted(r.path for r in X.errors(X.parse(docs)).collect()) == ["a.twb", "b.twb"]


def test_packaged_workbooks(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("inner/one.twb", "<workbook/>")
        z.writestr("inner/two.twb", "<workbook/>")
        z.writestr("data/extract.hyper", "x")
    (tmp_path / "pkg.twbx").write_bytes(buf.getvalue())
    (tmp_path / "bad.twbx").write_bytes(b"not a zip")
    rows = scan_packaged(spark, str(tmp_path)).collect()
    assert sorted(r.path.split("!")[-1] for r in rows if r.error is None) == ["inner/one.twb", "inner/two.twb"]
    assert sum(r.error is not None for r in rows) == 1


def test_formula_corpus(spark):
    calcs = spark.createDataFrame(
        [("p", "[Calculation_1]", "SUM([x]) /* LOOKUP( */ // TOTAL(\n + 1"), ("p", "[Calculation_2]", "[Calculation_1] * 2"), ("p", "[Calculation_3]", "LOOKUP([Calculation_2], -1)")],
        "path string, name string, formula string",
    )
    assert sorted(r.function for r in FC.function_usage(calcs).collect()) == ["LOOKUP", "SUM"]
    verdicts = {r.name: r.verdict for r in FC.classify(calcs).collect()}
    assert verdicts == {"[Calculation_1]": "Full", "[Calculation_2]": "Full", "[Calculation_3]": "NoSup"}
    depth = {r.caller: r.depth for r in FC.dependency_depth(calcs).collect()}
    assert depth == {"Calculation_1": 0, "Calculation_2": 1, "Calculation_3": 2}
    renamed = calcs.select(FC.rename_functions(F.lit("CEILING(AVG([x]))")).alias("f")).first().f
    assert renamed == "ceil(average([x]))"


def test_mapping_folder_and_fixed_tables(spark, tmp_path):
    from lodestar.sources import mappings as M

    (tmp_path / "joins.csv").write_text("workbook_join,target_join,live,extract,migrator\n" + M.JOINS_CSV)
    (tmp_path / "datatype.csv").write_text("a,b,c,d,e,f,g,h,i,j\n" + M.DATATYPE_CSV)
    frames = M.load_mapping_folder(spark, str(tmp_path))
    assert set(frames) == {"joins", "datatype"}
    assert frames["joins"].count() == 4 and M.connectors_map(spark).count() == 88


def test_member_range_and_field_rewrite(spark):
    from lodestar.operators.projections import field_rewrite

    df = spark.createDataFrame([("3", "6", "SUM([Sales]) + [Profit]")], "a string, b string, f string")
    r = df.select(X.expand_member_range(F.col("a"), F.col("b")).alias("m"), field_rewrite(F.col("f"), {"Sales": "ORDERS::SALES"}).alias("g")).first()
    assert r.m == [3, 4, 5, 6] and r.g == "SUM([ORDERS::SALES]) + [Profit]"


def test_group_filter_classifier(spark):
    flt = (
        "<filter class='categorical' column='[A]'><groupfilter function='except' level='[A]'><groupfilter function='level-members' level='[A]'/>"
        "<groupfilter function='member' member='x' user:ui-enumeration='exclusive'/></groupfilter></filter>"
        "<filter class='categorical' column='[B]'><groupfilter function='range' from='2' to='4' user:ui-enumeration='inclusive'/></filter>"
        "<filter class='categorical' column='[C]'><groupfilter function='end' count='5' end='top'><groupfilter function='order' direction='DESC'/></groupfilter></filter>"
        "<filter class='categorical' column='[D]'><groupfilter function='filter' expression='x' user:ui-pattern_type='contains' user:ui-pattern_text='ab'/></filter>"
        "<filter class='categorical' column='[E]'><groupfilter function='filter' expression='SUM([x]) &gt; 1'/></filter>"
        "<filter class='categorical' column='[F]'><groupfilter function='except' user:ui-enumeration='inclusive'><groupfilter function='member' member='y'/></groupfilter></filter>"
    )
    xml = f"<workbook><datasources><datasource caption='d' name='n'><connection class='federated'/>{flt}</datasource></datasources></workbook>"
    docs = spark.createDataFrame([("w.twb", xml)], "path string, content string")
    got = {r.column: (r.filter_kind, r.enumeration, r.member) for r in X.datasource_filters(X.parse(docs)).collect()}
    assert got["A"] == ("general", "inclusive", "x")  # except-everything-but flips to inclusive
    assert got["B"] == ("general", None, "2,3,4")  # EX-18 range expansion
    assert got["C"][0] == "top" and got["D"][0] == "wildcard" and got["E"][0] == "condition"
    assert got["F"] == ("general", "exclusive", "y")
