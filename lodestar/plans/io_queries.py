"""Sources, sinks, streaming intake and the pass-through UDF surface
(IO-01, IO-05, IO-06, IO-07, IO-11, ST-01, ST-02, U01 … U16)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestar.functions.udf import rawsql, rawsqlagg, script, script_over
from lodestar.plans.extract_queries import DOCS
from lodestar.plans.registry import add
from lodestar.plans.warehouse_sql import with_warehouse
from lodestar.sources import sinks as S
from lodestar.sources.dump_fixture import materialized_warehouse
from lodestar.sources.tables import Tables, read_table
from lodestar.sources.workbooks import scan_workbooks, workbook_corpus
from lodestar.streaming import intake

DOC_PATH_SQL = "substr(path, 9)"  # '/corpus/' prefix removed -> 'REGION/NATION_b.twb'


def _write_corpus_files(spark, sf_dir, folder, copies=1):
    """Write every corpus document as its own file: ``folder/copy_k/doc=<name>/part-*.twb``.

    Tasks put their own files in place (committer version 2; a task that runs again writes the same
    names), so the driver doesn't move them one by one."""
    docs = workbook_corpus(spark, sf_dir).select(F.expr("substring(path, 9)").alias("doc"), "content")
    for k in range(copies):
        docs.write.mode("overwrite").partitionBy("doc").option("compression", "none").option("mapreduce.fileoutputcommitter.algorithm.version", "2").format("text").save(f"{folder}/copy_{k}")
    return folder


def _doc_from_path(path_col):
    return F.url_decode(F.regexp_extract(path_col, r"doc=([^/]+)/", 1))


# ------------------------------------------------------------------ IO-01
def _io01(spark, sf_dir):
    folder = _write_corpus_files(spark, sf_dir, S.scratch_dir(spark, "scan"))
    docs = scan_workbooks(spark, folder, "*.txt")
    return docs.select(_doc_from_path(F.col("path")).alias("doc"), F.length("content").cast("bigint").alias("n_chars"))


add("io01_workbook_folder_scan", lambda s, d: _io01(s, d).select("doc").distinct(), f"WITH {DOCS} SELECT DISTINCT {DOC_PATH_SQL} AS doc FROM docs")


# ------------------------------------------------------------------ IO-05 / IO-06 / IO-07
def _io05(spark, sf_dir):
    dump = materialized_warehouse(spark, sf_dir)["raw_data_dump"]
    path = S.scratch_dir(spark, "dump")
    S.append_dump(dump, path)
    S.append_dump(dump, path)  # same runs again: partitions replaced, not duplicated
    back = spark.read.parquet(path)
    return back.groupBy("exec_id", "object_type").agg(F.count(F.lit(1)).alias("n"))


add("io05_dump_append_idempotent", _io05, with_warehouse("SELECT exec_id, object_type, count(*) AS n FROM raw_data_dump GROUP BY 1, 2"))


def _io06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    path = S.scratch_dir(spark, "csv")
    S.append_csv(rows.filter(F.col("s_nationkey") < 12), path, "1")  # first run writes the header + rows
    for _ in range(2):  # the second run appends; written again, it replaces itself
        S.append_csv(rows.filter(F.col("s_nationkey") >= 12), path, "2")
    back = spark.read.option("header", True).schema("s_suppkey bigint, s_name string, s_nationkey int").csv(path)
    return back.select("s_suppkey", "s_name", "s_nationkey")


add("io06_combined_csv_append", _io06, "SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def _io07(spark, sf_dir):
    w = materialized_warehouse(spark, sf_dir)
    cols = (
        w["table_detail"]
        .join(w["table_header"].select("table_header_id", "table_name", "exec_id"), "table_header_id")
        .filter(F.col("exec_id") == F.md5(F.lit("run1")))
        .select("table_name", "column_name", "data_type")
    )
    path = S.scratch_dir(spark, "docs")
    S.write_documents(cols, "table_name", ["column_name", "data_type"], path)
    back = spark.read.text(path)
    parsed = back.select(F.from_json("value", "name string, items array<struct<column_name:string,data_type:string>>").alias("d"))
    return parsed.select(F.col("d.name").alias("table_name"), F.size("d.items").cast("bigint").alias("n_columns"))


add(
    "io07_document_sink",
    _io07,
    with_warehouse("SELECT t.table_name, count(*) AS n_columns FROM td d JOIN th t USING (table_header_id) WHERE t.exec_id = md5('run1') GROUP BY 1"),
)

# ------------------------------------------------------------------ IO-11
CUSTOM_SQL = "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey == n_nationkey GROUP BY n_name HAVING count(*) >> 0"


def _io11(spark, sf_dir):
    for name in ("supplier", "nation"):
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return S.custom_sql_source(spark, "custom_sql_1", CUSTOM_SQL)


add("io11_custom_sql_source", _io11, S.normalize_custom_sql(CUSTOM_SQL))


# ------------------------------------------------------------------ ST-01 / ST-02
def _st01(spark, sf_dir):
    base = S.scratch_dir(spark, "stream")
    _write_corpus_files(spark, sf_dir, f"{base}/in")
    intake.run_intake(spark, f"{base}/in", f"{base}/out", f"{base}/chk", pattern="*.txt")
    out = spark.read.parquet(f"{base}/out")
    return out.filter(F.col("property_type") == "metadata-record").select(_doc_from_path(F.col("path")).alias("doc"), "local_column_name", F.col("property_value").alias("data_type"))


add(
    "st01_streaming_intake",
    _st01,
    f"WITH {DOCS} SELECT {DOC_PATH_SQL} AS doc, s_name AS local_column_name, ['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1] AS data_type FROM sup",
)


def _st02(spark, sf_dir):
    base = S.scratch_dir(spark, "dedupe")
    _write_corpus_files(spark, sf_dir, f"{base}/in", copies=2)
    intake.run_dedupe(spark, f"{base}/in", f"{base}/out", f"{base}/chk", pattern="*.txt")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy(_doc_from_path(F.col("path")).alias("doc")).agg(F.count(F.lit(1)).alias("kept"))


add(
    "st02_streaming_dedupe",
    _st02,
    f"WITH {DOCS} SELECT DISTINCT {DOC_PATH_SQL} AS doc, CAST(1 AS BIGINT) AS kept FROM docs",
)

# ------------------------------------------------------------------ U01 … U16
_RAW = [
    ("u01_rawsql_bool", "BOOL", "o_totalprice > 250000", "CAST(o_totalprice > 250000 AS BOOLEAN)"),
    ("u02_rawsql_date", "DATE", "date_add(CAST(o_orderdate AS DATE), 30)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE)"),
    ("u03_rawsql_datetime", "DATETIME", "o_orderdate", "o_orderdate"),
    ("u04_rawsql_int", "INT", "o_custkey * 10 + length(o_orderpriority)", "CAST(o_custkey * 10 + length(o_orderpriority) AS BIGINT)"),
    ("u05_rawsql_real", "REAL", "round(o_totalprice / 3, 4)", "CAST(round(o_totalprice / 3, 4) AS DOUBLE)"),
    ("u06_rawsql_str", "STR", "concat(o_orderstatus, '-', o_orderpriority)", "CAST(concat(o_orderstatus, '-', o_orderpriority) AS VARCHAR)"),
]
for _id, _kind, _expr, _sql in _RAW:

    def _fn(spark, sf_dir, _kind=_kind, _expr=_expr):
        o = Tables(spark, sf_dir).orders
        v = rawsql(_kind, _expr)
        if _kind == "DATETIME":
            v = v.cast("string")
        return o.select("o_orderkey", v.alias("v"))

    _s = f"CAST({_sql} AS VARCHAR)" if _kind == "DATETIME" else _sql
    add(_id, _fn, f"SELECT o_orderkey, {_s} AS v FROM orders")

_RAWAGG = [
    ("u07_rawsqlagg_bool", "BOOL", "max(o_totalprice) > 450000", "max(o_totalprice) > 450000"),
    ("u08_rawsqlagg_date", "DATE", "min(CAST(o_orderdate AS DATE))", "min(CAST(o_orderdate AS DATE))"),
    ("u09_rawsqlagg_datetime", "DATETIME", "max(o_orderdate)", "max(o_orderdate)"),
    ("u10_rawsqlagg_int", "INT", "count(DISTINCT o_custkey)", "count(DISTINCT o_custkey)"),
    ("u11_rawsqlagg_real", "REAL", "round(avg(o_totalprice), 4)", "round(avg(o_totalprice), 4)"),
    ("u12_rawsqlagg_str", "STR", "max(o_orderpriority)", "max(o_orderpriority)"),
]
_T = {"BOOL": "BOOLEAN", "DATE": "DATE", "DATETIME": "TIMESTAMP", "INT": "BIGINT", "REAL": "DOUBLE", "STR": "VARCHAR"}
for _id, _kind, _expr, _sql in _RAWAGG:

    def _fn(spark, sf_dir, _kind=_kind, _expr=_expr):
        o = Tables(spark, sf_dir).orders
        v = rawsqlagg(_kind, _expr)
        out = o.groupBy("o_orderstatus").agg(v.alias("v"))
        return out.withColumn("v", F.col("v").cast("string")) if _kind == "DATETIME" else out

    _s = f"CAST(CAST({_sql} AS TIMESTAMP) AS VARCHAR)" if _kind == "DATETIME" else f"CAST({_sql} AS {_T[_kind]})"
    add(_id, _fn, f"SELECT o_orderstatus, {_s} AS v FROM orders GROUP BY o_orderstatus")


# SCRIPT_*: vectorised Python over Arrow batches; partition context joined in by Spark
def _above(x: pd.Series, mean: pd.Series) -> pd.Series:
    return x > mean


def _bucket(x: pd.Series) -> pd.Series:
    return (x // 50000).astype("int64")


def _zscore(x: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
    return (x - mean) / std


def _label(s: pd.Series, p: pd.Series) -> pd.Series:
    return s.str.lower() + "/" + p.str.slice(0, 1)


def _with_stats(o):
    stats = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"))
    return o.join(stats, "o_orderpriority")


_STATS_SQL = "(SELECT o.*, s.mean, s.std FROM orders o JOIN (SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM orders GROUP BY 1) s USING (o_orderpriority))"


def _u13(spark, sf_dir):
    o = _with_stats(Tables(spark, sf_dir).orders)
    return o.select("o_orderkey", script("BOOL", _above)(F.col("o_totalprice"), F.col("mean")).alias("v"))


add("u13_script_bool", _u13, f"SELECT o_orderkey, o_totalprice > mean AS v FROM {_STATS_SQL}")


def _u14(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", script("INT", _bucket)(F.col("o_totalprice")).alias("v"))


add("u14_script_int", _u14, "SELECT o_orderkey, CAST(floor(o_totalprice / 50000) AS BIGINT) AS v FROM orders")


def _u15(spark, sf_dir):
    o = _with_stats(Tables(spark, sf_dir).orders)
    return o.select("o_orderkey", F.round(script("REAL", _zscore)(F.col("o_totalprice"), F.col("mean"), F.col("std")), 4).alias("v"))


add("u15_script_real", _u15, f"SELECT o_orderkey, round((o_totalprice - mean) / std, 4) AS v FROM {_STATS_SQL}")


def _u16(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", script("STR", _label)(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("v"))


add("u16_script_str", _u16, "SELECT o_orderkey, lower(o_orderstatus) || '/' || substr(o_orderpriority, 1, 1) AS v FROM orders")


def _since_first(x: pd.Series) -> pd.Series:
    return x - x.iloc[0] + len(x)


def _u15_partition(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return script_over(o, ["o_custkey"], ["o_orderkey"], "REAL", _since_first, ["o_totalprice"], "v").select("o_orderkey", "v")


add(
    "u15_script_partition",
    _u15_partition,
    "SELECT o_orderkey, o_totalprice - first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + count(*) OVER (PARTITION BY o_custkey) AS v FROM orders",
)


def _st01_again(spark, sf_dir):
    """ST-01 with a fresh checkpoint over the same output: every file stays taken once."""
    base = S.scratch_dir(spark, "stream")
    _write_corpus_files(spark, sf_dir, f"{base}/in")
    for checkpoint in ("a", "b"):
        intake.run_intake(spark, f"{base}/in", f"{base}/out", f"{base}/{checkpoint}", pattern="*.txt")
    rows = spark.read.parquet(f"{base}/out").filter(F.col("property_type") == "metadata-record").groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    files = intake.taken_files(spark, f"{base}/out").groupBy("path").agg(F.count(F.lit(1)).alias("n_taken"))
    return files.join(rows, "path", "left").select(_doc_from_path(F.col("path")).alias("doc"), "n_taken", "n_rows")


add("st01_fresh_checkpoint", _st01_again, f"WITH {DOCS} SELECT {DOC_PATH_SQL} AS doc, CAST(1 AS BIGINT) AS n_taken, count(*) AS n_rows FROM sup GROUP BY 1")
