"""The dump from extraction (EX-29), a warehouse load from XML, packaged workbooks
(IO-02) and mapping folders (IO-03)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lodestar.operators.dump import extracted_rows, property_dump
from lodestar.plans import warehouse as W
from lodestar.plans.extract_queries import DOCS, KIND_SQL, parsed_corpus
from lodestar.plans.io_queries import DOC_PATH_SQL
from lodestar.plans.registry import add
from lodestar.sources import sinks as S
from lodestar.sources.mappings import load_mapping_folder
from lodestar.sources.tables import read_table
from lodestar.sources.workbooks import scan_packaged, workbook_corpus


# ------------------------------------------------------------------ EX-29
def _extracted(spark, sf_dir):
    rows = extracted_rows(parsed_corpus(spark, sf_dir))
    kinds = F.col("object_type").isin("table", "custom sql query", "error") | F.col("property_type").isin("ds_type", "join", "metadata-record")
    return rows.filter(kinds).select("path", "object_type", "datasource_name", "table_name", "local_column_name", "property_type", "property_value", "exec_error_details")


_TAG = "'<connection class=\"' || lower(connector) || '\"/>'"
add(
    "ex29_extracted_dump",
    _extracted,
    f"""WITH {DOCS}
SELECT path, 'datasource property' AS object_type, n_name AS datasource_name, NULL AS table_name, NULL AS local_column_name, 'ds_type' AS property_type, {KIND_SQL} AS property_value, NULL AS exec_error_details FROM docs
UNION ALL SELECT path, 'datasource property', n_name, NULL, NULL, 'join', '[' || n_name || '].[key]::[' || next_name || '].[key]', NULL FROM docs WHERE next_name IS NOT NULL
UNION ALL SELECT path, 'table', n_name, CASE WHEN n_nationkey % 7 = 6 THEN 'pub_' || lower(n_name) ELSE '[DB].[' || r_name || '].[' || n_name || ']' END, NULL, 'connection tag', {_TAG}, NULL FROM docs
UNION ALL SELECT path, 'custom sql query', n_name, 'Custom_SQL_' || n_name, NULL, 'text', 'SELECT * FROM ' || n_name, NULL FROM docs WHERE n_nationkey % 5 = 0
UNION ALL SELECT path, 'custom sql query', n_name, 'Custom_SQL_' || n_name, NULL, 'connection tag', {_TAG}, NULL FROM docs WHERE n_nationkey % 5 = 0
UNION ALL SELECT path, 'column', n_name, n_name, s_name, 'metadata-record', ['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1], NULL FROM sup
UNION ALL SELECT DISTINCT path || '.bad', 'error', NULL, NULL, NULL, NULL, NULL, 'could not parse ' || path || '.bad' FROM docs WHERE path LIKE '%\\_0.twb' ESCAPE '\\'""",
)


def _kinds(spark, sf_dir):
    rows = extracted_rows(parsed_corpus(spark, sf_dir))
    return rows.groupBy("object_type", "property_name").agg(F.countDistinct("path").alias("documents")).filter("object_type LIKE 'chart%' OR object_type LIKE 'dashboard%'")


def _count_sql(object_type: str, source: str, names: tuple[str, ...]) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT '{object_type}' AS object_type, v.x AS property_name, (SELECT count(DISTINCT path) FROM {source}) AS documents FROM (VALUES {values}) v(x)"


add(
    "ex29_extracted_chart_and_dashboard_kinds",
    _kinds,
    f"WITH {DOCS}\n"
    + "\nUNION ALL ".join(
        [
            _count_sql("chart", "segs", ("mark",)),
            _count_sql("chart property", "segs", ("color", "size", "rows", "cols", "name", "class", "column", "function", "user:ui-enumeration", "member")),
            _count_sql("dashboard", "dbs", ("layout",)),
            _count_sql("dashboard property", "dbs", ("web", "bitmap", "empty", "button", "vert", "horz", "text", "dashboard filter")),
            _count_sql("dashboard property", "placed", ("h", "w", "x", "y")),
        ]
    ),
)


# ------------------------------------------------------------------ WH-11 from XML
def extracted_dump(spark, sf_dir):
    """The corpus' dump, cut from its lineage: the load reads it a dozen times, so not in the
    partitions of forty extractors but in as many as its size asks for."""
    dump = property_dump(parsed_corpus(spark, sf_dir), "command_line", "2024-01-01 00:00:00", "2024-01-01 00:05:00")
    return dump.hint("rebalance").checkpoint()


def _table_detail(spark, sf_dir):
    w = W.load(extracted_dump(spark, sf_dir))
    names = w["table_header"].select("table_header_id", "table_name")
    return w["table_detail"].join(names, "table_header_id").select("table_name", "column_name", "data_type", "conv_feasibility", "ts_data_type")


add(
    "wh11_table_detail_from_xml",
    _table_detail,
    f"""WITH {DOCS}
SELECT '[DB].[' || r_name || '].[' || n_name || ']' AS table_name, s_name AS column_name, ['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1] AS data_type,
  'Full' AS conv_feasibility, ['INT64', 'DOUBLE', 'VARCHAR', 'DATE'][s_suppkey % 4 + 1] AS ts_data_type
FROM sup WHERE n_nationkey % 7 <> 6""",
)


# ------------------------------------------------------------------ IO-02
def _zip_documents(batches):
    for pdf in batches:
        out = []
        for doc, content in zip(pdf["doc"], pdf["content"]):
            blob = io.BytesIO()
            with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("inner.twb", content)
                z.writestr("Data/readme.txt", "not a workbook")
            out.append((doc, blob.getvalue()))
        yield pd.DataFrame(out, columns=["doc", "value"])


def _io02(spark, sf_dir):
    folder = S.scratch_dir(spark, "packages")
    docs = workbook_corpus(spark, sf_dir).select(F.expr("substring(path, 9)").alias("doc"), "content")
    zips = docs.mapInPandas(_zip_documents, "doc string, value binary").selectExpr("doc", "CAST(value AS STRING) AS value")
    zips.write.partitionBy("doc").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)  # a package each; readers of zip files ignore the trailing line feed
    found = scan_packaged(spark, folder, "part-*")
    doc = F.url_decode(F.regexp_extract("path", "doc=([^/]+)/", 1))
    return found.select(doc.alias("doc"), F.regexp_extract("path", "!(.*)$", 1).alias("inner"), F.col("content").contains("<workbook>").alias("is_workbook"), "error")


add("io02_packaged_scan", _io02, f"WITH {DOCS} SELECT {DOC_PATH_SQL} AS doc, 'inner.twb' AS inner, TRUE AS is_workbook, CAST(NULL AS VARCHAR) AS error FROM docs")


# ------------------------------------------------------------------ IO-03
def _io03(spark, sf_dir):
    folder = S.scratch_dir(spark, "mappings")
    nation = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation.select("n_name", "r_name").repartition(3, "r_name").write.option("header", True).csv(folder)
    frames = load_mapping_folder(spark, folder)
    out = None
    for frame in frames.values():
        out = frame if out is None else out.unionByName(frame)
    return out


add("io03_mapping_folder", _io03, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
