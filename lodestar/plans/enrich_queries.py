"""Enrichment (MP-01 … MP-15) and formula-corpus analytics (FC-01 … FC-06)
on the extraction outputs of the row-derived workbook corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import enrich as E
from lodestar.operators import extract as X
from lodestar.operators import formulas as FC
from lodestar.plans.extract_queries import CALC_ID, DOCS, FORMULA, KIND_SQL, parsed_corpus
from lodestar.plans.registry import add
from lodestar.plans.warehouse_sql import with_warehouse
from lodestar.sources import mappings as M
from lodestar.sources.dump_fixture import materialized_warehouse



def _q(qid, fn, select_sql):
    def run(spark, sf_dir):
        return fn(parsed_corpus(spark, sf_dir))

    add(qid, run, f"WITH {DOCS}\n{select_sql}")


def _with_kind(p, df):
    return df.join(X.datasource_kind(p).select("path", "datasource_name", "ds_type"), ["path", "datasource_name"])


_q(
    "mp01_connector_support",
    lambda p: E.connector_support(_with_kind(p, X.connectors(p))).select("path", "datasource_name", "connector", "ds_type", "supported_in_ts"),
    f"SELECT path, n_name AS datasource_name, lower(connector) AS connector, {KIND_SQL} AS ds_type, "
    "CASE lower(connector) WHEN 'splunk' THEN 'NoSup' ELSE 'Full' END AS supported_in_ts FROM docs",
)
_q(
    "mp02_join_type_map",
    lambda p: E.join_type_target(X.join_clauses(p)).select("path", "join_type", "target_join", "join_support"),
    "SELECT path, k AS join_type, CASE k WHEN 'inner' THEN 'INNER' WHEN 'left' THEN 'LEFT_OUTER' WHEN 'right' THEN 'RIGHT_OUTER' ELSE 'OUTER' END AS target_join, "
    "'Full' AS join_support FROM (SELECT *, ['inner', 'left', 'right', 'full'][n_nationkey % 4 + 1] AS k FROM docs WHERE next_name IS NOT NULL)",
)
_q(
    "mp03_data_type_map",
    lambda p: E.data_type_target(X.columns(p)).select("path", "local_column_name", "data_type", "target_type", "role", "aggregation"),
    "SELECT path, s_name AS local_column_name, ty AS data_type, "
    "CASE ty WHEN 'integer' THEN 'INT64' WHEN 'real' THEN 'DOUBLE' WHEN 'string' THEN 'VARCHAR' ELSE 'DATE' END AS target_type, "
    "CASE WHEN ty IN ('integer', 'real') THEN 'measure' ELSE 'dimension' END AS role, "
    "CASE WHEN ty IN ('integer', 'real') THEN 'SUM' ELSE 'COUNT' END AS aggregation "
    "FROM (SELECT *, ['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1] AS ty FROM sup)",
)
_MARK = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bar' WHEN 'BUILDING' THEN 'Line' WHEN 'FURNITURE' THEN 'Text' WHEN 'HOUSEHOLD' THEN 'Circle' ELSE 'Automatic' END"
_q(
    "mp04_mark_map",
    lambda p: E.mark_support(X.marks(p)).select("path", "worksheet_name", "mark", "supported_in_ts", "conversion_in_ts"),
    f"SELECT path, worksheet_name, {_MARK} AS mark, "
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Full' WHEN 'BUILDING' THEN 'Full' WHEN 'FURNITURE' THEN 'NoSup' WHEN 'HOUSEHOLD' THEN 'Partial' ELSE 'Default' END AS supported_in_ts, "
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Use bar or column chart.' WHEN 'BUILDING' THEN 'Use line chart.' WHEN 'FURNITURE' THEN 'No equivalent chart type supported.' "
    "WHEN 'HOUSEHOLD' THEN 'Use scatter chart.' ELSE 'No suggestion as mark type is not known.' END AS conversion_in_ts FROM segs",
)
_q(
    "mp05_encoding_map",
    lambda p: E.encoding_support(X.encodings(p)).select("path", "worksheet_name", "channel", "supported_in_ts", "conversion_in_ts"),
    "SELECT path, worksheet_name, 'color' AS channel, 'Full' AS supported_in_ts, 'Include color field in search and slice with color using this field.' AS conversion_in_ts FROM segs "
    "UNION ALL SELECT path, worksheet_name, 'size', 'NoSup', 'Size feature is not supported.' FROM segs",
)
_q(
    "mp06_axis_verdict",
    lambda p: E.axis_verdict(X.axes(p)).select("path", "worksheet_name", "row_field", "col_field", "axis_verdict", "axis_support"),
    "SELECT path, worksheet_name, 'none:N_NAME:nk' AS row_field, 'sum:C_ACCTBAL:qk' AS col_field, 'Partial' AS axis_verdict, 'Partial' AS axis_support FROM segs",
)
_q(
    "mp07_geo_override",
    lambda p: E.geo_override(X.encodings(p)).select("path", "worksheet_name", "channel", "geo_hint"),
    "SELECT path, worksheet_name, 'color' AS channel, CAST(NULL AS VARCHAR) AS geo_hint FROM segs "
    "UNION ALL SELECT path, worksheet_name, 'size', CAST(NULL AS VARCHAR) FROM segs",
)


def _mp08(p):
    f = X.datasource_filters(p).withColumn(
        "function_key", F.coalesce(F.col("filter_kind"), F.col("range_kind"), F.when(F.col("filter_class") == "relative-date", F.col("filter_class")))
    ).withColumn("pattern_type", F.lit(None).cast("string"))
    return E.filter_support(_with_kind(p, f)).select("path", "filter_name", "filter_class", "ds_type", "supported_in_ts")


_q(
    "mp08_filter_support",
    _mp08,
    f"SELECT path, 'Filter_' || CAST(k AS VARCHAR) AS filter_name, cls AS filter_class, {KIND_SQL} AS ds_type, "
    "CASE WHEN cls = 'relative-date' THEN 'NoSup' ELSE 'Full' END AS supported_in_ts FROM "
    "(SELECT d.path, d.n_nationkey, ['categorical', 'quantitative', 'relative-date'][(d.n_nationkey + CAST(substr(p.o_orderpriority, 1, 1) AS INTEGER)) % 3 + 1] AS cls, "
    "row_number() OVER (PARTITION BY d.path ORDER BY p.o_orderpriority) AS k FROM docs d JOIN (SELECT DISTINCT c_nationkey, o_orderpriority FROM occ) p ON p.c_nationkey = d.n_nationkey)",
)
_q(
    "mp09_dashboard_property_map",
    lambda p: E.dashboard_feature_support(X.special_zones(p)).select("path", "dashboard_name", "zone_type", "supported_in_ts", "conversion_in_ts"),
    "SELECT path, dashboard_name, 'web' AS zone_type, 'NoSup' AS supported_in_ts, CAST(NULL AS VARCHAR) AS conversion_in_ts FROM dbs "
    "UNION ALL SELECT path, dashboard_name, 'empty', 'Partial', 'Add blank tile or leave blank space between viz' FROM dbs "
    "UNION ALL SELECT path, dashboard_name, 'bitmap', 'Partial', 'Add a tile and embed image on it' FROM dbs",
)


def _mp10(spark, sf_dir):
    d = materialized_warehouse(spark, sf_dir)["raw_data_dump"].filter(F.col("property_type") == "calculated_column")
    return d.select("exec_id", "twb_file_name", "datasource_name", "property_name", E.formula_verdict_from_text(F.col("conversion_in_ts")).alias("verdict"))


add(
    "mp10_formula_verdict",
    _mp10,
    with_warehouse(
        "SELECT exec_id, twb_file_name, datasource_name, property_name, CASE WHEN contains(conversion_in_ts, 'TBD') THEN 'Partial' "
        "WHEN contains(conversion_in_ts, 'None') THEN 'NoSup' ELSE 'Full' END AS verdict FROM raw_data_dump WHERE property_type = 'calculated_column'"
    ),
)


def _mp11(p):
    k = X.datasource_kind(p).select("path", "datasource_name")
    out = E.run_stamp(k, "feasibility", "2024-01-01 10:00:00", "2024-01-01 10:05:30")
    return out.select("path", "datasource_name", "exec_mode", "exec_status", "exec_id")


_q(
    "mp11_run_stamp",
    _mp11,
    "SELECT path, n_name AS datasource_name, 'feasibility' AS exec_mode, 'Success' AS exec_status, "
    "md5('feasibility' || '2024-01-01 10:00:00' || '2024-01-01 10:05:30') AS exec_id FROM docs",
)
_q(
    "mp12_target_label",
    lambda p: X.datasource_kind(p).select("path", "datasource_name", E.target_label(F.col("ds_type")).alias("conversion_in_ts")),
    f"SELECT path, n_name AS datasource_name, CASE WHEN {KIND_SQL} = 'Extract' THEN '{M.TARGET_EXTRACT}' ELSE '{M.TARGET_TABLE}' END AS conversion_in_ts FROM docs",
)


def _mp13(p):
    rows = X.columns(p).withColumnRenamed("local_column_name", "row_pos").withColumn("output_file_type", F.lit(None).cast("string")).withColumn("output_file_name", F.lit(None).cast("string"))
    outs = X.datasource_kind(p).select("path", "datasource_name", F.lit("table tml").alias("output_file_type"), F.concat(F.lower("datasource_name"), F.lit(".table.tml")).alias("output_file_name"))
    stamped = E.output_stamp(rows, outs, match=("path", "datasource_name"), order_col="row_pos")
    return stamped.select("path", "datasource_name", F.col("row_pos").alias("column_name"), "output_file_type", "output_file_name")


_q(
    "mp13_output_stamp",
    _mp13,
    "SELECT path, n_name AS datasource_name, s_name AS column_name, CASE WHEN rn = 1 THEN 'table tml' END AS output_file_type, "
    "CASE WHEN rn = 1 THEN lower(n_name) || '.table.tml' END AS output_file_name FROM "
    "(SELECT *, row_number() OVER (PARTITION BY path, n_name ORDER BY s_name) AS rn FROM sup)",
)


def _mp14(p):
    from lodestar.operators.projections import clean_name

    t = X.tables(p).select("path", clean_name(F.col("table_name")).alias("table_name"))
    c = X.columns(p).select("path", "table_name")
    return E.missing_tables(t, c)


# published datasources name their table by the proxy db name, so their columns'
# parent tables are known only from the columns
_q("mp14_missing_table_rows", _mp14, "SELECT path, n_name AS table_name FROM docs WHERE n_nationkey % 7 = 6")


def _mp15(p):
    _, rejected = E.connector_gate(X.connectors(p), ["snowflake", "postgresql", "mysql"])
    return rejected.select("path", "connector", "exec_error_details")


_q(
    "mp15_connector_gate",
    _mp15,
    "SELECT path, lower(connector) AS connector, 'connector not allowed: ' || lower(connector) AS exec_error_details FROM docs "
    "WHERE lower(connector) NOT IN ('snowflake', 'postgresql', 'mysql')",
)

# ----------------------------------------------------------------- FC-01 … FC-06
CALCS_SQL = (
    f"calcs AS (SELECT path, {CALC_ID} || ']' AS name, c_mktsegment, {FORMULA} AS formula FROM segs "
    f"UNION ALL SELECT path, {CALC_ID} || '_R]', c_mktsegment, {CALC_ID} || '] / 100' FROM segs)"
)
SUPPORT_SQL = "sup_t(function, verdict, verdict_rank) AS (VALUES " + ", ".join(
    f"('{k}', '{v}', {FC.VERDICT_RANK[v]})" for k, v in FC.FUNCTION_SUPPORT.items()
) + ")"


def _fc(qid, fn, select_sql):
    def run(spark, sf_dir):
        return fn(X.calculated_fields(parsed_corpus(spark, sf_dir)))

    add(qid, run, f"WITH {DOCS},\n{CALCS_SQL},\n{SUPPORT_SQL}\n{select_sql}")


FUNCS_SQL = r"(SELECT path, name, unnest(list_distinct(regexp_extract_all(upper(formula), '([A-Z_][A-Z0-9_]*)\s*\(', 1))) AS function FROM calcs)"
_fc("fc01_function_usage", lambda c: FC.function_usage(c), f"SELECT path, name, function FROM {FUNCS_SQL}")
_fc(
    "fc02_field_usage",
    lambda c: FC.field_usage(c),
    r"SELECT path, name, unnest(list_distinct(regexp_extract_all(formula, '\[([^\]]+)\]', 1))) AS field FROM calcs",
)
_fc(
    "fc03_support_classification",
    lambda c: FC.classify(c),
    f"SELECT c.path, c.name, CASE coalesce(max(s.verdict_rank), 0) WHEN 2 THEN 'NoSup' WHEN 1 THEN 'Partial' ELSE 'Full' END AS verdict "
    f"FROM (SELECT DISTINCT path, name FROM calcs) c LEFT JOIN {FUNCS_SQL} u ON u.path = c.path AND u.name = c.name "
    "LEFT JOIN sup_t s ON s.function = u.function GROUP BY c.path, c.name",
)
_REN = "formula"
for _src, _dst in FC.RENAMES.items():
    _REN = f"regexp_replace({_REN}, '\\b{_src}\\s*\\(', '{_dst}(', 'gi')"
_fc("fc04_function_renaming", lambda c: c.select("path", "name", FC.rename_functions(F.col("formula")).alias("formula")), f"SELECT path, name, {_REN} AS formula FROM calcs")


def _fc05(c):
    return FC.dependency_depth(c, keys=("path",)).select("path", "caller", "depth")


_fc(
    "fc05_dependency_depth",
    _fc05,
    "SELECT DISTINCT path, regexp_replace(name, '^\\[|\\]$', '', 'g') AS caller, CASE WHEN name LIKE '%\\_R]' ESCAPE '\\' THEN 1 ELSE 0 END AS depth FROM calcs",
)


def _fc06(c):
    return FC.convertible_share(FC.classify(c))


_fc(
    "fc06_convertible_share",
    _fc06,
    f"SELECT path, count(*) AS formulas, count(*) FILTER (WHERE verdict = 'Full') AS convertible, "
    f"round(count(*) FILTER (WHERE verdict = 'Full') / count(*), 6) AS share FROM "
    f"(SELECT c.path, c.name, CASE coalesce(max(s.verdict_rank), 0) WHEN 2 THEN 'NoSup' WHEN 1 THEN 'Partial' ELSE 'Full' END AS verdict "
    f"FROM (SELECT DISTINCT path, name FROM calcs) c LEFT JOIN {FUNCS_SQL} u ON u.path = c.path AND u.name = c.name "
    "LEFT JOIN sup_t s ON s.function = u.function GROUP BY c.path, c.name) GROUP BY path",
)


def _p03(p):
    cols = X.columns(p)
    calcs = cols.select("path", "datasource_name", F.concat(F.lit("SUM(["), F.col("local_column_name"), F.lit("]) / 2")).alias("formula"), "local_column_name")
    out = FC.rewrite_fields(calcs, cols.drop("data_type"), X.datasource_kind(p).select("path", "datasource_name", "ds_type"))
    return out.select("path", "local_column_name", "formula")


_q(
    "p03_field_rewrite",
    _p03,
    f"SELECT path, s_name AS local_column_name, 'SUM([' || CASE WHEN {KIND_SQL} = 'Extract' THEN upper(s_name) ELSE n_name || '::' || s_name END || ']) / 2' AS formula FROM sup",
)
