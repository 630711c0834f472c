"""DuckDB oracle SQL for the property dump fixture and the warehouse load.

Independent SQL statement of the same rules as ``dump_fixture.derive_dump``
and ``warehouse.load``; used only by ``oracle_sql()``.
"""

from lodestar.sources.mappings import TARGET_EXTRACT, TARGET_TABLE

DUMP_CTES = r"""
nat AS (
  SELECT r_name, n_name, n_nationkey, r_name || '.twb' AS twb_file_name,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Extract' ELSE 'Live' END AS ds_type,
         ['Snowflake', 'PostgreSQL', 'Splunk', 'MySQL'][n_nationkey % 4 + 1] AS connector
  FROM nation JOIN region ON n_regionkey = r_regionkey),
occn AS (
  SELECT * FROM (SELECT DISTINCT c_nationkey, o_orderpriority, o_orderstatus, c_mktsegment
                 FROM orders JOIN customer ON o_custkey = c_custkey) JOIN nat ON c_nationkey = n_nationkey),
firstds AS (SELECT r_name, arg_min(n_name, n_nationkey) AS first_ds FROM nat GROUP BY r_name),
ws AS (
  SELECT w.*, f.first_ds, r_name || '_' || c_mktsegment AS worksheet_name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bar' WHEN 'BUILDING' THEN 'Line' WHEN 'FURNITURE' THEN 'Text'
                           WHEN 'HOUSEHOLD' THEN 'Circle' WHEN 'MACHINERY' THEN 'Automatic' END AS mark
  FROM (SELECT DISTINCT r_name, twb_file_name, c_mktsegment FROM customer JOIN nat ON c_nationkey = n_nationkey) w
  JOIN firstds f USING (r_name)),
calc AS (
  SELECT r_name, twb_file_name, n_name, n_nationkey, c_mktsegment,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SUM([Sales]) / TOTAL(SUM([Sales]))'
                           WHEN 'BUILDING' THEN 'RUNNING_SUM(SUM([Sales]))'
                           WHEN 'FURNITURE' THEN '([Profit] - LOOKUP([Profit], -1)) / ABS(LOOKUP([Profit], -1))'
                           WHEN 'HOUSEHOLD' THEN 'IF YEAR([Order Date]) = 2019 THEN [Sales] ELSE 0 END'
                           WHEN 'MACHINERY' THEN 'STDEV([Sales]) / AVG([Sales])' END AS formula
  FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) JOIN nat ON c_nationkey = n_nationkey),
base AS (
  SELECT r_name, twb_file_name, 'datasource property' AS object_type, n_name AS datasource_name, 'ds_type' AS property_type,
         'connection' AS property_name, ds_type AS property_value, 'Full' AS supported_in_ts,
         CASE WHEN ds_type = 'Extract' THEN 'sql files' ELSE 'model tml' END AS output_file_type,
         lower(n_name) || CASE WHEN ds_type = 'Extract' THEN '.sql' ELSE '.model.tml' END AS output_file_name
  FROM nat
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'datasource property' AS object_type, n_name AS datasource_name, 'named_connection' AS property_type,
         'connector' AS property_name, connector AS property_value,
         CASE connector WHEN 'Splunk' THEN 'NoSup' ELSE 'Full' END AS supported_in_ts
  FROM nat
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'datasource property' AS object_type, n_name AS datasource_name, 'join' AS property_type,
         k AS property_name, '[' || n_name || '].[key]::[' || next_name || '].[key]' AS property_value, 'Full' AS supported_in_ts,
         CASE k WHEN 'inner' THEN 'INNER' WHEN 'left' THEN 'LEFT_OUTER' WHEN 'right' THEN 'RIGHT_OUTER' ELSE 'OUTER' END AS conversion_in_ts
  FROM (SELECT *, ['inner', 'left', 'right', 'full'][n_nationkey % 4 + 1] AS k,
               lead(n_name) OVER (PARTITION BY r_name ORDER BY n_nationkey) AS next_name FROM nat) WHERE next_name IS NOT NULL
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'datasource property' AS object_type, n_name AS datasource_name, 'Filter_' || CAST(d AS VARCHAR) AS property_type,
         'class' AS property_name, cls AS property_value, CASE WHEN cls = 'relative-date' THEN 'NoSup' ELSE 'Full' END AS supported_in_ts
  FROM (SELECT *, ['categorical', 'quantitative', 'relative-date'][(n_nationkey + d) % 3 + 1] AS cls FROM
         (SELECT DISTINCT r_name, twb_file_name, n_name, n_nationkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS d FROM occn))
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'table' AS object_type, n_name AS datasource_name, '[DB].[' || r_name || '].[' || n_name || ']' AS table_name,
         'connection tag' AS property_type, '<connection class="' || lower(connector) || '"/>' AS property_value,
         'table tml' AS output_file_type, lower(n_name) || '.table.tml' AS output_file_name,
         CASE WHEN ds_type = 'Extract' THEN '@EXTRACT@' ELSE '@TABLE@' END AS conversion_in_ts
  FROM nat
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'custom sql query' AS object_type, n_name AS datasource_name, 'Custom_SQL_' || n_name AS table_name,
         'text' AS property_type, 'query' AS property_name, 'SELECT * FROM ' || n_name AS property_value,
         'sql view tml' AS output_file_type, lower(n_name) || '_custom.sql.tml' AS output_file_name, '@TABLE@' AS conversion_in_ts
  FROM nat WHERE n_nationkey % 5 = 0
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'custom sql query' AS object_type, n_name AS datasource_name, 'Custom_SQL_' || n_name AS table_name,
         'connection tag' AS property_type, '<connection class="' || lower(connector) || '"/>' AS property_value
  FROM nat WHERE n_nationkey % 5 = 0
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'column' AS object_type, n_name AS datasource_name, n_name AS table_name, upper(s_name) AS remote_column_name,
         s_name AS local_column_name, 'metadata-record' AS property_type, 'data type' AS property_name, ty AS property_value,
         'Full' AS supported_in_ts,
         CASE ty WHEN 'integer' THEN 'INT64' WHEN 'real' THEN 'DOUBLE' WHEN 'string' THEN 'VARCHAR' ELSE 'DATE' END AS conversion_in_ts
  FROM (SELECT *, ['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1] AS ty FROM supplier JOIN nat ON s_nationkey = n_nationkey)
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, 'column' AS object_type, n_name AS datasource_name, 'calculated_column' AS property_type,
         'Calculation_' || CAST(n_nationkey AS VARCHAR) || '_' || substr(c_mktsegment, 1, 3) AS property_name, formula AS property_value,
         v AS supported_in_ts, CASE v WHEN 'Partial' THEN 'TBD' WHEN 'NoSup' THEN 'error' ELSE lower(formula) END AS conversion_in_ts
  FROM (SELECT *, CASE WHEN contains(formula, 'TOTAL(') THEN 'Partial' WHEN contains(formula, 'LOOKUP(') THEN 'NoSup' ELSE 'Full' END AS v FROM calc)
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, worksheet_name, 'chart' AS object_type, 'chart type' AS property_type, 'mark' AS property_name,
         mark AS property_value,
         CASE mark WHEN 'Bar' THEN 'Full' WHEN 'Line' THEN 'Full' WHEN 'Text' THEN 'NoSup' WHEN 'Circle' THEN 'Partial' ELSE 'Default' END AS supported_in_ts,
         CASE mark WHEN 'Bar' THEN 'Use bar or column chart.' WHEN 'Line' THEN 'Use line chart.'
                   WHEN 'Text' THEN 'No equivalent chart type supported.' WHEN 'Circle' THEN 'Use scatter chart.'
                   ELSE 'No suggestion as mark type is not known.' END AS conversion_in_ts
  FROM ws
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, worksheet_name, first_ds AS datasource_name, 'chart property' AS object_type, p.pt AS property_type,
         p.pn AS property_name, p.pv AS property_value, p.sup AS supported_in_ts, p.hint AS conversion_in_ts
  FROM ws, (VALUES
     ('encoding', 'color', '[ds].[none:C_MKTSEGMENT:nk]', 'Full', 'Include color field in search and slice with color using this field.'),
     ('encoding', 'size', '[ds].[sum:C_ACCTBAL:qk]', 'NoSup', 'Size feature is not supported.'),
     ('axis', 'rows', '[ds].[none:N_NAME:nk]', 'Partial', 'Check the chart type'),
     ('axis', 'cols', '[ds].[sum:C_ACCTBAL:qk]', 'Partial', 'Check the chart type'),
     ('Filter_1', 'class', 'categorical', 'Full', 'Use INCLUDE filter')) AS p(pt, pn, pv, sup, hint)
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, worksheet_name, first_ds AS datasource_name, 'chart property' AS object_type, 'datasource' AS property_type,
         'name' AS property_name, first_ds AS property_value
  FROM ws
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, dashboard_name, 'dashboard' AS object_type, 'style' AS property_type, 'layout' AS property_name,
         'fixed' AS property_value, 'NoSup' AS supported_in_ts
  FROM (SELECT DISTINCT r_name, twb_file_name, r_name || '_' || o_orderstatus AS dashboard_name FROM occn)
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, dashboard_name, 'dashboard property' AS object_type, 'filter' AS property_type,
         'dashboard filter' AS property_name, 'Filter_1' AS property_value, 'Full' AS supported_in_ts
  FROM (SELECT DISTINCT r_name, twb_file_name, r_name || '_' || o_orderstatus AS dashboard_name FROM occn)
  UNION ALL BY NAME
  SELECT r_name, twb_file_name, dashboard_name, worksheet_name, 'dashboard property' AS object_type, 'zone-style' AS property_type,
         'height' AS property_name, '100' AS property_value, 'Default' AS supported_in_ts
  FROM (SELECT DISTINCT r_name, twb_file_name, r_name || '_' || o_orderstatus AS dashboard_name, r_name || '_' || c_mktsegment AS worksheet_name
        FROM occn WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
  UNION ALL BY NAME
  SELECT DISTINCT r_name, r_name || '.twb' AS twb_file_name, 'error' AS object_type,
         'parse error in ' || p_name || ' #' || CAST(p_partkey AS VARCHAR) AS exec_error_details
  FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE p_size = 1),
runs AS (
  SELECT base.*, md5('run1') AS exec_id, 'feasibility' AS exec_mode, TIMESTAMP '2024-01-01 10:00:00' AS exec_start_time,
         TIMESTAMP '2024-01-01 10:05:30' AS exec_end_time FROM base
  UNION ALL
  SELECT base.*, md5('run2'), 'convert', TIMESTAMP '2024-01-02 09:00:00', TIMESTAMP '2024-01-02 09:01:10' FROM base WHERE r_name LIKE 'A%'),
raw_data_dump AS (
  SELECT twb_file_name, object_type, datasource_name, table_name, remote_column_name, local_column_name, worksheet_name, dashboard_name,
         property_type, property_name, property_value, CAST(NULL AS VARCHAR) AS proposed_value, conversion_in_ts, supported_in_ts,
         CAST(NULL AS VARCHAR) AS supported_in_migrator, exec_error_details, exec_mode, 'Success' AS exec_status, exec_start_time,
         exec_end_time, exec_end_time AS last_ingested_date, exec_id, output_file_type, output_file_name
  FROM runs)
"""

DUMP_CTES = DUMP_CTES.replace("@EXTRACT@", TARGET_EXTRACT).replace("@TABLE@", TARGET_TABLE)

WAREHOUSE_CTES = r"""
meh AS (SELECT DISTINCT exec_id, exec_mode, exec_start_time, exec_end_time, exec_status, twb_file_name, CAST(NULL AS VARCHAR) AS exec_error_details
        FROM raw_data_dump WHERE exec_mode IS NOT NULL),
twbf AS (SELECT DISTINCT md5(coalesce(h.exec_id, '') || coalesce(h.twb_file_name, '')) AS twb_file_id, h.exec_id, h.twb_file_name
         FROM (SELECT DISTINCT exec_id, twb_file_name FROM meh) h JOIN (SELECT DISTINCT exec_id, twb_file_name FROM raw_data_dump) d
         ON h.exec_id = d.exec_id AND h.twb_file_name = d.twb_file_name),
dumpf AS (SELECT d.*, f.twb_file_id FROM raw_data_dump d JOIN twbf f ON d.exec_id = f.exec_id AND d.twb_file_name = f.twb_file_name),
dsh AS (SELECT DISTINCT md5(coalesce(exec_id, '') || coalesce(twb_file_id, '') || coalesce(datasource_name, '')) AS datasource_header_id,
               exec_id, twb_file_id, datasource_name, output_file_type, output_file_name
        FROM dumpf WHERE object_type = 'datasource property' AND property_name = 'connection'),
wsh AS (SELECT DISTINCT md5(coalesce(exec_id, '') || coalesce(twb_file_id, '') || coalesce(worksheet_name, '')) AS worksheet_header_id,
               exec_id, twb_file_id, worksheet_name FROM dumpf WHERE object_type = 'chart'),
dbh AS (SELECT DISTINCT md5(coalesce(exec_id, '') || coalesce(twb_file_id, '') || coalesce(dashboard_name, '')) AS dashboard_header_id,
               exec_id, twb_file_id, dashboard_name FROM dumpf WHERE object_type = 'dashboard' AND dashboard_name IS NOT NULL),
th AS (
  SELECT DISTINCT md5(coalesce(exec_id, '') || coalesce(replace(replace(table_name, '#', '.'), '$', ''), '') || coalesce(property_value, '')) AS table_header_id,
         exec_id, replace(replace(table_name, '#', '.'), '$', '') AS table_name, property_value AS connection_tag, 'table' AS type
  FROM dumpf WHERE object_type = 'table' AND table_name IS NOT NULL
  UNION
  SELECT DISTINCT md5(coalesce(exec_id, '') || coalesce(table_name, '') || coalesce(property_value, '')), exec_id, table_name, property_value, 'custom sql query'
  FROM raw_data_dump WHERE object_type = 'custom sql query' AND property_type = 'connection tag'),
med AS (SELECT md5(coalesce(exec_id, '') || coalesce(twb_file_id, '') || coalesce(exec_error_details, '')) AS exec_detail_id, exec_id, twb_file_id,
               exec_status, exec_error_details FROM dumpf WHERE exec_error_details IS NOT NULL),
dsd AS (SELECT md5(coalesce(h.datasource_header_id, '') || coalesce(d.property_value, '')) AS datasource_detail_id, h.datasource_header_id,
               d.property_type, d.property_name, d.property_value, coalesce(d.supported_in_ts, '  ') AS conv_feasibility,
               coalesce(d.conversion_in_ts, ' ') AS ts_equivalent_hint, ' ' AS migration_status
        FROM dumpf d JOIN dsh h ON d.exec_id = h.exec_id AND d.twb_file_id = h.twb_file_id AND d.datasource_name = h.datasource_name
        WHERE d.object_type = 'datasource property' OR (d.object_type = 'column' AND d.property_type = 'calculated_column')),
wsd AS (SELECT md5(coalesce(h.worksheet_header_id, '') || coalesce(d.property_value, '')) AS worksheet_detail_id, h.worksheet_header_id,
               d.property_type, d.property_name, d.property_value, coalesce(d.supported_in_ts, ' ') AS conv_feasibility,
               coalesce(d.conversion_in_ts, ' ') AS ts_equivalent_hint
        FROM dumpf d JOIN wsh h ON d.exec_id = h.exec_id AND d.twb_file_id = h.twb_file_id AND d.worksheet_name = h.worksheet_name
        WHERE d.worksheet_name IS NOT NULL AND d.object_type IN ('chart', 'chart property') AND d.property_value IS NOT NULL),
dbd AS (SELECT md5(coalesce(h.dashboard_header_id, '') || coalesce(w.worksheet_header_id, '') || coalesce(d.property_value, '')) AS dashboard_detail_id,
               h.dashboard_header_id, w.worksheet_header_id, d.property_type, d.property_name, d.property_value,
               coalesce(d.supported_in_ts, ' ') AS conv_feasibility, coalesce(d.conversion_in_ts, ' ') AS ts_equivalent_hint
        FROM dumpf d JOIN dbh h ON d.exec_id = h.exec_id AND d.twb_file_id = h.twb_file_id AND d.dashboard_name = h.dashboard_name
        LEFT JOIN wsh w ON d.exec_id = w.exec_id AND d.twb_file_id = w.twb_file_id AND d.worksheet_name = w.worksheet_name
        WHERE d.object_type IN ('dashboard', 'dashboard property') AND d.property_value IS NOT NULL),
td AS (SELECT DISTINCT md5(coalesce(h.table_header_id, '') || coalesce(d.local_column_name, '')) AS table_detail_id, h.table_header_id,
               d.local_column_name AS column_name, d.property_value AS data_type, d.supported_in_ts AS conv_feasibility,
               d.conversion_in_ts AS ts_data_type, '' AS migration_status
       FROM (SELECT table_header_id, exec_id,
                    CASE WHEN table_name LIKE '[%].[%].[%]' THEN substr(split_part(table_name, '.', 3), 2, length(split_part(table_name, '.', 3)) - 2)
                         WHEN table_name LIKE '[%' THEN substr(table_name, 2, length(table_name) - 2) ELSE table_name END AS short_name
             FROM th WHERE type = 'table') h
       JOIN raw_data_dump d ON d.exec_id = h.exec_id AND d.table_name = h.short_name
       WHERE d.object_type = 'column' AND d.property_type = 'metadata-record'),
dtx AS (SELECT DISTINCT md5(coalesce(h.datasource_header_id, '') || coalesce(t.table_header_id, '')) AS datasource_table_xref_id,
               h.datasource_header_id, t.table_header_id
        FROM dsh h JOIN (SELECT DISTINCT exec_id, datasource_name, replace(replace(table_name, '#', '.'), '$', '') AS table_name
                         FROM raw_data_dump WHERE object_type IN ('table', 'custom sql query')) d
             ON h.exec_id = d.exec_id AND h.datasource_name = d.datasource_name
        JOIN th t ON t.exec_id = d.exec_id AND t.table_name = d.table_name),
dcx AS (SELECT DISTINCT md5(coalesce(h.datasource_header_id, '') || coalesce(x.table_detail_id, '')) AS datasource_column_xref_id,
               h.datasource_header_id, x.table_detail_id
        FROM (SELECT td.table_detail_id, th.table_header_id, th.exec_id, th.table_name FROM td JOIN th USING (table_header_id)) x
        JOIN (SELECT DISTINCT exec_id, replace(replace(table_name, '#', '.'), '$', '') AS table_name, datasource_name
              FROM raw_data_dump WHERE table_name IS NOT NULL) d ON d.exec_id = x.exec_id AND d.table_name = x.table_name
        JOIN dsh h ON h.exec_id = d.exec_id AND h.datasource_name = d.datasource_name),
wdx AS (SELECT md5(coalesce(w.dsid, '') || coalesce(w.worksheet_header_id, '')) AS worksheet_datasource_xref_id, w.dsid AS datasource_header_id,
               w.worksheet_header_id, w.twb_file_id, w.worksheet_name
        FROM (SELECT wsh.*, md5(coalesce(wsh.exec_id, '') || coalesce(wsh.twb_file_id, '') || coalesce(wsd.property_value, '')) AS dsid
              FROM wsd JOIN wsh USING (worksheet_header_id) WHERE wsd.property_type = 'datasource') w
        JOIN dsh h ON h.datasource_header_id = w.dsid),
tof AS (SELECT md5(coalesce(t.table_header_id, '') || coalesce(d.output_file_type, '') || coalesce(d.output_file_name, '')) AS table_output_file_id,
               t.table_header_id, d.output_file_type, d.output_file_name, d.conversion_in_ts
        FROM (SELECT exec_id, replace(replace(table_name, '#', '.'), '$', '') AS table_name, conversion_in_ts, output_file_type, output_file_name
              FROM raw_data_dump WHERE object_type = 'table' OR (object_type = 'custom sql query' AND property_type = 'text')) d
        LEFT JOIN th t ON t.exec_id = d.exec_id AND t.table_name = d.table_name),
wnd AS (SELECT exec_id, twb_file_id, worksheet_header_id FROM wsh
        EXCEPT SELECT h.exec_id, h.twb_file_id, d.worksheet_header_id FROM dbd d JOIN dbh h USING (dashboard_header_id)),
dnw AS (SELECT exec_id, twb_file_id, datasource_header_id FROM dsh
        EXCEPT SELECT w.exec_id, w.twb_file_id, x.datasource_header_id FROM wdx x LEFT JOIN wsh w USING (worksheet_header_id)),
tun AS (SELECT DISTINCT b.datasource_header_id, b.table_header_id, b.exec_id, b.table_name, b.class_value, d.property_name, d.property_value,
               d.conv_feasibility
        FROM (SELECT x.datasource_header_id, t.exec_id, t.table_header_id, t.table_name,
                     regexp_extract(t.connection_tag, 'class="([^"]+)"', 1) AS class_value
              FROM dtx x LEFT JOIN th t USING (table_header_id)) b
        JOIN dsd d ON d.datasource_header_id = b.datasource_header_id
        WHERE d.property_name = 'connector' AND d.conv_feasibility <> 'Full')
"""

# warehouse table name -> CTE name
WH_CTE = {
    "migration_execution_header": "meh",
    "twb_file": "twbf",
    "datasource_header": "dsh",
    "worksheet_header": "wsh",
    "dashboard_header": "dbh",
    "table_header": "th",
    "migration_execution_detail": "med",
    "datasource_detail": "dsd",
    "worksheet_detail": "wsd",
    "dashboard_detail": "dbd",
    "table_detail": "td",
    "datasource_table_xref": "dtx",
    "datasource_column_xref": "dcx",
    "worksheet_datasource_xref": "wdx",
    "table_output_file": "tof",
    "worksheet_header2": "wsh",
    "stg_worksheet_not_in_dashboard": "wnd",
    "stg_datasource_not_in_worksheet": "dnw",
    "stg_tables_connected_with_unsupported_data_platform": "tun",
}


def with_warehouse(select_sql: str) -> str:
    return f"WITH {DUMP_CTES.strip()},\n{WAREHOUSE_CTES.strip()}\n{select_sql}"
