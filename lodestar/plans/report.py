"""Report tiles (R01 … R77) over the warehouse model (J-15, N01 … N05, FX-13 … FX-15).

The report model joins the warehouse tables; each tile uses only the tables
its columns need (``join_progressive``): model views below are those pruned
join paths.  A tile is: model view -> parameter filter on the run
(``exec_id``, FX-13) -> optional chips (FX-14/15) -> tile filters -> keys and
measures -> optional sort.  Measures are written as SQL expressions, which
Spark evaluates with ``F.expr`` on the DataFrame (JVM-side, codegen) and the
oracle runs in DuckDB unchanged.

Kinds: KPI (global aggregate), COLUMN (group + sort by measure),
PIE (group + share of total, G-06), SANKEY (edge counts), DETAIL (distinct
rows), LOD (group_aggregate at query grain + extra dims, LOD-05/LOD-08).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import grouping as G

RUN1 = "md5('run1')"  # parameter value of the report (Execution_ID)
CHOSEN_WORKBOOKS = ("AFRICA.twb", "ASIA.twb", "EUROPE.twb")  # author-chosen list (FX-15)

# N03 / N04 / N05 report formulas over the datasource view
N03 = "CASE WHEN ds_prop_type = 'ds_type' THEN 'datasource_type' ELSE ds_prop_type END"
N04 = (
    "CASE WHEN ds_prop_type = 'calculated_column' THEN CASE WHEN lower(ds_hint) = 'tbd' THEN 'partial' "
    "WHEN lower(ds_hint) = 'error' THEN 'not supported' ELSE 'full' END ELSE lower(ds_conv) END"
)
N05 = f"CASE WHEN ({N04}) = 'full' THEN ds_hint ELSE ' ' END"


def model_views(w: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The pruned join paths of the report model, one per tile family."""
    f = w["twb_file"].select("twb_file_id", "exec_id", "twb_file_name")
    dash = (
        f.join(w["dashboard_header"].select("dashboard_header_id", "twb_file_id", "dashboard_name"), "twb_file_id")
        .join(
            w["dashboard_detail"].select(
                "dashboard_header_id",
                "dashboard_detail_id",
                "worksheet_header_id",
                F.col("property_type").alias("dash_prop_type"),
                F.col("property_name").alias("dash_prop_name"),
                F.col("property_value").alias("dash_prop_value"),
                F.col("conv_feasibility").alias("dash_conv"),
            ),
            "dashboard_header_id",
            "left",
        )
        .join(w["worksheet_header"].select("worksheet_header_id", "worksheet_name"), "worksheet_header_id", "left")
    )
    ws = f.join(w["worksheet_header"].select("worksheet_header_id", "twb_file_id", "worksheet_name"), "twb_file_id").join(
        w["worksheet_detail"].select(
            "worksheet_header_id",
            "worksheet_detail_id",
            F.col("property_type").alias("ws_prop_type"),
            F.col("property_name").alias("ws_prop_name"),
            F.col("property_value").alias("ws_prop_value"),
            F.col("conv_feasibility").alias("ws_conv"),
            F.col("ts_equivalent_hint").alias("ws_hint"),
        ),
        "worksheet_header_id",
        "left",
    )
    dsh = w["datasource_header"].select("datasource_header_id", "twb_file_id", "datasource_name", "output_file_name", "output_file_type")
    ds = f.join(dsh, "twb_file_id").join(
        w["datasource_detail"].select(
            "datasource_header_id",
            "datasource_detail_id",
            F.col("property_type").alias("ds_prop_type"),
            F.col("property_name").alias("ds_prop_name"),
            F.col("property_value").alias("ds_prop_value"),
            F.col("conv_feasibility").alias("ds_conv"),
            F.col("ts_equivalent_hint").alias("ds_hint"),
        ),
        "datasource_header_id",
        "left",
    )
    tbl = (
        f.join(dsh.select("datasource_header_id", "twb_file_id", "datasource_name"), "twb_file_id")
        .join(w["datasource_table_xref"].select("datasource_header_id", "table_header_id"), "datasource_header_id")
        .join(w["table_header"].select("table_header_id", "table_name"), "table_header_id")
    )
    tcol = tbl.join(w["table_detail"].select("table_header_id", "table_detail_id", "column_name", "data_type"), "table_header_id", "left")
    tout = tbl.join(
        w["table_output_file"].select(
            "table_header_id", F.col("output_file_name").alias("tbl_out_name"), F.col("output_file_type").alias("tbl_out_type"), F.col("conversion_in_ts").alias("tbl_conv")
        ),
        "table_header_id",
        "left",
    )
    wsds = (
        w["worksheet_datasource_xref"]
        .select("datasource_header_id", "twb_file_id", "worksheet_header_id", "worksheet_name")
        .join(dsh.select("datasource_header_id", "twb_file_id", "datasource_name"), ["datasource_header_id", "twb_file_id"])
        .join(f, "twb_file_id")
    )
    run = w["migration_execution_header"].select("exec_id", "exec_mode", "exec_status", "exec_start_time", "exec_end_time", "twb_file_name")
    err = w["migration_execution_detail"].select("exec_id", "twb_file_id", "exec_error_details").join(f.select("twb_file_id", "twb_file_name"), "twb_file_id")
    unsup = w["stg_tables_connected_with_unsupported_data_platform"].select("exec_id", "table_header_id", "table_name")
    dnw = w["stg_datasource_not_in_worksheet"].select("exec_id", "twb_file_id", "datasource_header_id")
    wnd = w["stg_worksheet_not_in_dashboard"].select("exec_id", "twb_file_id", "worksheet_header_id")
    wsall = f.join(w["worksheet_header"].select("worksheet_header_id", "twb_file_id"), "twb_file_id")
    return {"dash": dash, "ws": ws, "ds": ds, "tbl": tbl, "tcol": tcol, "tout": tout, "wsds": wsds, "run": run, "err": err, "unsup": unsup, "dnw": dnw, "wnd": wnd, "wsall": wsall}


MODEL_SQL = r"""
v_dash AS (SELECT f.twb_file_id, f.exec_id, f.twb_file_name, h.dashboard_header_id, h.dashboard_name, d.dashboard_detail_id, d.worksheet_header_id,
                  d.property_type AS dash_prop_type, d.property_name AS dash_prop_name, d.property_value AS dash_prop_value,
                  d.conv_feasibility AS dash_conv, w.worksheet_name
           FROM twbf f JOIN dbh h ON f.twb_file_id = h.twb_file_id LEFT JOIN dbd d ON d.dashboard_header_id = h.dashboard_header_id
           LEFT JOIN wsh w ON w.worksheet_header_id = d.worksheet_header_id),
v_ws AS (SELECT f.twb_file_id, f.exec_id, f.twb_file_name, h.worksheet_header_id, h.worksheet_name, d.worksheet_detail_id,
                d.property_type AS ws_prop_type, d.property_name AS ws_prop_name, d.property_value AS ws_prop_value,
                d.conv_feasibility AS ws_conv, d.ts_equivalent_hint AS ws_hint
         FROM twbf f JOIN wsh h ON f.twb_file_id = h.twb_file_id LEFT JOIN wsd d ON d.worksheet_header_id = h.worksheet_header_id),
v_ds AS (SELECT f.twb_file_id, f.exec_id, f.twb_file_name, h.datasource_header_id, h.datasource_name, h.output_file_name, h.output_file_type,
                d.datasource_detail_id, d.property_type AS ds_prop_type, d.property_name AS ds_prop_name, d.property_value AS ds_prop_value,
                d.conv_feasibility AS ds_conv, d.ts_equivalent_hint AS ds_hint
         FROM twbf f JOIN dsh h ON f.twb_file_id = h.twb_file_id LEFT JOIN dsd d ON d.datasource_header_id = h.datasource_header_id),
v_tbl AS (SELECT f.twb_file_id, f.exec_id, f.twb_file_name, h.datasource_header_id, h.datasource_name, t.table_header_id, t.table_name
          FROM twbf f JOIN dsh h ON f.twb_file_id = h.twb_file_id JOIN dtx x ON x.datasource_header_id = h.datasource_header_id
          JOIN th t ON t.table_header_id = x.table_header_id),
v_tcol AS (SELECT v.*, d.table_detail_id, d.column_name, d.data_type FROM v_tbl v LEFT JOIN td d ON d.table_header_id = v.table_header_id),
v_tout AS (SELECT v.*, o.output_file_name AS tbl_out_name, o.output_file_type AS tbl_out_type, o.conversion_in_ts AS tbl_conv
           FROM v_tbl v LEFT JOIN tof o ON o.table_header_id = v.table_header_id),
v_wsds AS (SELECT x.twb_file_id, x.datasource_header_id, x.worksheet_header_id, x.worksheet_name, h.datasource_name, f.exec_id, f.twb_file_name
           FROM wdx x JOIN dsh h ON x.datasource_header_id = h.datasource_header_id AND x.twb_file_id = h.twb_file_id
           JOIN twbf f ON f.twb_file_id = x.twb_file_id),
v_run AS (SELECT exec_id, exec_mode, exec_status, exec_start_time, exec_end_time, twb_file_name FROM meh),
v_err AS (SELECT m.exec_id, m.twb_file_id, m.exec_error_details, f.twb_file_name FROM med m JOIN twbf f ON m.twb_file_id = f.twb_file_id),
v_unsup AS (SELECT exec_id, table_header_id, table_name FROM tun),
v_dnw AS (SELECT exec_id, twb_file_id, datasource_header_id FROM dnw),
v_wnd AS (SELECT exec_id, twb_file_id, worksheet_header_id FROM wnd),
v_wsall AS (SELECT f.twb_file_id, f.exec_id, f.twb_file_name, h.worksheet_header_id FROM twbf f JOIN wsh h ON f.twb_file_id = h.twb_file_id)
"""


@dataclass
class Tile:
    rid: str
    slug: str
    view: str
    kind: str  # KPI | COLUMN | PIE | SANKEY | DETAIL | LOD
    keys: list = field(default_factory=list)
    measures: list = field(default_factory=list)  # [(alias, sql aggregate expression)]
    filters: list = field(default_factory=list)  # [sql predicate]
    chosen: bool = False  # author-chosen workbook list
    derived: dict = field(default_factory=dict)  # alias -> sql row expression added before filtering
    extra: list = field(default_factory=list)  # LOD: extra grain columns
    lod_outer: str = "sum"
    sql_overrides: dict = field(default_factory=dict)  # alias -> DuckDB spelling where dialects differ


def _filtered(views: dict[str, DataFrame], tile: Tile, exec_id_sql: str) -> DataFrame:
    df = views[tile.view]
    for name, expr in tile.derived.items():
        df = df.withColumn(name, F.expr(expr))
    df = df.filter(F.expr(f"exec_id = {exec_id_sql}"))  # FX-13 parameter filter
    if tile.chosen:
        df = df.filter(F.col("twb_file_name").isin(list(CHOSEN_WORKBOOKS)))  # FX-15
    for p in tile.filters:
        df = df.filter(F.expr(p))
    return df


def run_tile(views: dict[str, DataFrame], tile: Tile, exec_id_sql: str = RUN1) -> DataFrame:
    df = _filtered(views, tile, exec_id_sql)
    aggs = [F.expr(e).alias(a) for a, e in tile.measures]
    if tile.kind == "KPI":
        return df.agg(*aggs)
    if tile.kind == "DETAIL":
        return df.select(*[F.expr(k).alias(k) if k in tile.derived else F.col(k) for k in tile.keys]).distinct()
    if tile.kind == "LOD":
        fine = df.groupBy(*tile.keys, *tile.extra).agg(*aggs)
        outer = [getattr(F, tile.lod_outer)(F.col(a)).alias(a) for a, _ in tile.measures]
        return (fine.groupBy(*tile.keys).agg(*outer) if tile.keys else fine.agg(*outer)).select(
            *tile.keys, *[F.col(a).cast("bigint").alias(a) for a, _ in tile.measures]
        )
    out = df.groupBy(*tile.keys).agg(*aggs)
    if tile.kind == "PIE":
        first = tile.measures[0][0]
        out = G.share_of_total(out, first, "share").withColumn("share", F.round("share", 6))
    if tile.kind in ("COLUMN", "SANKEY"):
        out = out.orderBy(F.col(tile.measures[0][0]).desc(), *tile.keys)
    return out


def tile_sql(tile: Tile, exec_id_sql: str = RUN1) -> str:
    src = f"v_{tile.view}"
    ov = tile.sql_overrides
    derived = "".join(f", {ov.get(a, e)} AS {a}" for a, e in tile.derived.items())
    preds = [f"exec_id = {exec_id_sql}"]
    if tile.chosen:
        preds.append("twb_file_name IN (" + ", ".join(f"'{w}'" for w in CHOSEN_WORKBOOKS) + ")")
    preds += [f"({p})" for p in tile.filters]
    base = f"(SELECT * FROM (SELECT *{derived} FROM {src}) WHERE {' AND '.join(preds)})"
    meas = ", ".join(f"{ov.get(a, e)} AS {a}" for a, e in tile.measures)
    keys = ", ".join(tile.keys)
    if tile.kind == "KPI":
        return f"SELECT {meas} FROM {base}"
    if tile.kind == "DETAIL":
        return f"SELECT DISTINCT {keys} FROM {base}"
    if tile.kind == "LOD":
        inner_keys = ", ".join(tile.keys + tile.extra)
        outer = ", ".join(f"CAST({tile.lod_outer}({a}) AS BIGINT) AS {a}" for a, _ in tile.measures)
        grp = f" GROUP BY {keys}" if tile.keys else ""
        sel_keys = f"{keys}, " if tile.keys else ""
        return f"SELECT {sel_keys}{outer} FROM (SELECT {inner_keys}, {meas} FROM {base} GROUP BY {inner_keys}){grp}"
    sql = f"SELECT {keys}, {meas} FROM {base} GROUP BY {keys}"
    if tile.kind == "PIE":
        first = tile.measures[0][0]
        sql = f"SELECT *, round({first} / sum({first}) OVER (), 6) AS share FROM ({sql})"
    return sql


def _cnt(x):
    return f"count({x})"


def _cd(x):
    return f"count(DISTINCT {x})"


TILES = [
    Tile("r01", "total_twb_files", "wsall", "KPI", measures=[("twb_files", _cd("twb_file_name"))]),
    Tile("r02", "execution_mode", "run", "DETAIL", keys=["exec_mode"]),
    Tile("r04", "total_workbooks", "ds", "KPI", measures=[("workbooks", _cd("twb_file_name"))]),
    Tile("r05", "dashboards_per_workbook", "dash", "COLUMN", keys=["twb_file_name"], measures=[("dashboards", _cd("dashboard_name"))]),
    Tile("r06", "total_dashboard_filters", "dash", "KPI", measures=[("filters", _cnt("dash_prop_value"))], filters=["dash_prop_name IN ('dashboard filter')"]),
    Tile("r07", "dashboards_per_workbook_by_name", "dash", "COLUMN", keys=["twb_file_name"], measures=[("dashboards", _cd("dashboard_name"))]),
    Tile("r08", "dashboard_property_feasibility_share", "dash", "PIE", keys=["dash_conv"], measures=[("n", _cnt("dash_conv"))], filters=["dashboard_name IS NOT NULL"]),
    Tile("r09", "worksheets_per_dashboard", "dash", "COLUMN", keys=["dashboard_name"], measures=[("worksheets", _cd("worksheet_name"))]),
    Tile("r10", "worksheet_to_dashboard", "dash", "SANKEY", keys=["worksheet_name", "dashboard_name"], measures=[("n", _cnt("worksheet_name"))], filters=["worksheet_name IS NOT NULL"]),
    Tile(
        "r11",
        "dashboard_properties",
        "dash",
        "DETAIL",
        keys=["dashboard_name", "dash_prop_type", "dash_prop_name", "dash_prop_value", "twb_file_name", "dashboard_detail_id", "dash_conv", "worksheet_name"],
    ),
    Tile(
        "r12",
        "total_dimensions",
        "ws",
        "KPI",
        measures=[("dimensions", "count(CASE WHEN contains(lower(ws_prop_value), 'none') THEN 1 END)")],
        filters=["ws_prop_type IN ('axis', 'encoding')"],
    ),
    Tile(
        "r13",
        "total_measures",
        "ws",
        "KPI",
        measures=[("measures", "count(CASE WHEN NOT contains(lower(ws_prop_value), 'none') THEN 1 END)")],
        filters=["ws_prop_type IN ('axis', 'encoding')"],
    ),
    Tile(
        "r14",
        "calculated_fields_in_worksheets",
        "ws",
        "KPI",
        measures=[("calc_fields", "count(concat(worksheet_name, ws_prop_type, ws_prop_name, ws_prop_value))")],
        filters=["ws_prop_type IN ('axis', 'encoding')", "contains(lower(ws_prop_value), 'calculation')"],
    ),
    Tile("r15", "total_worksheet_filters", "ws", "KPI", measures=[("filters", _cnt("ws_prop_value"))], filters=["ws_prop_name IN ('class')"]),
    Tile(
        "r16",
        "convertible_worksheet_filters",
        "ws",
        "KPI",
        measures=[("filters", _cnt("ws_prop_value"))],
        filters=["ws_prop_type <> 'datasource'", "ws_prop_name = 'class'", "lower(ws_conv) IN ('full')"],
    ),
    Tile("r17", "worksheet_properties_analysed", "ws", "KPI", measures=[("properties", _cnt("ws_prop_value"))], filters=["ws_prop_type <> 'datasource'"]),
    Tile("r18", "mark_types", "ws", "COLUMN", keys=["ws_prop_value"], measures=[("n", _cnt("ws_prop_value"))], filters=["ws_prop_name IN ('mark')"]),
    Tile("r19", "worksheet_property_feasibility_share", "ws", "PIE", keys=["ws_conv"], measures=[("n", _cnt("ws_conv"))], filters=["ws_prop_type <> 'datasource'"]),
    Tile("r20", "filter_types", "ws", "COLUMN", keys=["ws_prop_value"], measures=[("n", _cnt("ws_prop_value"))], filters=["ws_prop_name IN ('class')"]),
    Tile(
        "r21",
        "datasource_to_worksheet",
        "wsds",
        "SANKEY",
        keys=["datasource_name", "worksheet_name"],
        measures=[("n", "count(CASE WHEN datasource_name IS NOT NULL THEN worksheet_name END)")],
    ),
    Tile("r22", "worksheets_per_datasource", "wsds", "COLUMN", keys=["datasource_name"], measures=[("worksheets", _cnt("worksheet_name"))]),
    Tile("r23", "worksheet_details", "ws", "DETAIL", keys=["worksheet_name", "ws_prop_type", "ws_prop_name", "ws_prop_value", "twb_file_name", "ws_conv", "ws_hint"], filters=["ws_prop_type <> 'datasource'", "worksheet_name IS NOT NULL"]),
    Tile("r24", "total_datasource_filters", "ds", "KPI", measures=[("filters", _cd("concat(twb_file_name, datasource_name, ds_prop_type, ds_prop_name)"))], filters=["ds_prop_name IN ('class')"]),
    Tile("r25", "total_joins", "ds", "KPI", measures=[("joins", _cd("concat(twb_file_name, datasource_name, ds_prop_name, ds_prop_value)"))], filters=["ds_prop_type IN ('join')"]),
    Tile("r26", "unique_data_platforms", "ds", "KPI", measures=[("platforms", _cd("ds_prop_value"))], filters=["ds_prop_name IN ('connector')"]),
    Tile("r27", "total_calculated_columns", "ds", "KPI", measures=[("calc_columns", _cnt("ds_prop_value"))], filters=["ds_prop_type IN ('calculated_column')"]),
    Tile("r28", "datasource_types", "ds", "PIE", keys=["ds_prop_value"], measures=[("n", _cnt("datasource_name"))], filters=["ds_prop_type IN ('ds_type')"]),
    Tile("r29", "datasource_filter_types", "ds", "PIE", keys=["ds_prop_value"], measures=[("n", _cnt("ds_prop_value"))], filters=["ds_prop_name IN ('class')"]),
    Tile("r30", "filters_per_datasource", "ds", "COLUMN", keys=["datasource_name"], measures=[("filters", _cnt("ds_prop_value"))], filters=["ds_prop_name IN ('class')"]),
    Tile("r31", "calculated_columns_per_datasource", "ds", "COLUMN", keys=["datasource_name"], measures=[("calc_columns", _cd("ds_prop_value"))], filters=["ds_prop_type IN ('calculated_column')"]),
    Tile("r32", "platform_per_datasource", "ds", "SANKEY", keys=["datasource_name", "ds_prop_value"], measures=[("n", _cnt("ds_prop_value"))], filters=["ds_prop_name IN ('connector')"]),
    Tile("r33", "joins_per_datasource", "ds", "COLUMN", keys=["datasource_name"], measures=[("joins", _cnt("ds_prop_value"))], filters=["ds_prop_type IN ('join')"]),
    Tile("r34", "join_types", "ds", "PIE", keys=["ds_prop_name"], measures=[("n", _cnt("ds_prop_name"))], filters=["ds_prop_type IN ('join')"]),
    Tile("r35", "worksheets_linked_per_datasource", "wsds", "COLUMN", keys=["datasource_name"], measures=[("worksheets", _cnt("worksheet_name"))]),
    Tile("r36", "table_use_across_datasources", "tout", "COLUMN", keys=["table_name"], measures=[("n", _cnt("tbl_out_type"))]),
    Tile("r37", "table_to_datasource", "tbl", "SANKEY", keys=["datasource_name", "table_name"], measures=[("n", _cnt("table_name"))]),
    Tile(
        "r38",
        "datasource_column_properties",
        "tcol",
        "DETAIL",
        keys=["twb_file_name", "datasource_name", "table_name", "column_name", "data_type", "field_key"],
        derived={"field_key": "concat(twb_file_name, datasource_name, table_name, column_name)"},
        sql_overrides={"field_key": "twb_file_name || datasource_name || table_name || column_name"},
    ),
    Tile(
        "r39",
        "datasource_details",
        "ds",
        "DETAIL",
        keys=["datasource_name", "ds_prop_type", "ds_prop_name", "ds_prop_value", "twb_file_name", "ds_conv", "ds_hint", "n03", "n04", "n05"],
        derived={"n03": N03, "n04": N04, "n05": N05},
        filters=["datasource_name IS NOT NULL"],
    ),
    Tile(
        "r40",
        "convertible_calculated_fields",
        "ds",
        "KPI",
        measures=[("calc_fields", _cnt("n05"))],
        derived={"n03": N03, "n04": N04, "n05": N05},
        filters=["n03 IN ('calculated_column')", "n04 IN ('full')"],
    ),
    Tile(
        "r41",
        "convertible_joins",
        "ds",
        "KPI",
        measures=[("joins", _cd("concat(twb_file_name, datasource_name, ds_prop_value, ds_conv)"))],
        filters=["datasource_name IS NOT NULL", "ds_prop_type = 'join'"],
    ),
    Tile(
        "r42",
        "datasources_on_unsupported_platforms",
        "ds",
        "KPI",
        measures=[("datasources", _cnt("datasource_name"))],
        filters=["datasource_name IS NOT NULL", "lower(ds_conv) <> 'full'", "ds_prop_name IN ('connector')"],
    ),
    Tile(
        "r43",
        "convertible_datasource_filters",
        "ds",
        "KPI",
        measures=[("filters", _cd("concat(twb_file_name, datasource_name, ds_prop_type, ds_prop_value, ds_conv)"))],
        filters=["datasource_name IS NOT NULL", "ds_prop_name IN ('class')", "lower(ds_conv) IN ('full')"],
    ),
    Tile("r44", "supported_data_platforms", "ds", "KPI", measures=[("platforms", _cd("ds_prop_value"))], filters=["ds_prop_name IN ('connector')", "lower(ds_conv) IN ('full')"]),
    Tile("r45", "tables_on_unsupported_platforms", "unsup", "KPI", measures=[("tables", _cd("table_name"))]),
    Tile(
        "r46",
        "calculated_fields_migrated",
        "ds",
        "KPI",
        measures=[("calc_fields", _cnt("n05"))],
        derived={"n03": N03, "n04": N04, "n05": N05},
        filters=["n03 IN ('calculated_column')", "n04 IN ('full')"],
    ),
    Tile("r47", "joins_migrated", "ds", "KPI", measures=[("joins", _cd("concat(twb_file_name, datasource_name, ds_prop_value, ds_conv)"))], filters=["ds_prop_type = 'join'"]),
    Tile("r48", "total_tables", "tbl", "KPI", measures=[("tables", _cd("table_name"))]),
    Tile("r49", "execution_status", "run", "DETAIL", keys=["exec_status", "twb_file_name"]),
    Tile(
        "r50",
        "execution_duration",
        "run",
        "KPI",
        measures=[("seconds", "max(unix_timestamp(exec_end_time) - unix_timestamp(exec_start_time))")],  # D21 diff_time
        sql_overrides={"seconds": "max(CAST(epoch(exec_end_time) - epoch(exec_start_time) AS BIGINT))"},
    ),
    Tile("r51", "worksheets_per_workbook", "wsall", "COLUMN", keys=["twb_file_name"], measures=[("worksheets", _cd("worksheet_header_id"))]),
    Tile("r52", "total_fields", "tcol", "LOD", measures=[("fields", _cd("table_detail_id"))], extra=["exec_id"]),
    Tile(
        "r53",
        "mode_datasets",
        "tout",
        "KPI",
        measures=[("files", _cd("tbl_out_name")), ("tables", _cd("table_name"))],
        filters=["tbl_out_name IS NOT NULL AND tbl_out_name <> ''", "lower(tbl_conv) = 'mode dataset'"],
    ),
    Tile("r54", "total_errors", "err", "KPI", measures=[("errors", _cnt("exec_error_details"))], filters=["exec_error_details IS NOT NULL"], chosen=True),
    Tile("r55", "total_dashboards", "dash", "LOD", measures=[("dashboards", _cd("dashboard_header_id"))], extra=["dashboard_name", "twb_file_name", "exec_id"], chosen=True),
    Tile("r56", "total_dashboards_again", "dash", "LOD", measures=[("dashboards", _cd("dashboard_header_id"))], extra=["dashboard_name", "twb_file_name", "exec_id"], chosen=True),
    Tile("r57", "model_files_generated", "ds", "KPI", measures=[("files", _cd("output_file_name"))], filters=["output_file_name IS NOT NULL AND output_file_name <> ''"]),
    Tile(
        "r58",
        "dashboard_properties_analysed",
        "dash",
        "LOD",
        measures=[("properties", "count(concat(dashboard_detail_id, twb_file_name, dashboard_name))")],
        extra=["exec_id", "twb_file_id", "dashboard_name"],
        sql_overrides={"properties": "count(dashboard_detail_id || twb_file_name || dashboard_name)"},
    ),
    Tile("r59", "total_datasources", "ds", "KPI", measures=[("datasources", _cd("datasource_name"))], filters=["ds_prop_name IN ('connector')"], chosen=True),
    Tile(
        "r60",
        "filters_migrated",
        "ds",
        "KPI",
        measures=[("filters", "count(DISTINCT CASE WHEN ds_prop_name = 'class' AND lower(ds_conv) = 'full' THEN concat(datasource_name, ds_prop_type) END) + count(DISTINCT CASE WHEN ds_prop_name = 'class' THEN datasource_name END)")],
    ),
    Tile(
        "r61",
        "file_types_generated",
        "tout",
        "KPI",
        measures=[("file_types", "count(DISTINCT tbl_out_type) + count(DISTINCT tbl_conv) + count(DISTINCT CASE WHEN tbl_out_type = 'sql view tml' THEN tbl_out_type END)")],
    ),
    Tile(
        "r62",
        "files_generated",
        "tout",
        "KPI",
        measures=[("files", "count(DISTINCT CASE WHEN tbl_out_type = 'table tml' THEN tbl_out_name END) + count(DISTINCT CASE WHEN lower(tbl_conv) = 'mode dataset' THEN tbl_out_name END) + count(DISTINCT CASE WHEN tbl_out_type = 'sql view tml' THEN tbl_out_name END)")],
        chosen=True,
    ),
    Tile("r63", "table_files_generated", "tout", "KPI", measures=[("files", _cd("tbl_out_name"))], filters=["tbl_out_name IS NOT NULL AND tbl_out_name <> ''"]),
    Tile("r64", "worksheet_files_generated", "ds", "KPI", measures=[("files", _cnt("output_file_name"))], filters=["output_file_name IS NOT NULL AND output_file_name <> ''"], chosen=True),
    Tile("r65", "total_fields_migrated", "tcol", "LOD", measures=[("fields", _cd("table_detail_id"))], extra=["exec_id"]),
    Tile("r66", "errors_encountered", "err", "KPI", measures=[("errors", _cnt("exec_error_details"))], filters=["exec_error_details IS NOT NULL"], chosen=True),
    Tile("r67", "datasources_per_workbook", "ds", "COLUMN", keys=["twb_file_name"], measures=[("datasources", _cd("datasource_name"))], chosen=True),
    Tile("r68", "custom_sql_migrated", "tout", "KPI", measures=[("files", _cd("tbl_out_name"))], filters=["tbl_out_name <> ''", "lower(tbl_out_type) IN ('sql view tml')"]),
    Tile(
        "r69",
        "table_tml_files",
        "tout",
        "KPI",
        measures=[("files", _cd("tbl_out_name"))],
        filters=["tbl_out_name IS NOT NULL AND tbl_out_name <> ''", "lower(tbl_out_type) <> 'sql files'", "lower(tbl_out_type) = 'table tml'"],
        chosen=True,
    ),
    Tile("r70", "datasource_properties_analysed", "ds", "LOD", measures=[("properties", _cnt("ds_prop_value"))], extra=["exec_id"]),
    Tile("r71", "datasources_not_in_worksheets", "dnw", "LOD", measures=[("datasources", _cnt("datasource_header_id"))], extra=["exec_id"]),
    Tile("r72", "fields_per_datasource", "tcol", "LOD", keys=["datasource_name"], measures=[("fields", _cd("column_name"))], extra=["exec_id", "twb_file_id"]),
    Tile("r73", "worksheets_not_in_dashboards", "wnd", "LOD", measures=[("worksheets", _cnt("worksheet_header_id"))], extra=["exec_id"]),
    Tile("r74", "total_datasources_again", "ds", "KPI", measures=[("datasources", _cd("datasource_name"))], filters=["ds_prop_name IN ('connector')"], chosen=True),
    Tile("r75", "total_worksheets", "wsall", "KPI", measures=[("worksheets", _cd("worksheet_header_id"))]),
    Tile("r76", "total_worksheets_tab2", "wsall", "KPI", measures=[("worksheets", _cd("worksheet_header_id"))]),
    Tile("r77", "total_worksheets_tab3", "wsall", "KPI", measures=[("worksheets", _cd("worksheet_header_id"))]),
]
