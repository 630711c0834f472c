"""Warehouse load (WH-01 … WH-21): property dump -> 16 keyed tables + 3 views.

Every table is a DataFrame job over the dump.  Runs are kept apart by
``exec_id`` in every join (Q13, Q14), keys are md5 surrogates of the
unseparated concatenation (N07, Q16), and the load is idempotent: writing a
run overwrites only that run's ``exec_id`` partition (Q15).

Scale notes: the dump is an entity-attribute-value table; each header table
is a filter + projection + ``distinct`` (one shuffle on the key columns).
Detail tables join the dump to a header on (exec_id, workbook, object name):
headers are orders of magnitude smaller than the dump, so AQE broadcasts them
when they fit and otherwise sort-merge joins on those keys; skew on one
workbook is split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.calc import clean_table_name, md5_key, regex_capture

DUMP_BASE_COLUMNS = [
    "twb_file_name",
    "object_type",
    "datasource_name",
    "table_name",
    "remote_column_name",
    "local_column_name",
    "worksheet_name",
    "dashboard_name",
    "property_type",
    "property_name",
    "property_value",
    "proposed_value",
    "conversion_in_ts",
    "supported_in_ts",
    "supported_in_migrator",
    "exec_error_details",
]
DUMP_RUN_COLUMNS = ["exec_mode", "exec_status", "exec_start_time", "exec_end_time", "last_ingested_date", "exec_id", "output_file_type", "output_file_name"]
DUMP_COLUMNS = DUMP_BASE_COLUMNS + DUMP_RUN_COLUMNS
_TS = {"exec_start_time", "exec_end_time", "last_ingested_date"}


def conform_dump(df: DataFrame) -> DataFrame:
    """EX-29/IO-05: the fixed dump column list, every value a string except the
    three run timestamps (missing columns become NULL)."""
    cols = []
    for c in DUMP_COLUMNS:
        t = "timestamp" if c in _TS else "string"
        cols.append((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c))
    return df.select(*cols)


def execution_header(dump: DataFrame) -> DataFrame:
    """WH-01."""
    return (
        dump.filter(F.col("exec_mode").isNotNull())
        .select("exec_id", "exec_mode", "exec_start_time", "exec_end_time", "exec_status", "twb_file_name", F.lit(None).cast("string").alias("exec_error_details"))
        .distinct()
    )


def twb_file(dump: DataFrame, header: DataFrame) -> DataFrame:
    """WH-02 run x workbook."""
    files = dump.select("exec_id", "twb_file_name").distinct()
    h = header.select("exec_id", "twb_file_name").distinct()
    j = h.join(files, ["exec_id", "twb_file_name"], "inner")
    return j.select(md5_key("exec_id", "twb_file_name").alias("twb_file_id"), "exec_id", "twb_file_name").distinct()


def _with_file(dump: DataFrame, files: DataFrame) -> DataFrame:
    return dump.join(files.select("exec_id", "twb_file_name", "twb_file_id"), ["exec_id", "twb_file_name"], "inner")


def datasource_header(dump: DataFrame, files: DataFrame) -> DataFrame:
    """WH-03."""
    d = _with_file(dump.filter((F.col("object_type") == "datasource property") & (F.col("property_name") == "connection")), files)
    return d.select(
        md5_key("exec_id", "twb_file_id", "datasource_name").alias("datasource_header_id"),
        "exec_id",
        "twb_file_id",
        "datasource_name",
        "output_file_type",
        "output_file_name",
    ).distinct()


def worksheet_header(dump: DataFrame, files: DataFrame) -> DataFrame:
    """WH-04."""
    d = _with_file(dump.filter(F.col("object_type") == "chart"), files)
    return d.select(md5_key("exec_id", "twb_file_id", "worksheet_name").alias("worksheet_header_id"), "exec_id", "twb_file_id", "worksheet_name").distinct()


def dashboard_header(dump: DataFrame, files: DataFrame) -> DataFrame:
    """WH-05."""
    d = _with_file(dump.filter((F.col("object_type") == "dashboard") & F.col("dashboard_name").isNotNull()), files)
    return d.select(md5_key("exec_id", "twb_file_id", "dashboard_name").alias("dashboard_header_id"), "exec_id", "twb_file_id", "dashboard_name").distinct()


def table_header(dump: DataFrame, files: DataFrame) -> DataFrame:
    """WH-06 tables UNION custom-SQL headers (SO-01)."""
    t = dump.filter((F.col("object_type") == "table") & F.col("table_name").isNotNull()).join(files.select("exec_id", "twb_file_name"), ["exec_id", "twb_file_name"], "left_semi")
    name = clean_table_name("table_name")
    tables = t.select(md5_key("exec_id", name, "property_value").alias("table_header_id"), "exec_id", name.alias("table_name"), F.col("property_value").alias("connection_tag"), F.lit("table").alias("type"))
    q = dump.filter((F.col("object_type") == "custom sql query") & (F.col("property_type") == "connection tag"))
    custom = q.select(
        md5_key("exec_id", "table_name", "property_value").alias("table_header_id"), "exec_id", "table_name", F.col("property_value").alias("connection_tag"), F.lit("custom sql query").alias("type")
    )
    return tables.union(custom).distinct()


def execution_detail(dump: DataFrame, files: DataFrame) -> DataFrame:
    """WH-07 error rows per workbook."""
    d = _with_file(dump.filter(F.col("exec_error_details").isNotNull()), files)
    return d.select(md5_key("exec_id", "twb_file_id", "exec_error_details").alias("exec_detail_id"), "exec_id", "twb_file_id", "exec_status", "exec_error_details")


def datasource_detail(dump: DataFrame, files: DataFrame, ds_header: DataFrame) -> DataFrame:
    """WH-08 datasource properties and calculated columns."""
    rows = dump.filter((F.col("object_type") == "datasource property") | ((F.col("object_type") == "column") & (F.col("property_type") == "calculated_column")))
    rows = _with_file(rows, files)
    j = rows.join(ds_header.select("datasource_header_id", "exec_id", "twb_file_id", "datasource_name"), ["exec_id", "twb_file_id", "datasource_name"], "inner")
    return j.select(
        md5_key("datasource_header_id", "property_value").alias("datasource_detail_id"),
        "datasource_header_id",
        "property_type",
        "property_name",
        "property_value",
        F.coalesce("supported_in_ts", F.lit("  ")).alias("conv_feasibility"),
        F.coalesce("conversion_in_ts", F.lit(" ")).alias("ts_equivalent_hint"),
        F.lit(" ").alias("migration_status"),
    )


def worksheet_detail(dump: DataFrame, files: DataFrame, ws_header: DataFrame) -> DataFrame:
    """WH-09 chart properties, joined on run, workbook and worksheet (Q13)."""
    rows = dump.filter(F.col("worksheet_name").isNotNull() & F.col("object_type").isin("chart", "chart property") & F.col("property_value").isNotNull())
    rows = _with_file(rows, files)
    j = rows.join(ws_header.select("worksheet_header_id", "exec_id", "twb_file_id", "worksheet_name"), ["exec_id", "twb_file_id", "worksheet_name"], "inner")
    return j.select(
        md5_key("worksheet_header_id", "property_value").alias("worksheet_detail_id"),
        "worksheet_header_id",
        "property_type",
        "property_name",
        "property_value",
        F.coalesce("supported_in_ts", F.lit(" ")).alias("conv_feasibility"),
        F.coalesce("conversion_in_ts", F.lit(" ")).alias("ts_equivalent_hint"),
    )


def dashboard_detail(dump: DataFrame, files: DataFrame, db_header: DataFrame, ws_header: DataFrame) -> DataFrame:
    """WH-10 dashboard properties with the optional worksheet."""
    rows = dump.filter(F.col("object_type").isin("dashboard", "dashboard property") & F.col("property_value").isNotNull())
    rows = _with_file(rows, files)
    j = rows.join(db_header.select("dashboard_header_id", "exec_id", "twb_file_id", "dashboard_name"), ["exec_id", "twb_file_id", "dashboard_name"], "inner")
    j = j.join(ws_header.select("worksheet_header_id", "exec_id", "twb_file_id", "worksheet_name"), ["exec_id", "twb_file_id", "worksheet_name"], "left")
    return j.select(
        md5_key("dashboard_header_id", "worksheet_header_id", "property_value").alias("dashboard_detail_id"),
        "dashboard_header_id",
        "worksheet_header_id",
        "property_type",
        "property_name",
        "property_value",
        F.coalesce("supported_in_ts", F.lit(" ")).alias("conv_feasibility"),
        F.coalesce("conversion_in_ts", F.lit(" ")).alias("ts_equivalent_hint"),
    )


def split_table_name(name) -> F.Column:
    """WH-11 / P-05: ``[db].[schema].[table]`` -> ``table``; ``[table]`` -> ``table``."""
    n = F.col(name) if isinstance(name, str) else name
    third = F.split_part(n, F.lit("."), F.lit(3))
    return (
        F.when(n.like("[%].[%].[%]"), F.substr(third, F.lit(2), F.length(third) - 2))
        .when(n.like("[%"), F.substr(n, F.lit(2), F.length(n) - 2))
        .otherwise(n)
    )


def table_detail(dump: DataFrame, tbl_header: DataFrame) -> DataFrame:
    """WH-11 columns per table, restricted to the run (Q14)."""
    th = tbl_header.filter(F.col("type") == "table").select("table_header_id", "exec_id", split_table_name("table_name").alias("short_name"))
    cols = dump.filter((F.col("object_type") == "column") & (F.col("property_type") == "metadata-record")).select(
        "exec_id", F.col("table_name").alias("short_name"), "local_column_name", "property_value", "supported_in_ts", "conversion_in_ts"
    )
    j = th.join(cols, ["exec_id", "short_name"], "inner")
    return j.select(
        md5_key("table_header_id", "local_column_name").alias("table_detail_id"),
        "table_header_id",
        F.col("local_column_name").alias("column_name"),
        F.col("property_value").alias("data_type"),
        F.col("supported_in_ts").alias("conv_feasibility"),
        F.col("conversion_in_ts").alias("ts_data_type"),
        F.lit("").alias("migration_status"),
    ).distinct()


def datasource_table_xref(dump: DataFrame, ds_header: DataFrame, tbl_header: DataFrame) -> DataFrame:
    """WH-12 datasource <-> table."""
    t = dump.filter(F.col("object_type").isin("table", "custom sql query")).select("exec_id", "datasource_name", clean_table_name("table_name").alias("table_name")).distinct()
    d = ds_header.select("datasource_header_id", "exec_id", "datasource_name").join(t, ["exec_id", "datasource_name"], "inner")
    j = d.join(tbl_header.select("table_header_id", "exec_id", "table_name"), ["exec_id", "table_name"], "inner")
    return j.select(md5_key("datasource_header_id", "table_header_id").alias("datasource_table_xref_id"), "datasource_header_id", "table_header_id").distinct()


def datasource_column_xref(dump: DataFrame, tbl_detail: DataFrame, tbl_header: DataFrame, ds_header: DataFrame) -> DataFrame:
    """WH-13 datasource <-> column."""
    ht = tbl_detail.select("table_detail_id", "table_header_id").join(tbl_header.select("table_header_id", "exec_id", "table_name"), "table_header_id", "inner")
    dn = dump.filter(F.col("table_name").isNotNull()).select("exec_id", clean_table_name("table_name").alias("table_name"), "datasource_name").distinct()
    j = ht.join(dn, ["exec_id", "table_name"], "inner").join(ds_header.select("datasource_header_id", "exec_id", "datasource_name"), ["exec_id", "datasource_name"], "inner")
    return j.select(md5_key("datasource_header_id", "table_detail_id").alias("datasource_column_xref_id"), "datasource_header_id", "table_detail_id").distinct()


def worksheet_datasource_xref(ws_detail: DataFrame, ws_header: DataFrame, ds_header: DataFrame) -> DataFrame:
    """WH-14 worksheet <-> datasource; the datasource key is re-derived by md5."""
    wsd = ws_detail.filter(F.col("property_type") == "datasource").select("worksheet_header_id", "property_value")
    w = wsd.join(ws_header, "worksheet_header_id", "inner").withColumn("datasource_header_id", md5_key("exec_id", "twb_file_id", "property_value"))
    j = w.join(ds_header.select("datasource_header_id"), "datasource_header_id", "inner")
    return j.select(
        md5_key("datasource_header_id", "worksheet_header_id").alias("worksheet_datasource_xref_id"), "datasource_header_id", "worksheet_header_id", "twb_file_id", "worksheet_name"
    )


def table_output_file(dump: DataFrame, tbl_header: DataFrame) -> DataFrame:
    """WH-15 generated files per table."""
    d = dump.filter((F.col("object_type") == "table") | ((F.col("object_type") == "custom sql query") & (F.col("property_type") == "text"))).select(
        "exec_id", clean_table_name("table_name").alias("table_name"), "conversion_in_ts", "output_file_type", "output_file_name"
    )
    j = d.join(tbl_header.select("table_header_id", "exec_id", "table_name"), ["exec_id", "table_name"], "left")
    return j.select(
        md5_key("table_header_id", "output_file_type", "output_file_name").alias("table_output_file_id"), "table_header_id", "output_file_type", "output_file_name", "conversion_in_ts"
    )


def worksheet_not_in_dashboard(ws_header: DataFrame, db_detail: DataFrame, db_header: DataFrame) -> DataFrame:
    """WH-17 (SO-03)."""
    used = db_detail.join(db_header, "dashboard_header_id").select("exec_id", "twb_file_id", "worksheet_header_id")
    return ws_header.select("exec_id", "twb_file_id", "worksheet_header_id").subtract(used)


def datasource_not_in_worksheet(ds_header: DataFrame, ws_ds_xref: DataFrame, ws_header: DataFrame) -> DataFrame:
    """WH-18 (SO-04)."""
    used = ws_ds_xref.select("worksheet_header_id", "datasource_header_id").join(ws_header.select("worksheet_header_id", "exec_id", "twb_file_id"), "worksheet_header_id", "left").select("exec_id", "twb_file_id", "datasource_header_id")
    return ds_header.select("exec_id", "twb_file_id", "datasource_header_id").subtract(used)


def tables_on_unsupported_platform(ds_tbl_xref: DataFrame, tbl_header: DataFrame, ds_detail: DataFrame) -> DataFrame:
    """WH-19 tables of datasources whose connector is not fully supported."""
    base = ds_tbl_xref.join(tbl_header, "table_header_id", "left").select(
        "datasource_header_id", "exec_id", "table_header_id", "table_name", regex_capture("connection_tag", 'class="([^"]+)"').alias("class_value")
    )
    dd = ds_detail.filter((F.col("property_name") == "connector") & (F.col("conv_feasibility") != "Full")).select(
        "datasource_header_id", "property_name", "property_value", "conv_feasibility"
    )
    j = base.join(dd, "datasource_header_id", "inner")
    return j.select("datasource_header_id", "table_header_id", "exec_id", "table_name", "class_value", "property_name", "property_value", "conv_feasibility").distinct()


def load(dump: DataFrame) -> dict[str, DataFrame]:
    """WH-21 load order: header -> file -> headers -> details -> views -> copy."""
    dump = conform_dump(dump)
    w = {}
    w["migration_execution_header"] = execution_header(dump)
    w["twb_file"] = files = twb_file(dump, w["migration_execution_header"])
    w["datasource_header"] = dsh = datasource_header(dump, files)
    w["worksheet_header"] = wsh = worksheet_header(dump, files)
    w["dashboard_header"] = dbh = dashboard_header(dump, files)
    w["table_header"] = th = table_header(dump, files)
    w["migration_execution_detail"] = execution_detail(dump, files)
    w["datasource_detail"] = dsd = datasource_detail(dump, files, dsh)
    w["worksheet_detail"] = wsd = worksheet_detail(dump, files, wsh)
    w["dashboard_detail"] = dbd = dashboard_detail(dump, files, dbh, wsh)
    w["table_detail"] = td = table_detail(dump, th)
    w["datasource_table_xref"] = dtx = datasource_table_xref(dump, dsh, th)
    w["datasource_column_xref"] = datasource_column_xref(dump, td, th, dsh)
    w["worksheet_datasource_xref"] = wdx = worksheet_datasource_xref(wsd, wsh, dsh)
    w["table_output_file"] = table_output_file(dump, th)
    w["worksheet_header2"] = wsh.select("*")  # WH-16 truncate and copy
    w["stg_worksheet_not_in_dashboard"] = worksheet_not_in_dashboard(wsh, dbd, dbh)
    w["stg_datasource_not_in_worksheet"] = datasource_not_in_worksheet(dsh, wdx, wsh)
    w["stg_tables_connected_with_unsupported_data_platform"] = tables_on_unsupported_platform(dtx, th, dsd)
    return w


# WH-20 key integrity: (table, primary key, [(fk column, parent table, parent key)])
KEYS = [
    ("migration_execution_header", "exec_id", []),
    ("twb_file", "twb_file_id", [("exec_id", "migration_execution_header", "exec_id")]),
    ("migration_execution_detail", "exec_detail_id", [("twb_file_id", "twb_file", "twb_file_id")]),
    ("datasource_header", "datasource_header_id", [("twb_file_id", "twb_file", "twb_file_id")]),
    ("datasource_detail", "datasource_detail_id", [("datasource_header_id", "datasource_header", "datasource_header_id")]),
    ("worksheet_header", "worksheet_header_id", [("twb_file_id", "twb_file", "twb_file_id")]),
    ("worksheet_detail", "worksheet_detail_id", [("worksheet_header_id", "worksheet_header", "worksheet_header_id")]),
    ("dashboard_header", "dashboard_header_id", [("twb_file_id", "twb_file", "twb_file_id")]),
    ("dashboard_detail", "dashboard_detail_id", [("dashboard_header_id", "dashboard_header", "dashboard_header_id")]),
    ("table_header", "table_header_id", []),
    ("table_detail", "table_detail_id", [("table_header_id", "table_header", "table_header_id")]),
    ("table_output_file", "table_output_file_id", [("table_header_id", "table_header", "table_header_id")]),
    ("datasource_table_xref", "datasource_table_xref_id", [("datasource_header_id", "datasource_header", "datasource_header_id"), ("table_header_id", "table_header", "table_header_id")]),
    ("datasource_column_xref", "datasource_column_xref_id", [("table_detail_id", "table_detail", "table_detail_id")]),
    ("worksheet_datasource_xref", "worksheet_datasource_xref_id", [("worksheet_header_id", "worksheet_header", "worksheet_header_id")]),
]


def key_integrity(w: dict[str, DataFrame]) -> DataFrame:
    """WH-20: rows with a duplicated primary key, and orphan foreign keys.

    One row per (table, check) with the number of offending rows; each check
    is an aggregate (duplicates) or a ``left_anti`` join (orphans)."""
    parts = []
    for table, pk, fks in KEYS:
        dup = w[table].groupBy(pk).count().filter(F.col("count") > 1).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("violations"))
        parts.append(dup.select(F.lit(table).alias("table_name"), F.lit(f"duplicate {pk}").alias("check_name"), "violations"))
        for col, parent, pkey in fks:
            orphans = w[table].filter(F.col(col).isNotNull()).join(w[parent].select(F.col(pkey).alias(col)).distinct(), col, "left_anti")
            parts.append(orphans.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(f"orphan {col}").alias("check_name"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Tables without exec_id of their own: the header whose run they belong to, by its key.
RUN_OF = {
    "datasource_detail": ("datasource_header", "datasource_header_id"),
    "worksheet_detail": ("worksheet_header", "worksheet_header_id"),
    "dashboard_detail": ("dashboard_header", "dashboard_header_id"),
    "table_detail": ("table_header", "table_header_id"),
    "datasource_table_xref": ("datasource_header", "datasource_header_id"),
    "datasource_column_xref": ("datasource_header", "datasource_header_id"),
    "worksheet_datasource_xref": ("worksheet_header", "worksheet_header_id"),
    "table_output_file": ("table_header", "table_header_id"),
}


def with_run(w: dict[str, DataFrame], name: str, first: str | None) -> DataFrame:
    """A table with the run of each row; rows without a header belong to the load's ``first`` run."""
    df = w[name]
    if "exec_id" in df.columns:
        return df
    header, key = RUN_OF[name]
    runs = w[header].select(key, "exec_id").distinct()
    return df.join(runs, key, "left").select(*df.columns, F.coalesce("exec_id", F.lit(first)).alias("exec_id"))


def write_run(w: dict[str, DataFrame], out_dir: str) -> None:
    """Q15: idempotent load.  Every table is kept by ``exec_id``; the runs of this
    load are replaced in all of them, also where a run has no rows now, and other
    runs stay as they are."""
    spark = next(iter(w.values())).sparkSession
    runs = [r[0] for r in w["migration_execution_header"].select("exec_id").distinct().collect()]  # the runs of one load
    fs = spark._jvm.org.apache.hadoop.fs
    for name in w:
        target = f"{out_dir.rstrip('/')}/{name}"
        for run in runs:  # a load that fails after this is loaded again
            old = fs.Path(f"{target}/exec_id={run}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        with_run(w, name, min(runs, default=None)).write.mode("append").partitionBy("exec_id").parquet(target)


def publish_run(w: dict[str, DataFrame], out_dir: str) -> int:
    """WH-21: the load's runs in all tables at once (``sources.published``): readers see the old tables or the new ones."""
    from lodestar.sources.published import publish

    runs = sorted(r[0] for r in w["migration_execution_header"].select("exec_id").distinct().collect())  # the runs of one load
    first = runs[0] if runs else None
    return publish({name: with_run(w, name, first) for name in w}, runs, out_dir)
