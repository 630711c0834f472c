"""Warehouse tables (WH-01 … WH-20) and the dump itself as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.plans import warehouse as W
from lodestar.plans.registry import add
from lodestar.plans.warehouse_sql import WH_CTE, with_warehouse
from lodestar.sources.dump_fixture import materialized_warehouse


def _strings(df):
    """Timestamps as text so both engines hash the same value."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in df.schema.fields])


_WH_IDS = [
    ("wh01", "migration_execution_header"),
    ("wh02", "twb_file"),
    ("wh03", "datasource_header"),
    ("wh04", "worksheet_header"),
    ("wh05", "dashboard_header"),
    ("wh06", "table_header"),
    ("wh07", "migration_execution_detail"),
    ("wh08", "datasource_detail"),
    ("wh09", "worksheet_detail"),
    ("wh10", "dashboard_detail"),
    ("wh11", "table_detail"),
    ("wh12", "datasource_table_xref"),
    ("wh13", "datasource_column_xref"),
    ("wh14", "worksheet_datasource_xref"),
    ("wh15", "table_output_file"),
    ("wh16", "worksheet_header2"),
    ("wh17", "stg_worksheet_not_in_dashboard"),
    ("wh18", "stg_datasource_not_in_worksheet"),
    ("wh19", "stg_tables_connected_with_unsupported_data_platform"),
]

_TS_SQL = {
    "migration_execution_header": "SELECT exec_id, exec_mode, CAST(exec_start_time AS VARCHAR) AS exec_start_time, "
    "CAST(exec_end_time AS VARCHAR) AS exec_end_time, exec_status, twb_file_name, exec_error_details FROM meh"
}

for _qid, _table in _WH_IDS:

    def _fn(spark, sf_dir, _table=_table):
        return _strings(materialized_warehouse(spark, sf_dir)[_table])

    add(f"{_qid}_{_table}", _fn, with_warehouse(_TS_SQL.get(_table, f"SELECT * FROM {WH_CTE[_table]}")))


def _dump(spark, sf_dir):
    d = materialized_warehouse(spark, sf_dir)["raw_data_dump"]
    return _strings(d)


add(
    "ex29_property_dump",
    _dump,
    with_warehouse(
        "SELECT * EXCLUDE (exec_start_time, exec_end_time, last_ingested_date), CAST(exec_start_time AS VARCHAR) AS exec_start_time, "
        "CAST(exec_end_time AS VARCHAR) AS exec_end_time, CAST(last_ingested_date AS VARCHAR) AS last_ingested_date FROM raw_data_dump"
    ),
)


def _integrity(spark, sf_dir):
    return W.key_integrity(materialized_warehouse(spark, sf_dir))


_KI = []
for _t, _pk, _fks in W.KEYS:
    _c = WH_CTE[_t]
    _KI.append(
        f"SELECT '{_t}' AS table_name, 'duplicate {_pk}' AS check_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations "
        f"FROM (SELECT {_pk}, count(*) AS n FROM {_c} GROUP BY {_pk} HAVING count(*) > 1)"
    )
    for _col, _parent, _pkey in _fks:
        _KI.append(
            f"SELECT '{_t}' AS table_name, 'orphan {_col}' AS check_name, count(*) AS violations FROM {_c} "
            f"WHERE {_col} IS NOT NULL AND {_col} NOT IN (SELECT {_pkey} FROM {WH_CTE[_parent]} WHERE {_pkey} IS NOT NULL)"
        )
add("wh20_key_integrity", _integrity, with_warehouse("\nUNION ALL\n".join(_KI)))


def _wh21(spark, sf_dir):
    """WH-21: the load order run by run.  Run 1 and run 2 are loaded in separate
    calls; every table keeps both.  Counts per table."""
    from lodestar.sources.sinks import scratch_dir

    dump = materialized_warehouse(spark, sf_dir)["raw_data_dump"]
    path = scratch_dir(spark, "warehouse")
    for run in ("run1", "run2"):
        w = W.load(dump.filter(F.col("exec_id") == F.md5(F.lit(run))))
        W.write_run(w, path)
    out = None
    for name in w:
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


add(
    "wh21_load_and_write",
    _wh21,
    with_warehouse("\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {c}" for t, c in WH_CTE.items())),
)


def _wh21_published(spark, sf_dir):
    """WH-21 atomic: run 1, run 2 and run 1 again are published; counts per table as readers see them."""
    from lodestar.sources.published import at_version, manifest
    from lodestar.sources.sinks import scratch_dir

    dump = materialized_warehouse(spark, sf_dir)["raw_data_dump"]
    path = scratch_dir(spark, "published")
    for run in ("run1", "run2", "run1"):
        W.publish_run(W.load(dump.filter(F.col("exec_id") == F.md5(F.lit(run)))), path)
    content = manifest(spark, path)[1]
    out = None
    for name in content:
        part = at_version(spark, path, name, content).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


add(
    "wh21_atomic_publish",
    _wh21_published,
    with_warehouse("\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {c}" for t, c in WH_CTE.items())),
)
