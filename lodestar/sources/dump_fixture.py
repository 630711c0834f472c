"""Property dump derived from the driver tables (FIXTURES.md §3).

A workbook per region, a datasource and table per nation, a column per
supplier, calculated columns per (nation, customer segment), worksheets per
(region, segment), dashboards per (region, order status), error rows for
parts of size 1, and two runs (the second re-processes workbooks whose
region starts with ``A``).  Built with joins, group-bys and unions only, so
its size grows with ``supplier``, ``customer``, ``orders`` and ``part``.
The same rows are produced by ``DUMP_SQL`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.warehouse import DUMP_COLUMNS, conform_dump
from lodestar.sources.mappings import TARGET_EXTRACT, TARGET_TABLE, chart_map, connectors_map, datatype_map, joins_map
from lodestar.sources.tables import Tables, tables_stamp

# Fixed values of the fixture.
RUNS = [
    ("run1", "feasibility", "2024-01-01 10:00:00", "2024-01-01 10:05:30"),
    ("run2", "convert", "2024-01-02 09:00:00", "2024-01-02 09:01:10"),
]
CONNECTORS = ["Snowflake", "PostgreSQL", "Splunk", "MySQL"]  # by n_nationkey % 4
COLUMN_TYPES = ["integer", "real", "string", "date"]  # by s_suppkey % 4
JOIN_KINDS = ["inner", "left", "right", "full"]  # by n_nationkey % 4
FILTER_CLASSES = ["categorical", "quantitative", "relative-date"]  # by (nation + priority digit) % 3
SEGMENT_MARKS = {"AUTOMOBILE": "Bar", "BUILDING": "Line", "FURNITURE": "Text", "HOUSEHOLD": "Circle", "MACHINERY": "Automatic"}
SEGMENT_FORMULAS = {
    "AUTOMOBILE": "SUM([Sales]) / TOTAL(SUM([Sales]))",
    "BUILDING": "RUNNING_SUM(SUM([Sales]))",
    "FURNITURE": "([Profit] - LOOKUP([Profit], -1)) / ABS(LOOKUP([Profit], -1))",
    "HOUSEHOLD": "IF YEAR([Order Date]) = 2019 THEN [Sales] ELSE 0 END",
    "MACHINERY": "STDEV([Sales]) / AVG([Sales])",
}
PLACED_SEGMENTS = ["AUTOMOBILE", "BUILDING"]
RUN_COLS = {"exec_id", "exec_mode", "exec_status", "exec_start_time", "exec_end_time", "last_ingested_date"}


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _map(mapping: dict, key):
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def derive_dump(spark, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    nr = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    wb = F.concat(F.col("r_name"), F.lit(".twb"))
    ds_type = F.when(F.col("n_nationkey") % 3 == 0, F.lit("Extract")).otherwise(F.lit("Live"))
    connector = _pick(CONNECTORS, F.col("n_nationkey") % 4)
    nat = nr.select("r_name", "n_name", "n_nationkey", wb.alias("twb_file_name"), ds_type.alias("ds_type"), connector.alias("connector"))
    rows = []

    # datasource kind (EX-01) with its output file
    rows.append(
        nat.select(
            "r_name",
            "twb_file_name",
            F.lit("datasource property").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.lit("ds_type").alias("property_type"),
            F.lit("connection").alias("property_name"),
            F.col("ds_type").alias("property_value"),
            F.lit("Full").alias("supported_in_ts"),
            F.when(F.col("ds_type") == "Extract", F.lit("sql files")).otherwise(F.lit("model tml")).alias("output_file_type"),
            F.concat(F.lower("n_name"), F.when(F.col("ds_type") == "Extract", F.lit(".sql")).otherwise(F.lit(".model.tml"))).alias("output_file_name"),
        )
    )
    # connectors (EX-02) + MP-01 support by Live/Extract
    cm = connectors_map(spark).select("name_key", "supported_live", "supported_extract")
    con = nat.join(F.broadcast(cm), F.lower(F.col("connector")) == F.col("name_key"), "left")
    rows.append(
        con.select(
            "r_name",
            "twb_file_name",
            F.lit("datasource property").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.lit("named_connection").alias("property_type"),
            F.lit("connector").alias("property_name"),
            F.col("connector").alias("property_value"),
            F.when(F.col("ds_type") == "Live", F.col("supported_live")).otherwise(F.col("supported_extract")).alias("supported_in_ts"),
        )
    )
    # joins (EX-03) between consecutive nations of a region + MP-02
    nxt = F.lead("n_name").over(Window.partitionBy("r_name").orderBy("n_nationkey"))
    pairs = nat.select("r_name", "twb_file_name", "n_name", "n_nationkey", nxt.alias("next_name")).filter(F.col("next_name").isNotNull())
    pairs = pairs.withColumn("join_kind", _pick(JOIN_KINDS, F.col("n_nationkey") % 4))
    jm = joins_map(spark).select(F.col("workbook_join").alias("join_kind"), "target_join", F.col("supported_live").alias("join_support"))
    pairs = pairs.join(F.broadcast(jm), "join_kind", "left")
    rows.append(
        pairs.select(
            "r_name",
            "twb_file_name",
            F.lit("datasource property").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.lit("join").alias("property_type"),
            F.col("join_kind").alias("property_name"),
            F.concat(F.lit("["), F.col("n_name"), F.lit("].[key]::["), F.col("next_name"), F.lit("].[key]")).alias("property_value"),
            F.col("join_support").alias("supported_in_ts"),
            F.col("target_join").alias("conversion_in_ts"),
        )
    )
    # datasource filters (EX-15) per (nation, order priority) present in the data
    occ = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_nationkey", "o_orderpriority", "o_orderstatus", "c_mktsegment")
        .distinct()
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    fl = occ.select("r_name", "twb_file_name", "n_name", "n_nationkey", "o_orderpriority").distinct()
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    fclass = _pick(FILTER_CLASSES, (F.col("n_nationkey") + digit) % 3)
    rows.append(
        fl.select(
            "r_name",
            "twb_file_name",
            F.lit("datasource property").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.concat(F.lit("Filter_"), digit.cast("string")).alias("property_type"),
            F.lit("class").alias("property_name"),
            fclass.alias("property_value"),
            F.when(fclass == "relative-date", F.lit("NoSup")).otherwise(F.lit("Full")).alias("supported_in_ts"),
        )
    )
    # tables (EX-04) with connection tag, output file and target label (MP-12)
    rows.append(
        nat.select(
            "r_name",
            "twb_file_name",
            F.lit("table").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.concat(F.lit("[DB].["), F.col("r_name"), F.lit("].["), F.col("n_name"), F.lit("]")).alias("table_name"),
            F.lit("connection tag").alias("property_type"),
            F.concat(F.lit('<connection class="'), F.lower("connector"), F.lit('"/>')).alias("property_value"),
            F.lit("table tml").alias("output_file_type"),
            F.concat(F.lower("n_name"), F.lit(".table.tml")).alias("output_file_name"),
            F.when(F.col("ds_type") == "Extract", F.lit(TARGET_EXTRACT)).otherwise(F.lit(TARGET_TABLE)).alias("conversion_in_ts"),
        )
    )
    # custom SQL (EX-06) for nations whose key is a multiple of 5
    cs = nat.filter(F.col("n_nationkey") % 5 == 0)
    cs_name = F.concat(F.lit("Custom_SQL_"), F.col("n_name"))
    rows.append(
        cs.select(
            "r_name",
            "twb_file_name",
            F.lit("custom sql query").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            cs_name.alias("table_name"),
            F.lit("text").alias("property_type"),
            F.lit("query").alias("property_name"),
            F.concat(F.lit("SELECT * FROM "), F.col("n_name")).alias("property_value"),
            F.lit("sql view tml").alias("output_file_type"),
            F.concat(F.lower("n_name"), F.lit("_custom.sql.tml")).alias("output_file_name"),
            F.lit(TARGET_TABLE).alias("conversion_in_ts"),
        )
    )
    rows.append(
        cs.select(
            "r_name",
            "twb_file_name",
            F.lit("custom sql query").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            cs_name.alias("table_name"),
            F.lit("connection tag").alias("property_type"),
            F.concat(F.lit('<connection class="'), F.lower("connector"), F.lit('"/>')).alias("property_value"),
        )
    )
    # columns (EX-08) per supplier + MP-03 data type map (Q9: first row per type wins)
    dm = datatype_map(spark)
    dm = dm.withColumn("_rn", F.row_number().over(Window.partitionBy("source_type").orderBy("file_order"))).filter("_rn = 1")
    dm = dm.select(F.col("source_type").alias("col_type"), F.col("target_type"), F.col("supported").alias("type_support"))
    sup = t.supplier.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("col_type", _pick(COLUMN_TYPES, F.col("s_suppkey") % 4))
    sup = sup.join(F.broadcast(dm), "col_type", "left")
    rows.append(
        sup.select(
            "r_name",
            "twb_file_name",
            F.lit("column").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.col("n_name").alias("table_name"),
            F.upper("s_name").alias("remote_column_name"),
            F.col("s_name").alias("local_column_name"),
            F.lit("metadata-record").alias("property_type"),
            F.lit("data type").alias("property_name"),
            F.col("col_type").alias("property_value"),
            F.col("type_support").alias("supported_in_ts"),
            F.col("target_type").alias("conversion_in_ts"),
        )
    )
    # calculated columns (EX-09) per (nation, segment) present among customers; MP-10 verdict
    seg = t.customer.select("c_nationkey", "c_mktsegment").distinct().join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
    formula = _map(SEGMENT_FORMULAS, F.col("c_mktsegment"))
    verdict = F.when(F.contains(formula, F.lit("TOTAL(")), F.lit("Partial")).when(F.contains(formula, F.lit("LOOKUP(")), F.lit("NoSup")).otherwise(F.lit("Full"))
    hint = F.when(verdict == "Partial", F.lit("TBD")).when(verdict == "NoSup", F.lit("error")).otherwise(F.lower(formula))
    rows.append(
        seg.select(
            "r_name",
            "twb_file_name",
            F.lit("column").alias("object_type"),
            F.col("n_name").alias("datasource_name"),
            F.lit("calculated_column").alias("property_type"),
            F.concat(F.lit("Calculation_"), F.col("n_nationkey").cast("string"), F.lit("_"), F.substring("c_mktsegment", 1, 3)).alias("property_name"),
            formula.alias("property_value"),
            verdict.alias("supported_in_ts"),
            hint.alias("conversion_in_ts"),
        )
    )
    # worksheets (EX-11…EX-14) per (region, segment)
    rs = t.customer.join(nat, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "twb_file_name", "c_mktsegment").agg(F.min("n_nationkey").alias("_k"))
    first_ds = nat.groupBy("r_name").agg(F.min_by("n_name", "n_nationkey").alias("first_ds"))
    ws = rs.join(first_ds, "r_name").withColumn("worksheet_name", F.concat(F.col("r_name"), F.lit("_"), F.col("c_mktsegment")))
    ws = ws.withColumn("mark", _map(SEGMENT_MARKS, F.col("c_mktsegment")))
    cmk = chart_map(spark).filter(F.col("kind") == "mark").select(F.col("property").alias("mark"), F.col("support").alias("mark_support"), F.col("hint").alias("mark_hint"))
    ws = ws.join(F.broadcast(cmk), "mark", "left")
    base_ws = ["r_name", "twb_file_name", "worksheet_name"]
    rows.append(
        ws.select(
            *base_ws,
            F.lit("chart").alias("object_type"),
            F.lit("chart type").alias("property_type"),
            F.lit("mark").alias("property_name"),
            F.col("mark").alias("property_value"),
            F.col("mark_support").alias("supported_in_ts"),
            F.col("mark_hint").alias("conversion_in_ts"),
        )
    )
    enc = chart_map(spark).filter(F.col("kind") == "encoding").select(F.col("property").alias("channel"), F.col("support").alias("enc_support"), F.col("hint").alias("enc_hint"))
    props = [
        ("encoding", "color", "[ds].[none:C_MKTSEGMENT:nk]"),
        ("encoding", "size", "[ds].[sum:C_ACCTBAL:qk]"),
        ("axis", "rows", "[ds].[none:N_NAME:nk]"),
        ("axis", "cols", "[ds].[sum:C_ACCTBAL:qk]"),
        ("Filter_1", "class", "categorical"),
    ]
    for ptype, pname, pval in props:
        p = ws.select(*base_ws, "first_ds", F.lit(ptype).alias("property_type"), F.lit(pname).alias("property_name"), F.lit(pval).alias("property_value"))
        if ptype == "encoding":
            p = p.join(F.broadcast(enc), F.col("property_name") == F.col("channel"), "left")
            support, hint = F.col("enc_support"), F.col("enc_hint")
        elif ptype == "axis":
            support, hint = F.lit("Partial"), F.lit("Check the chart type")
        else:
            support, hint = F.lit("Full"), F.lit("Use INCLUDE filter")
        rows.append(
            p.select(
                *base_ws,
                F.col("first_ds").alias("datasource_name"),
                F.lit("chart property").alias("object_type"),
                "property_type",
                "property_name",
                "property_value",
                support.alias("supported_in_ts"),
                hint.alias("conversion_in_ts"),
            )
        )
    rows.append(
        ws.select(
            *base_ws,
            F.col("first_ds").alias("datasource_name"),
            F.lit("chart property").alias("object_type"),
            F.lit("datasource").alias("property_type"),
            F.lit("name").alias("property_name"),
            F.col("first_ds").alias("property_value"),
        )
    )
    # dashboards (EX-21…EX-28) per (region, order status); two segments are placed
    ocr = occ
    dbs = ocr.select("r_name", "twb_file_name", F.concat(F.col("r_name"), F.lit("_"), F.col("o_orderstatus")).alias("dashboard_name")).distinct()
    rows.append(
        dbs.select(
            "r_name",
            "twb_file_name",
            "dashboard_name",
            F.lit("dashboard").alias("object_type"),
            F.lit("style").alias("property_type"),
            F.lit("layout").alias("property_name"),
            F.lit("fixed").alias("property_value"),
            F.lit("NoSup").alias("supported_in_ts"),
        )
    )
    rows.append(
        dbs.select(
            "r_name",
            "twb_file_name",
            "dashboard_name",
            F.lit("dashboard property").alias("object_type"),
            F.lit("filter").alias("property_type"),
            F.lit("dashboard filter").alias("property_name"),
            F.lit("Filter_1").alias("property_value"),
            F.lit("Full").alias("supported_in_ts"),
        )
    )
    placed = (
        ocr.filter(F.col("c_mktsegment").isin(PLACED_SEGMENTS))
        .select("r_name", "twb_file_name", F.concat(F.col("r_name"), F.lit("_"), F.col("o_orderstatus")).alias("dashboard_name"), F.concat(F.col("r_name"), F.lit("_"), F.col("c_mktsegment")).alias("worksheet_name"))
        .distinct()
    )
    rows.append(
        placed.select(
            "r_name",
            "twb_file_name",
            "dashboard_name",
            "worksheet_name",
            F.lit("dashboard property").alias("object_type"),
            F.lit("zone-style").alias("property_type"),
            F.lit("height").alias("property_name"),
            F.lit("100").alias("property_value"),
            F.lit("Default").alias("supported_in_ts"),
        )
    )
    # error rows (EX-30) for parts of size 1, workbook by part key
    err = t.part.filter(F.col("p_size") == 1).join(t.region, (F.col("p_partkey") % 5) == F.col("r_regionkey"))
    rows.append(
        err.select(
            "r_name",
            F.concat(F.col("r_name"), F.lit(".twb")).alias("twb_file_name"),
            F.lit("error").alias("object_type"),
            F.concat(F.lit("parse error in "), F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("exec_error_details"),
        ).distinct()
    )

    cols = ["r_name"] + [c for c in DUMP_COLUMNS if c not in RUN_COLS]
    rows = [r.select(*[(F.col(c) if c in r.columns else F.lit(None).cast("string")).alias(c) for c in cols]) for r in rows]
    base = rows[0].union(rows[1]) if len(rows) > 1 else rows[0]
    for r in rows[2:]:
        base = base.union(r)
    runs = []
    for name, mode, start, end in RUNS:
        part = base if name == "run1" else base.filter(F.col("r_name").startswith("A"))
        runs.append(
            part.withColumns(
                {
                    "exec_id": F.md5(F.lit(name)),
                    "exec_mode": F.lit(mode),
                    "exec_status": F.lit("Success"),
                    "exec_start_time": F.to_timestamp(F.lit(start)),
                    "exec_end_time": F.to_timestamp(F.lit(end)),
                    "last_ingested_date": F.to_timestamp(F.lit(end)),
                }
            )
        )
    return conform_dump(runs[0].unionByName(runs[1]))


_MATERIALIZED: dict = {}


def materialized_warehouse(spark, sf_dir: str) -> dict:
    """Dump + warehouse frames for ``sf_dir``.

    The dump is cut from its lineage once with a reliable ``checkpoint()``
    (written to ``spark.checkpoint.dir``, so it survives executor loss) and
    memoized per application; the warehouse tables are lazy DataFrames over
    that written dump."""
    from lodestar.plans import warehouse as W
    from lodestar.session import checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir, tables_stamp(spark, sf_dir))
    if key not in _MATERIALIZED:
        checkpoint_dir(spark)
        dump = derive_dump(spark, sf_dir).hint("rebalance").checkpoint()  # as many partitions as its size asks for
        w = {"raw_data_dump": dump}
        w.update(W.load(dump))
        _MATERIALIZED[key] = w
    return _MATERIALIZED[key]
