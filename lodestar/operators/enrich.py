"""Enrichment joins and classification (MP-01 … MP-15).

Every mapping table is a fixed literal of a few dozen rows, so each lookup is
a broadcast join whose size bound holds by construction; duplicate mapping
keys are resolved before the join (Q9, Q28) so a lookup never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources import mappings as M


def _first_per_key(df: DataFrame, key: str) -> DataFrame:
    """Q28: first matching mapping row wins (file order)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("file_order"))).filter("_rn = 1").drop("_rn", "file_order")


def connector_support(df: DataFrame, connector: str = "connector", kind: str = "ds_type") -> DataFrame:
    """MP-01 left join on lower(name); Live -> target support, else Extract column."""
    m = _first_per_key(M.connectors_map(df.sparkSession), "name_key").select("name_key", "supported_live", "supported_extract")
    j = df.join(F.broadcast(m), F.lower(F.col(connector)) == F.col("name_key"), "left")
    sup = F.when(F.col(kind) == "Live", F.col("supported_live")).otherwise(F.col("supported_extract"))
    return j.withColumn("supported_in_ts", sup).drop("name_key", "supported_live", "supported_extract")


def join_type_target(df: DataFrame, join_type: str = "join_type") -> DataFrame:
    """MP-02 inner -> INNER, left -> LEFT_OUTER, right -> RIGHT_OUTER, full -> OUTER."""
    m = M.joins_map(df.sparkSession).select(F.col("workbook_join").alias("_k"), F.col("target_join"), F.col("supported_live").alias("join_support"))
    return df.join(F.broadcast(m), F.col(join_type) == F.col("_k"), "left").drop("_k")


def data_type_target(df: DataFrame, source_type: str = "data_type", geo_role: str | None = None) -> DataFrame:
    """MP-03 type -> target type (Q9: the base row per type wins; geo rows are
    matched only by an explicit semantic role)."""
    m = M.datatype_map(df.sparkSession)
    base = _first_per_key(m.filter(F.col("geo_config").isNull()), "source_type").select(
        F.col("source_type").alias("_k"), "target_type", "role", "aggregation", F.col("supported").alias("type_support")
    )
    out = df.join(F.broadcast(base), F.col(source_type) == F.col("_k"), "left").drop("_k")
    if geo_role is not None:
        geo = m.filter(F.col("geo_config").isNotNull()).select(F.col("geo_config").alias("_g"), F.col("target_type").alias("geo_target"))
        out = out.join(F.broadcast(geo), F.col(geo_role) == F.col("_g"), "left").withColumn("target_type", F.coalesce("geo_target", "target_type")).drop("_g", "geo_target")
    return out


def mark_support(df: DataFrame, mark: str = "mark") -> DataFrame:
    """MP-04 mark -> support + hint."""
    m = M.chart_map(df.sparkSession).filter(F.col("kind") == "mark").select(F.col("property").alias("_k"), F.col("support").alias("supported_in_ts"), F.col("hint").alias("conversion_in_ts"))
    return df.join(F.broadcast(m), F.col(mark) == F.col("_k"), "left").drop("_k")


def encoding_support(df: DataFrame, channel: str = "channel") -> DataFrame:
    """MP-05 channel -> support + hint."""
    m = M.chart_map(df.sparkSession).filter(F.col("kind") == "encoding").select(F.col("property").alias("_k"), F.col("support").alias("supported_in_ts"), F.col("hint").alias("conversion_in_ts"))
    return df.join(F.broadcast(m), F.col(channel) == F.col("_k"), "left").drop("_k")


def is_measure(field: Column) -> Column:
    """A shelf field is a measure when it carries an aggregation prefix."""
    return ~F.split_part(field, F.lit(":"), F.lit(1)).isin("none", "yr", "mn", "qr", "wk", "dy", "md", "my", "wd", "")


# Axis verdict names and their support (axis rows of the chart map).
AXIS_MISSING = "Missing one axis"
AXIS_TWO_ATTRIBUTES = "Attribute or date field in both axis"
AXIS_TWO_MEASURES = "Measure field in both axis"


def axis_verdict(axes: DataFrame) -> DataFrame:
    """MP-06 per worksheet from the first rows / cols field (min_by position);
    kept in its own column (Q8) instead of overwriting every row's verdict."""
    first = axes.groupBy("path", "worksheet_name").agg(
        F.min_by(F.when(F.col("axis") == "rows", F.col("field")), F.when(F.col("axis") == "rows", F.col("pos"))).alias("row_field"),
        F.min_by(F.when(F.col("axis") == "cols", F.col("field")), F.when(F.col("axis") == "cols", F.col("pos"))).alias("col_field"),
    )
    r, c = F.col("row_field"), F.col("col_field")
    verdict = (
        F.when(r.isNull() | c.isNull(), F.lit(AXIS_MISSING))
        .when(~is_measure(r) & ~is_measure(c), F.lit(AXIS_TWO_ATTRIBUTES))
        .when(is_measure(r) & is_measure(c), F.lit(AXIS_TWO_MEASURES))
        .otherwise(F.lit("Partial"))
    )
    m = M.chart_map(axes.sparkSession).filter(F.col("kind") == "axis").select(F.col("property").alias("axis_verdict"), F.col("support").alias("axis_support"))
    out = first.withColumn("axis_verdict", verdict).join(F.broadcast(m), "axis_verdict", "left")
    return out.withColumn("axis_support", F.coalesce("axis_support", F.lit("Partial")))


GEO_FIELDS = ("Latitude (generated)", "Longitude (generated)")


def geo_override(df: DataFrame, field: str = "field") -> DataFrame:
    """MP-07 generated latitude/longitude -> geo hint."""
    is_geo = F.col(field).isin(list(GEO_FIELDS)) | F.lower(F.col(field)).rlike(r"(latitude|longitude) \(generated\)")
    return df.withColumn("geo_hint", F.when(is_geo, F.lit("Use geo charts to represent the data.")))


def filter_support(df: DataFrame, ds_kind: str = "ds_type") -> DataFrame:
    """MP-08 null-safe match on (class, function, pattern, enumeration)."""
    m = _first_per_key(
        M.filter_feature_map(df.sparkSession).withColumn("_key", F.concat_ws("|", F.coalesce("filter_class", F.lit("~")), F.coalesce("function", F.lit("~")), F.coalesce("pattern_type", F.lit("~")), F.coalesce("enumeration", F.lit("~")))),
        "_key",
    )
    m = m.select(
        F.col("filter_class").alias("m_class"),
        F.col("function").alias("m_function"),
        F.col("pattern_type").alias("m_pattern"),
        F.col("enumeration").alias("m_enum"),
        "supported_extract",
        "supported_live",
        "datasource_hint",
    )
    cond = (
        df["filter_class"].eqNullSafe(m["m_class"])
        & df["function_key"].eqNullSafe(m["m_function"])
        & df["pattern_type"].eqNullSafe(m["m_pattern"])
        & df["enumeration"].eqNullSafe(m["m_enum"])
    )
    j = df.join(F.broadcast(m), cond, "left")
    sup = F.when(F.col(ds_kind) == "Live", F.col("supported_live")).otherwise(F.col("supported_extract"))
    return j.withColumn("supported_in_ts", sup).drop("m_class", "m_function", "m_pattern", "m_enum", "supported_extract", "supported_live")


def dashboard_feature_support(df: DataFrame, key: str = "zone_type") -> DataFrame:
    """MP-09 dashboard property -> support by mapping key."""
    m = _first_per_key(M.dashboard_feature_map(df.sparkSession).filter(F.col("mapping_key").isNotNull()), "mapping_key").select(
        F.col("mapping_key").alias("_k"), F.col("support").alias("supported_in_ts"), F.col("hint").alias("conversion_in_ts")
    )
    return df.join(F.broadcast(m), F.col(key) == F.col("_k"), "left").drop("_k")


def formula_verdict_from_text(converted: Column) -> Column:
    """MP-10 on converted text: TBD -> Partial; None -> NoSup / Default; else Full."""
    return F.when(F.contains(converted, F.lit("TBD")), "Partial").when(F.contains(converted, F.lit("None")), "NoSup").otherwise("Full")


def run_stamp(df: DataFrame, mode: str, start, end, status: str = "Success") -> DataFrame:
    """MP-11 mode, start, end, status, ``exec_id = md5(mode || start || end)``."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return df.withColumns(
        {
            "exec_mode": F.lit(mode),
            "exec_start_time": s,
            "exec_end_time": e,
            "exec_status": F.lit(status),
            "last_ingested_date": e,
            "exec_id": F.md5(F.concat(F.lit(mode), s.cast("string"), e.cast("string"))),
        }
    )


def target_label(ds_type: Column, extract_label: str = M.TARGET_EXTRACT, table_label: str = M.TARGET_TABLE) -> Column:
    """MP-12 extract -> dataset label, else table label."""
    return F.when(ds_type == "Extract", F.lit(extract_label)).otherwise(F.lit(table_label))


def output_stamp(dump: DataFrame, outputs: DataFrame, match=("twb_file_name", "datasource_name"), order_col: str = "row_pos") -> DataFrame:
    """MP-13 write each output's file type/name onto the first matching dump
    row (ranked by ``row_number`` over the match keys)."""
    w = Window.partitionBy(*match).orderBy(order_col)
    ranked = dump.withColumn("_rk", F.row_number().over(w))
    o = outputs.select(*match, F.col("output_file_type").alias("_oft"), F.col("output_file_name").alias("_ofn"), F.lit(1).alias("_rk"))
    j = ranked.join(o, [*match, "_rk"], "left")
    return j.withColumn("output_file_type", F.coalesce("_oft", "output_file_type")).withColumn("output_file_name", F.coalesce("_ofn", "output_file_name")).drop("_oft", "_ofn", "_rk")


def missing_tables(table_rows: DataFrame, column_rows: DataFrame, keys=("path", "table_name")) -> DataFrame:
    """MP-14 table rows for tables known only from their columns (``left_anti``)."""
    known = table_rows.select(*keys).distinct()
    from_cols = column_rows.select(*keys).distinct()
    return from_cols.join(known, list(keys), "left_anti")


def connector_gate(df: DataFrame, allowed: list[str], connector: str = "connector") -> tuple[DataFrame, DataFrame]:
    """MP-15 (accepted, rejected) by an allow-list parameter; rejected rows
    carry an error text instead of stopping the run."""
    ok = F.lower(F.col(connector)).isin([a.lower() for a in allowed])
    rejected = df.filter(~ok | F.col(connector).isNull()).withColumn("exec_error_details", F.concat(F.lit("connector not allowed: "), F.coalesce(F.col(connector), F.lit("NULL"))))
    return df.filter(ok), rejected
