"""EX-29: the property dump from extraction.

Every extractor's rows become entity-attribute-value rows with the lookups'
verdicts, and the union is the dump that ``warehouse.load`` reads.  All parts are
projections of the same parsed documents; cut ``parsed`` (checkpoint, or persist
in a micro-batch) before, so that documents are parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import enrich as E
from lodestar.operators import extract as X
from lodestar.operators import formulas as FC
from lodestar.plans.warehouse import DUMP_COLUMNS, conform_dump

_COLUMNS = ["path", *[c for c in DUMP_COLUMNS if not c.startswith("exec_") or c == "exec_error_details"]]


def _rows(df: DataFrame, object_type: str, **values: Column | str) -> DataFrame:
    """Dump rows of one kind; columns not named are NULL."""
    values = {"object_type": F.lit(object_type)} | {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()}
    return df.select(*[(F.col("path") if c == "path" else values.get(c, F.lit(None))).cast("string").alias(c) for c in _COLUMNS])


def extracted_rows(parsed: DataFrame) -> DataFrame:
    """The dump rows of parsed documents, with ``path``, without the run's columns."""
    lit = F.lit
    kind = X.datasource_kind(parsed)
    kinds = kind.select("path", "datasource_name", "ds_type")
    with_kind = lambda df: df.join(kinds, ["path", "datasource_name"], "left")
    connectors = X.connectors(parsed)
    tag = F.concat(lit('<connection class="'), F.lower("connector"), lit('"/>'))
    parts = [
        _rows(kind, "datasource property", datasource_name="datasource_name", property_type=lit("ds_type"), property_name=lit("connection"), property_value="ds_type", proposed_value="proposed_value", supported_in_ts=lit("Full")),
        _rows(E.connector_support(with_kind(connectors)), "datasource property", datasource_name="datasource_name", property_type=lit("named_connection"), property_name=lit("connector"), property_value="connector", supported_in_ts="supported_in_ts"),
        _rows(E.join_type_target(X.join_clauses(parsed)), "datasource property", datasource_name="datasource_name", property_type=lit("join"), property_name="join_type", property_value="operands", supported_in_ts="join_support", conversion_in_ts="target_join"),
    ]
    # the warehouse tells a qualified name by its brackets
    bracketed = F.when(F.col("table_name").like("%.%.%"), F.concat(lit("["), F.replace("table_name", lit("."), lit("].[")), lit("]"))).otherwise(F.col("table_name"))
    # tables of each named connection, custom SQL with its own
    tables = with_kind(X.tables(parsed)).join(connectors.select("path", "datasource_name", "connection_name", "connector"), ["path", "datasource_name", "connection_name"], "left")
    parts.append(_rows(tables, "table", datasource_name="datasource_name", table_name=bracketed, property_type=lit("connection tag"), property_value=F.coalesce(tag, lit("")), conversion_in_ts=E.target_label(F.col("ds_type"))))
    queries = with_kind(X.custom_sql(parsed))
    parts.append(_rows(queries, "custom sql query", datasource_name="datasource_name", table_name="query_name", property_type=lit("text"), property_name=lit("query"), property_value="query", conversion_in_ts=E.target_label(F.col("ds_type"))))
    parts.append(_rows(queries, "custom sql query", datasource_name="datasource_name", table_name="query_name", property_type=lit("connection tag"), property_value=tag))
    columns = E.data_type_target(X.columns(parsed))
    parts.append(
        _rows(
            columns, "column", datasource_name="datasource_name", table_name="table_name", remote_column_name="remote_column_name", local_column_name="local_column_name",
            property_type=lit("metadata-record"), property_name=lit("data type"), property_value="data_type", supported_in_ts="type_support", conversion_in_ts="target_type",
        )
    )
    calcs = X.resolve_references(X.calculated_fields(parsed, placed=True))
    verdicts = FC.classify(calcs, ("path", "datasource_name", "name"))
    calcs = calcs.join(verdicts, ["path", "datasource_name", "name"], "left")
    parts.append(_rows(calcs, "column", datasource_name="datasource_name", property_type=lit("calculated_column"), property_name="caption", property_value="formula", supported_in_ts="verdict", conversion_in_ts=FC.rename_functions(F.col("formula"))))
    for rows, object_type, owner in ((X.datasource_filters(parsed), "datasource property", {}), (X.worksheet_filters(parsed), "chart property", {"worksheet_name": "worksheet_name"})):
        for name, value in (("class", "filter_class"), ("column", "column"), ("function", "filter_kind"), ("user:ui-enumeration", "enumeration"), ("member", "member")):
            parts.append(_rows(rows.filter(F.col(value).isNotNull()), object_type, datasource_name="datasource_name", property_type="filter_name", property_name=lit(name), property_value=value, **owner))
    parts.append(_rows(E.mark_support(X.marks(parsed)), "chart", worksheet_name="worksheet_name", property_type=lit("chart type"), property_name=lit("mark"), property_value="mark", supported_in_ts="supported_in_ts", conversion_in_ts="conversion_in_ts"))
    parts.append(_rows(E.encoding_support(X.encodings(parsed)), "chart property", worksheet_name="worksheet_name", property_type=lit("encoding"), property_name="channel", property_value="field", supported_in_ts="supported_in_ts", conversion_in_ts="conversion_in_ts"))
    parts.append(_rows(X.axes(parsed), "chart property", worksheet_name="worksheet_name", property_type=lit("axis"), property_name="axis", property_value="field"))
    parts.append(_rows(X.chart_datasources(parsed), "chart property", worksheet_name="worksheet_name", datasource_name="datasource_name", property_type=lit("datasource"), property_name=lit("name"), property_value="datasource_name"))
    board = {"dashboard_name": "dashboard_name"}
    parts.append(_rows(X.dashboards(parsed), "dashboard", property_type=lit("style"), property_name=lit("layout"), property_value="sizing_mode", **board))
    parts.append(_rows(E.dashboard_feature_support(X.special_zones(parsed)), "dashboard property", property_type="feature", property_name="zone_type", property_value="feature", supported_in_ts="supported_in_ts", conversion_in_ts="conversion_in_ts", **board))
    parts.append(_rows(X.buttons(parsed), "dashboard property", property_type="button_type", property_name=lit("button"), property_value="caption", **board))
    parts.append(_rows(X.containers(parsed), "dashboard property", property_type=lit("container"), property_name="orientation", property_value="anchor", **board))
    parts.append(_rows(X.texts(parsed), "dashboard property", property_type=lit("text"), property_name=lit("text"), property_value="text", **board))
    parts.append(_rows(X.zone_layout(parsed), "dashboard property", worksheet_name="worksheet_name", property_type=lit("zone"), property_name="property_name", property_value="property_value", **board))
    parts.append(_rows(X.dashboard_filter_numbers(parsed), "dashboard property", property_type="filter_name", property_name=lit("dashboard filter"), property_value="filter_column", **board))
    parts.append(_rows(X.problems(parsed), "error", property_name="extractor", property_value="subject", exec_error_details="exec_error_details"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("twb_file_name", F.substring_index("path", "/", -1))


def property_dump(parsed: DataFrame, mode: str, start, end, status: str = "Success") -> DataFrame:
    """The dump of one run, in the warehouse's columns."""
    return conform_dump(E.run_stamp(extracted_rows(parsed), mode, start, end, status))
