"""Extraction operators (EX-01 … EX-30, IO-04) on the row-derived workbook corpus.

The oracle computes the expected extraction directly from the source rows
(supplier, nation, region, customer, orders), so each query checks the
whole build -> parse -> extract path.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import extract as X
from lodestar.operators import formulas as FC
from lodestar.operators import joins as J
from lodestar.plans.registry import add
from lodestar.session import checkpoint_dir
from lodestar.sources.tables import Tables, tables_stamp
from lodestar.sources.workbooks import BUCKET_SIZE, odd_corpus, workbook_corpus

_PARSED: dict = {}
#: Partitions of the parse that a task of an extractor reads.
PARSED_A_SCAN = 10


def parsed_corpus(spark, sf_dir):
    """Corpus + 'bad' copies (every bucket-0 workbook truncated to 120 chars),
    parsed once and cut from lineage with a reliable checkpoint.

    A document costs the parse milliseconds and an extractor far less, and a dump
    scans the documents forty times: extractors take several of the parse's
    partitions a task, or starting tasks and their shuffle files is most of the work."""
    key = (spark.sparkContext.applicationId, sf_dir, tables_stamp(spark, sf_dir))
    if key not in _PARSED:
        checkpoint_dir(spark)
        bad = F.when(F.col("path").endswith("_0.twb"), F.struct(F.concat(F.col("path"), F.lit(".bad")).alias("path"), F.substring("content", 1, 120).alias("content")))
        docs = workbook_corpus(spark, sf_dir).select(F.inline(F.array_compact(F.array(F.struct("path", "content"), bad))))  # in one pass, not a union
        parsed = X.parse(docs).checkpoint()
        _PARSED[key] = parsed.coalesce(max(spark.sparkContext.defaultParallelism, -(-parsed.rdd.getNumPartitions() // PARSED_A_SCAN)))
    return _PARSED[key]


B = BUCKET_SIZE
DOCS = f"""nat AS (
  SELECT n_nationkey, n_name, r_name, ['Snowflake', 'PostgreSQL', 'Splunk', 'MySQL'][n_nationkey % 4 + 1] AS connector,
         lead(n_name) OVER (PARTITION BY r_name ORDER BY n_nationkey) AS next_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
sup AS (SELECT s.*, n.*, '/corpus/' || r_name || '/' || n_name || '_' || CAST(CAST(floor(s_suppkey / {B}) AS BIGINT) AS VARCHAR) || '.twb' AS path
        FROM supplier s JOIN nat n ON s_nationkey = n.n_nationkey),
docs AS (SELECT DISTINCT path, n_nationkey, n_name, r_name, connector, next_name FROM sup),
segs AS (SELECT d.*, c.c_mktsegment, d.n_name || '_' || c.c_mktsegment AS worksheet_name
         FROM docs d JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c ON c.c_nationkey = d.n_nationkey),
occ AS (SELECT DISTINCT c_nationkey, o_orderpriority, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
dbs AS (SELECT d.*, s.o_orderstatus, d.n_name || '_' || s.o_orderstatus AS dashboard_name
        FROM docs d JOIN (SELECT DISTINCT c_nationkey, o_orderstatus FROM occ) s ON s.c_nationkey = d.n_nationkey),
placed AS (SELECT b.*, p.c_mktsegment, b.n_name || '_' || p.c_mktsegment AS worksheet_name,
                  CASE WHEN p.c_mktsegment = 'AUTOMOBILE' THEN '0' ELSE '500' END AS x
           FROM dbs b JOIN (SELECT DISTINCT c_nationkey, o_orderstatus, c_mktsegment FROM occ WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')) p
           ON p.c_nationkey = b.n_nationkey AND p.o_orderstatus = b.o_orderstatus)"""

# EX-01 precedence: published (sqlproxy) before extract before live
KIND_SQL = "CASE WHEN n_nationkey % 7 = 6 THEN 'Published Datasource' WHEN n_nationkey % 3 = 0 THEN 'Extract' ELSE 'Live' END"
MARK = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bar' WHEN 'BUILDING' THEN 'Line' WHEN 'FURNITURE' THEN 'Text' WHEN 'HOUSEHOLD' THEN 'Circle' ELSE 'Automatic' END"
FORMULA = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SUM([Sales]) / TOTAL(SUM([Sales]))' WHEN 'BUILDING' THEN 'RUNNING_SUM(SUM([Sales]))' "
    "WHEN 'FURNITURE' THEN '([Profit] - LOOKUP([Profit], -1)) / ABS(LOOKUP([Profit], -1))' "
    "WHEN 'HOUSEHOLD' THEN 'IF YEAR([Order Date]) = 2019 THEN [Sales] ELSE 0 END' ELSE 'STDEV([Sales]) / AVG([Sales])' END"
)
CALC_ID = "'[Calculation_' || CAST(n_nationkey AS VARCHAR) || '_' || substr(c_mktsegment, 1, 3)"


def _q(qid, fn, select_sql):
    def run(spark, sf_dir):
        return fn(parsed_corpus(spark, sf_dir))

    add(qid, run, f"WITH {DOCS}\n{select_sql}")


_q(
    "ex01_datasource_kind",
    lambda p: X.datasource_kind(p),
    f"SELECT path, n_name AS datasource_name, {KIND_SQL} AS ds_type, {KIND_SQL} AS proposed_value FROM docs",
)
_q(
    "ex02_connectors",
    lambda p: X.connectors(p),
    "SELECT path, n_name AS datasource_name, 'conn_' || lower(n_name) AS connection_name, lower(connector) AS connector FROM docs",
)
_q(
    "ex03_join_clauses",
    lambda p: X.join_clauses(p),
    "SELECT path, n_name AS datasource_name, ['inner', 'left', 'right', 'full'][n_nationkey % 4 + 1] AS join_type, "
    "'[' || n_name || '].[key]::[' || next_name || '].[key]' AS operands FROM docs WHERE next_name IS NOT NULL",
)
_q(
    "ex04_tables",
    lambda p: X.tables(p),
    "SELECT path, n_name AS datasource_name, CASE WHEN n_nationkey % 7 = 6 THEN 'pub_' || lower(n_name) ELSE 'DB.' || r_name || '.' || n_name END AS table_name, "
    "'conn_' || lower(n_name) AS connection_name FROM docs",
)
_q(
    "ex06_custom_sql",
    lambda p: X.custom_sql(p),
    "SELECT path, n_name AS datasource_name, 'conn_' || lower(n_name) AS connection_name, 'Custom_SQL_' || n_name AS query_name, "
    "'SELECT * FROM ' || n_name AS query, lower(connector) AS connector FROM docs WHERE n_nationkey % 5 = 0",
)
_q(
    "ex08_column_metadata",
    lambda p: X.columns(p),
    "SELECT path, n_name AS datasource_name, n_name AS table_name, s_name AS local_column_name, upper(s_name) AS remote_column_name, "
    "['integer', 'real', 'string', 'date'][s_suppkey % 4 + 1] AS data_type FROM sup",
)
_CALCS = (
    f"SELECT path, n_name AS datasource_name, {CALC_ID} || ']' AS name, 'Calc ' || c_mktsegment AS caption, {FORMULA} AS formula FROM segs "
    f"UNION ALL SELECT path, n_name, {CALC_ID} || '_R]', 'Ratio ' || c_mktsegment, {{ratio}} FROM segs"
)
_q("ex09_calculated_fields", lambda p: X.calculated_fields(p), _CALCS.format(ratio=f"{CALC_ID} || '] / 100'"))
_q("ex10_reference_resolution", lambda p: X.resolve_references(X.calculated_fields(p)), _CALCS.format(ratio="'[Calc ' || c_mktsegment || '] / 100'"))
_q("ex11_chart_marks", lambda p: X.marks(p), f"SELECT path, worksheet_name, {MARK} AS mark FROM segs")
_q(
    "ex12_chart_encodings",
    lambda p: X.encodings(p),
    "SELECT path, worksheet_name, 'color' AS channel, 'none:C_MKTSEGMENT:nk' AS field FROM segs "
    "UNION ALL SELECT path, worksheet_name, 'size', 'sum:C_ACCTBAL:qk' FROM segs",
)
_q(
    "ex13_chart_axes",
    lambda p: X.axes(p),
    "SELECT path, worksheet_name, 'rows' AS axis, 0 AS pos, 'none:N_NAME:nk' AS field FROM segs "
    "UNION ALL SELECT path, worksheet_name, 'rows', 1, 'none:C_NAME:nk' FROM segs "
    "UNION ALL SELECT path, worksheet_name, 'cols', 0, 'sum:C_ACCTBAL:qk' FROM segs",
)
_q(
    "ex16_worksheet_filters",
    lambda p: X.worksheet_filters(p),
    "SELECT path, worksheet_name, 'Filter_1' AS filter_name, n_name AS datasource_name, 'C_MKTSEGMENT' AS column, 'categorical' AS filter_class, "
    "'member' AS function, 'general' AS filter_kind, c_mktsegment AS member, 'exclusive' AS enumeration FROM segs",
)
_q("ex14_chart_datasources", lambda p: X.chart_datasources(p), "SELECT path, worksheet_name, n_name AS datasource_name FROM segs")

_FILTERS = """fl AS (
  SELECT d.path, d.n_name, p.o_orderpriority, CAST(substr(p.o_orderpriority, 1, 1) AS INTEGER) AS dg,
         ['categorical', 'quantitative', 'relative-date'][(d.n_nationkey + CAST(substr(p.o_orderpriority, 1, 1) AS INTEGER)) % 3 + 1] AS cls,
         row_number() OVER (PARTITION BY d.path ORDER BY p.o_orderpriority) AS k
  FROM docs d JOIN (SELECT DISTINCT c_nationkey, o_orderpriority FROM occ) p ON p.c_nationkey = d.n_nationkey)"""


def _filters_sql(select: str) -> str:
    return f",\n{_FILTERS}\n{select}"


def _fq(qid, cols_spark, select):
    def run(spark, sf_dir):
        return X.datasource_filters(parsed_corpus(spark, sf_dir)).select(*cols_spark)

    add(qid, run, f"WITH {DOCS}{_filters_sql(select)}")


_fq(
    "ex15_datasource_filters",
    ["path", "datasource_name", "filter_name", "filter_class", "column", "member", "enumeration"],
    "SELECT path, n_name AS datasource_name, 'Filter_' || CAST(k AS VARCHAR) AS filter_name, cls AS filter_class, "
    "CASE cls WHEN 'categorical' THEN 'O_ORDERPRIORITY' WHEN 'quantitative' THEN 'O_TOTALPRICE' ELSE 'O_ORDERDATE' END AS column, "
    "CASE WHEN cls = 'categorical' THEN o_orderpriority END AS member, CASE WHEN cls = 'categorical' THEN 'inclusive' END AS enumeration FROM fl",
)
_fq(
    "ex17_filter_classifier",
    ["path", "filter_name", "function", "filter_kind"],
    "SELECT path, 'Filter_' || CAST(k AS VARCHAR) AS filter_name, CASE WHEN cls = 'categorical' THEN CASE WHEN dg % 2 = 0 THEN 'except' ELSE 'member' END END AS function, "
    "CASE WHEN cls = 'categorical' THEN 'general' END AS filter_kind FROM fl",
)
_fq(
    "ex19_quantitative_kind",
    ["path", "filter_name", "min", "max", "range_kind"],
    "SELECT path, 'Filter_' || CAST(k AS VARCHAR) AS filter_name, CASE WHEN cls = 'quantitative' THEN CAST(dg * 1000 AS VARCHAR) END AS min, "
    "CASE WHEN cls = 'quantitative' THEN CAST(dg * 2000 AS VARCHAR) END AS max, CASE WHEN cls = 'quantitative' THEN 'between' END AS range_kind FROM fl",
)
_fq(
    "ex20_relative_date_attributes",
    ["path", "filter_name", "period_type", "first_period", "last_period", "anchor", "include_null"],
    "SELECT path, 'Filter_' || CAST(k AS VARCHAR) AS filter_name, CASE WHEN cls = 'relative-date' THEN 'month' END AS period_type, "
    "CASE WHEN cls = 'relative-date' THEN -dg END AS first_period, CASE WHEN cls = 'relative-date' THEN 0 END AS last_period, "
    "CASE WHEN cls = 'relative-date' THEN 'today' END AS anchor, CASE WHEN cls = 'relative-date' THEN 'false' END AS include_null FROM fl",
)


def _ex18(spark, sf_dir):
    # EX-18 on the quantitative filters: the integer members min/1000 .. max/1000
    f = X.datasource_filters(parsed_corpus(spark, sf_dir)).filter(F.col("filter_class") == "quantitative")
    members = X.expand_member_range((F.col("min").cast("int") / 1000).cast("int"), (F.col("max").cast("int") / 1000).cast("int"))
    return f.select("path", "filter_name", F.explode(members).alias("member"))


add(
    "ex18_member_range_expansion",
    _ex18,
    f"WITH {DOCS}{_filters_sql('SELECT path, ' + chr(39) + 'Filter_' + chr(39) + ' || CAST(k AS VARCHAR) AS filter_name, CAST(m AS INTEGER) AS member FROM fl, range(dg, 2 * dg + 1) t(m) WHERE cls = ' + chr(39) + 'quantitative' + chr(39))}",
)

_q("ex21_dashboards", lambda p: X.dashboards(p), "SELECT path, dashboard_name, 'fixed' AS sizing_mode FROM dbs")
_q(
    "ex22_special_zones",
    lambda p: X.special_zones(p),
    "SELECT path, dashboard_name, 'web' AS zone_type, 'Webpage (URL)' AS feature FROM dbs "
    "UNION ALL SELECT path, dashboard_name, 'empty', 'Blank' FROM dbs UNION ALL SELECT path, dashboard_name, 'bitmap', 'Image(As Tile)' FROM dbs",
)
_q(
    "ex23_buttons",
    lambda p: X.buttons(p),
    "SELECT path, dashboard_name, 'Dashboard Navigation' AS button_type, 'Next' AS caption, 'goto' AS action FROM dbs",
)
_ZONES = (
    "SELECT path, dashboard_name, '0' AS x, '0' AS y FROM dbs UNION ALL SELECT path, dashboard_name, '0', '500' FROM dbs "
    "UNION ALL SELECT path, dashboard_name, '200', '500' FROM dbs UNION ALL SELECT path, dashboard_name, '300', '500' FROM dbs "
    "UNION ALL SELECT path, dashboard_name, '900', '0' FROM dbs UNION ALL SELECT path, dashboard_name, x, '100' FROM placed"
)
_q(
    "ex24_containers",
    lambda p: X.containers(p),
    f"SELECT path, dashboard_name, x AS anchor, count(*) AS zones, 'vert' AS orientation FROM ({_ZONES}) GROUP BY path, dashboard_name, x HAVING count(*) > 1 "
    f"UNION ALL SELECT path, dashboard_name, y, count(*), 'horz' FROM ({_ZONES}) GROUP BY path, dashboard_name, y HAVING count(*) > 1",
)
_q("ex25_texts", lambda p: X.texts(p), "SELECT path, dashboard_name, 'Orders ' || o_orderstatus AS text FROM dbs")
_q("ex26_sizing_mode", lambda p: X.dashboards(p).select("path", "dashboard_name", "sizing_mode").filter(F.col("sizing_mode") != "vscroll"), "SELECT path, dashboard_name, 'fixed' AS sizing_mode FROM dbs")
_q(
    "ex27_zone_layout_unpivot",
    lambda p: X.zone_layout(p),
    "SELECT path, dashboard_name, worksheet_name, 'h' AS property_name, '400' AS property_value FROM placed "
    "UNION ALL SELECT path, dashboard_name, worksheet_name, 'w', '500' FROM placed "
    "UNION ALL SELECT path, dashboard_name, worksheet_name, 'x', x FROM placed "
    "UNION ALL SELECT path, dashboard_name, worksheet_name, 'y', '100' FROM placed",
)
_q(
    "ex28_dashboard_filter_numbering",
    lambda p: X.dashboard_filter_numbers(p),
    "SELECT path, dashboard_name, '[O_ORDERPRIORITY]' AS filter_column, 'filter_1' AS filter_name FROM dbs",
)
_q(
    "ex30_error_rows",
    lambda p: X.errors(p),
    "SELECT DISTINCT path || '.bad' AS path, 'error' AS object_type, 'could not parse ' || path || '.bad' AS exec_error_details FROM docs WHERE path LIKE '%\\_0.twb' ESCAPE '\\'",
)

# ------------------------------------------------- documents that an extractor can't evaluate in full
_ODD: dict = {}


def parsed_odd(spark, sf_dir):
    """The odd documents, parsed once."""
    key = (spark.sparkContext.applicationId, sf_dir, tables_stamp(spark, sf_dir))
    if key not in _ODD:
        checkpoint_dir(spark)
        _ODD[key] = X.parse(odd_corpus(spark, sf_dir)).checkpoint()
    return _ODD[key]


ODD = "WITH o AS (SELECT s_suppkey % 6 AS kind, CAST(s_suppkey AS VARCHAR) AS k, '/odd/' || CAST(s_suppkey AS VARCHAR) || '.twb' AS path FROM supplier)"
_NO_RANGE = f" of [A] is not one of up to {X.MAX_RANGE} whole numbers; it has no members"


def _oq(qid, fn, select_sql):
    add(qid, lambda spark, sf_dir: fn(parsed_odd(spark, sf_dir)), f"{ODD}\n{select_sql}")


_oq(
    "ex30_error_channel",
    X.problems,
    f"""SELECT path, 'error' AS object_type, 'filters' AS extractor, 'D' || k AS subject, 'range a..f{_NO_RANGE}' AS exec_error_details FROM o WHERE kind = 0
UNION ALL SELECT path, 'error', 'filters', 'D' || k, 'range #2020-01-01#..#2020-02-01#{_NO_RANGE}' FROM o WHERE kind = 1
UNION ALL SELECT path, 'error', 'filters', 'D' || k, 'period soon of [A] is no whole number' FROM o WHERE kind = 1
UNION ALL SELECT path, 'error', 'datasources', 'D' || k, '2 datasources are called D' || k || '; they are told apart by their place' FROM o WHERE kind = 2
UNION ALL SELECT path, 'error', 'columns', 'D' || k, 'k names 2 items; the first counts' FROM o WHERE kind = 3
UNION ALL SELECT path, 'error', 'columns', 'D' || k, 'a column has no name' FROM o WHERE kind = 4
UNION ALL SELECT path, 'error', 'calculations', 'D' || k, 'a calculation has no name' FROM o WHERE kind = 4
UNION ALL SELECT path, 'error', 'filters', 'D' || k, 'range 1..10000000{_NO_RANGE}' FROM o WHERE kind = 5""",
)
_oq(
    "ex30_error_counts",
    lambda p: X.problems(p).groupBy("extractor").agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("path").alias("documents")),
    """SELECT extractor, sum(n) AS errors, count(*) AS documents FROM (
  SELECT path, CASE WHEN kind IN (0, 1, 5) THEN 'filters' WHEN kind = 2 THEN 'datasources' ELSE 'columns' END AS extractor, CAST(CASE WHEN kind = 1 THEN 2 ELSE 1 END AS BIGINT) AS n FROM o
  UNION ALL SELECT path, 'calculations', 1 FROM o WHERE kind = 4) GROUP BY extractor""".replace("sum(n) AS errors", "CAST(sum(n) AS BIGINT) AS errors"),
)
_oq(
    "ex18_unreadable_ranges",
    lambda p: X.datasource_filters(p).select("path", "filter_name", "filter_class", "column", "member", "first_period", "last_period"),
    """SELECT path, 'Filter_1' AS filter_name, 'categorical' AS filter_class, 'G' AS column, '1,2,3' AS member, CAST(NULL AS INTEGER) AS first_period, CAST(NULL AS INTEGER) AS last_period FROM o
UNION ALL SELECT path, 'Filter_2', 'categorical', 'A', NULL, NULL, NULL FROM o WHERE kind IN (0, 1, 5)
UNION ALL SELECT path, 'Filter_3', 'relative-date', 'A', NULL, NULL, 0 FROM o WHERE kind = 1""",
)
_ODD_CALCS = """SELECT path, '[Calculation_1]' AS name, {first} AS formula FROM o
UNION ALL SELECT path, '[Calculation_2]', {second} FROM o
UNION ALL SELECT path, '[Calculation_1]', 'COUNT([k])' FROM o WHERE kind = 2
UNION ALL SELECT path, '[Calculation_2]', {other} FROM o WHERE kind = 2
UNION ALL SELECT path, NULL, '1' FROM o WHERE kind = 4"""
_oq(
    "ex10_repeated_captions",
    lambda p: X.resolve_references(X.calculated_fields(p, placed=True)).select("path", "name", "formula"),
    _ODD_CALCS.format(first="'SUM([k])'", second="'[First ' || k || '] / 2'", other="'[Other] / 3'"),
)
_oq(
    "p03_repeated_local_names",
    lambda p: FC.rewrite_fields(X.calculated_fields(p, placed=True), X.columns(p, placed=True).drop("datasource_name", "data_type"), X.datasource_kind(p, placed=True).drop("datasource_name"), ("path", "ds_pos")).select("path", "name", "formula"),
    _ODD_CALCS.format(first="'SUM([T' || k || '::k])'", second="'[Calculation_1] / 2'", other="'[Calculation_1] / 3'"),
)
_oq(
    "j14_composite_clauses",
    lambda p: X.clause_nodes(p).select("path", "join_type", F.posexplode(J.clause_comparisons(F.col("nodes"))).alias("pos", "c")).select("path", "join_type", "pos", "c.*"),
    """SELECT path, 'inner' AS join_type, 0 AS pos, '=' AS op, 'T' || k AS left_table, 'k' AS left_column, 'U' AS right_table, 'k' AS right_column FROM o
UNION ALL SELECT path, 'inner', 1, '=', 'T' || k, 'l', 'U', 'l' FROM o
UNION ALL SELECT path, 'inner', 2, '<=', 'U', 'm', 'T' || k, 'm' FROM o""",
)
_oq(
    "ex03_composite_operands",
    X.join_clauses,
    "SELECT path, 'D' || k AS datasource_name, 'inner' AS join_type, 'AND::[T' || k || '].[k]::[U].[k]::AND::[T' || k || '].[l]::[U].[l]::<=::[U].[m]::[T' || k || '].[m]' AS operands FROM o",
)


def _clause_document(how: str, clause: str) -> tuple[str, str]:
    return ("w.twb", f"<workbook><datasources><datasource name='d'><connection class='x'><relation type='join' join='{how}'><clause type='join'>{clause}</clause></relation></connection></datasource></datasources></workbook>")


def _pair(op: str, a: str, b: str) -> str:
    return f"<expression op='{op}'><expression op='{a}'/><expression op='{b}'/></expression>"


def _clause_of(spark, how: str, clause: str) -> list:
    """The nodes of the one clause of a document (metadata: a few rows)."""
    docs = spark.createDataFrame([_clause_document(how, clause)], "path string, content string")
    return X.clause_nodes(X.parse(docs)).first()


def _j06_clause(spark, sf_dir):
    t = Tables(spark, sf_dir)
    late = "<expression op='AND'>" + _pair("=", "[lineitem].[l_orderkey]", "[orders].[o_orderkey]") + _pair("&lt;", "[orders].[o_totalprice]", "[lineitem].[l_extendedprice]") + "</expression>"
    clause = _clause_of(spark, "inner", late)
    joined = J.star_join({"lineitem": t.lineitem.select("l_orderkey", "l_extendedprice"), "orders": t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")}, [J.clause_relationship(clause["nodes"], clause["join_type"])])
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


add("j06_composite_clause_join", _j06_clause, "SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_totalprice < l_extendedprice GROUP BY 1")


def _j06_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = "<expression op='AND'>" + _pair("=", "[customer].[c_nationkey]", "[supplier].[s_nationkey]") + _pair("=", "[supplier].[s_suppkey]", "[customer].[c_custkey]") + "</expression>"
    clause = _clause_of(spark, "left", both)
    joined = J.star_join({"customer": t.customer.select("c_custkey", "c_nationkey"), "supplier": t.supplier.select("s_suppkey", "s_nationkey", "s_name")}, [J.clause_relationship(clause["nodes"], clause["join_type"])])
    return joined.select("c_custkey", "c_nationkey", "s_name")


add("j06_two_key_clause_join", _j06_keys, "SELECT c_custkey, c_nationkey, s_name FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")


# ------------------------------------------------- formulas whose names and literals look like comments and calls
def _token_formulas(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    named = F.concat(F.lit("[Path // "), F.col("s_name"), F.lit("] + DATEADD('day', 1, [x]) // LOOKUP([y], 1)"))
    quoted = F.concat(F.lit('"DATEADD (" + STR([n]) + \'[no] // field\' /* TOTAL([z]) */ + [SUM (q)] + \''), F.col("s_name"), F.lit("'"))
    rows = F.array(F.struct(F.lit("named").alias("name"), named.alias("formula")), F.struct(F.lit("quoted").alias("name"), quoted.alias("formula")))
    return s.select(F.col("s_suppkey").cast("string").alias("path"), F.inline(rows))


_TOKEN = "FROM (SELECT CAST(s_suppkey AS VARCHAR) AS path, s_name FROM supplier)"
add("fc01_calls_outside_names", lambda s, d: FC.function_usage(_token_formulas(s, d)), f"SELECT path, 'named' AS name, 'DATEADD' AS function {_TOKEN} UNION ALL SELECT path, 'quoted', 'STR' {_TOKEN}")
add(
    "fc02_fields_outside_literals",
    lambda s, d: FC.field_usage(_token_formulas(s, d)),
    f"SELECT path, 'named' AS name, 'Path // ' || s_name AS field {_TOKEN} UNION ALL SELECT path, 'named', 'x' {_TOKEN} UNION ALL SELECT path, 'quoted', 'n' {_TOKEN} UNION ALL SELECT path, 'quoted', 'SUM (q)' {_TOKEN}",
)
add("fc03_verdicts_of_tokens", lambda s, d: FC.classify(_token_formulas(s, d)), f"SELECT path, 'named' AS name, 'Partial' AS verdict {_TOKEN} UNION ALL SELECT path, 'quoted', 'Full' {_TOKEN}")
