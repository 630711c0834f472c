"""Workbook sources (IO-01 … IO-04, IO-09) and the row-derived XML corpus.

``scan_workbooks`` reads ``.twb`` files with the ``binaryFile`` source into
``(path, content)``; ``scan_packaged`` opens ``.twbx`` zips inside tasks with
``mapInPandas`` (one zip -> n documents).  ``workbook_corpus`` builds
workbook documents from the driver tables (FIXTURES.md §4) so extraction
results can be checked with plain SQL on the same rows.

Corpus layout: one workbook per (nation, supplier bucket of ``bucket_size``
keys); it holds that nation's datasource with the bucket's metadata records,
its calculated columns, filters, worksheets and dashboards.  Every
``collect_list`` below gathers a group bounded by construction (``bucket_size``
records, five segments, five priorities, three statuses), never a fact group.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import ship_library
from lodestar.sources.dump_fixture import CONNECTORS, COLUMN_TYPES, FILTER_CLASSES, JOIN_KINDS, PLACED_SEGMENTS, SEGMENT_FORMULAS, SEGMENT_MARKS
from lodestar.sources.tables import Tables

BUCKET_SIZE = 50
BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


# ----------------------------------------------------------------- IO scans
def scan_workbooks(spark: SparkSession, folder: str, pattern: str = "*.twb") -> DataFrame:
    """IO-01: every ``.twb`` of a folder (recursively) -> (path, content)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.select("path", F.col("content").cast("string").alias("content"))


def _unzip(batches):
    for pdf in batches:
        out = []
        for path, blob in zip(pdf["path"], pdf["content"]):
            try:
                package = zipfile.ZipFile(io.BytesIO(bytes(blob)))
            except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:  # EX-30: bad package -> error row
                out.append((path, None, f"bad package: {e}"))
                continue
            with package as z:
                for name in (n for n in z.namelist() if n.endswith(".twb")):
                    try:
                        out.append((f"{path}!{name}", z.read(name).decode("utf-8", errors="replace"), None))
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:  # encrypted or corrupt member
                        out.append((f"{path}!{name}", None, f"bad member: {e}"))
        yield pd.DataFrame(out, columns=["path", "content", "error"])


def scan_packaged(spark: SparkSession, folder: str, pattern: str = "*.twbx") -> DataFrame:
    """IO-02: ``.twbx`` packages -> one row per inner ``.twb`` (unzipped in the task;
    nothing is written next to the input)."""
    ship_library(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", "content").mapInPandas(_unzip, "path string, content string, error string")


# ------------------------------------------------------------- corpus builder
def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _map(mapping: dict, key):
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def _wrap(when, head: str, inner, tail: str):
    return F.when(when, F.concat(F.lit(head), inner, F.lit(tail))).otherwise(inner)


def _agg_xml(df: DataFrame, key: str, order, xml_col: str, name: str) -> DataFrame:
    """Concatenate the XML fragments of one bounded group in a stable order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(xml_col)))), lambda s: s[xml_col]), "").alias(name))


#: Documents of a task; in the corpus rows of ``supplier``, which has at most as many.
ROWS_A_TASK = 200


def _spread(docs: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Documents dealt out by path.  Their keys are few bytes, so the stages that build them end in a handful of
    tasks, while a document costs the parse milliseconds: the number of tasks follows the documents instead."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-suppliers.count() // ROWS_A_TASK))
    return docs.repartition(tasks, "path")


def workbook_corpus(spark: SparkSession, sf_dir: str, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    t = Tables(spark, sf_dir)
    nat = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey",
        "n_name",
        "r_name",
        _pick(CONNECTORS, F.col("n_nationkey") % 4).alias("connector"),
        F.lead("n_name").over(Window.partitionBy("r_name").orderBy("n_nationkey")).alias("next_name"),
    )
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))

    # metadata records per supplier, grouped per (nation, bucket)
    sup = t.supplier.select(
        "s_suppkey",
        "s_name",
        "s_nationkey",
        F.floor(F.col("s_suppkey") / bucket_size).alias("bucket"),
        _pick(COLUMN_TYPES, F.col("s_suppkey") % 4).alias("ty"),
    ).join(nat.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    rec = sup.select(
        F.concat_ws("|", "n_nationkey", "bucket").alias("doc_key"),
        "n_nationkey",
        "bucket",
        "s_suppkey",
        F.concat(
            F.lit("<metadata-record class='column'><remote-name>"),
            F.upper("s_name"),
            F.lit("</remote-name><local-name>["),
            F.col("s_name"),
            F.lit("]</local-name><parent-name>["),
            F.col("n_name"),
            F.lit("]</parent-name><local-type>"),
            F.col("ty"),
            F.lit("</local-type></metadata-record>"),
        ).alias("x"),
    )
    docs = rec.groupBy("doc_key", "n_nationkey", "bucket").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "x"))), lambda s: s["x"]), "").alias("records")
    )

    # per-nation fragments: calculated columns, filters, worksheets, dashboards
    seg = t.customer.select("c_nationkey", "c_mktsegment").distinct()
    seg3 = F.substring("c_mktsegment", 1, 3)
    calc_id = F.concat(F.lit("[Calculation_"), F.col("c_nationkey").cast("string"), F.lit("_"), seg3, F.lit("]"))
    calc = seg.select(
        "c_nationkey",
        "c_mktsegment",
        F.concat(
            F.lit("<column caption='Calc "),
            F.col("c_mktsegment"),
            F.lit("' datatype='real' name='"),
            calc_id,
            F.lit("' role='measure'><calculation class='formula' formula=\""),
            _map(SEGMENT_FORMULAS, F.col("c_mktsegment")),
            F.lit("\"/></column><column caption='Ratio "),
            F.col("c_mktsegment"),
            F.lit("' datatype='real' name='[Calculation_"),
            F.col("c_nationkey").cast("string"),
            F.lit("_"),
            seg3,
            F.lit("_R]' role='measure'><calculation class='formula' formula='"),
            calc_id,
            F.lit(" / 100'/></column>"),
        ).alias("x"),
    )
    calc_x = _agg_xml(calc, "c_nationkey", "c_mktsegment", "x", "calcs")

    occ = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority", "o_orderstatus", "c_mktsegment").distinct()
    prio = occ.select("c_nationkey", "o_orderpriority").distinct()
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    fclass = _pick(FILTER_CLASSES, (F.col("c_nationkey") + digit) % 3)
    nested = F.col("c_nationkey") % 3 != 0  # documents of two nations in three have the nested layouts
    fx = prio.select(
        "c_nationkey",
        "o_orderpriority",
        F.when(
            fclass == "categorical",
            F.when(
                digit % 2 == 0,  # "except everything but P": nested, flips to inclusive (EX-17)
                F.concat(
                    F.lit("<filter class='categorical' column='[O_ORDERPRIORITY]'><groupfilter function='except' level='[O_ORDERPRIORITY]'>"),
                    F.lit("<groupfilter function='level-members' level='[O_ORDERPRIORITY]'/>"),
                    F.when(nested, F.lit("<groupfilter function='union'>")).otherwise(F.lit("")),  # a third level
                    F.lit("<groupfilter function='member' level='[O_ORDERPRIORITY]' member='"),
                    F.col("o_orderpriority"),
                    F.lit("' user:ui-enumeration='exclusive'/>"),
                    F.when(nested, F.lit("</groupfilter>")).otherwise(F.lit("")),
                    F.lit("</groupfilter></filter>"),
                ),
            ).otherwise(
                F.concat(
                    F.lit("<filter class='categorical' column='[O_ORDERPRIORITY]'><groupfilter function='member' level='[O_ORDERPRIORITY]' member='"),
                    F.col("o_orderpriority"),
                    F.lit("' user:ui-enumeration='inclusive'/></filter>"),
                )
            ),
        )
        .when(
            fclass == "quantitative",
            F.concat(
                F.lit("<filter class='quantitative' column='[O_TOTALPRICE]' included-values='in-range'><min>"),
                (digit * 1000).cast("string"),
                F.lit("</min><max>"),
                (digit * 2000).cast("string"),
                F.lit("</max></filter>"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("<filter class='relative-date' column='[O_ORDERDATE]' first-period='-"),
                digit.cast("string"),
                F.lit("' include-null='false' last-period='0' period-type='month'/>"),
            )
        )
        .alias("x"),
    )
    filt_x = _agg_xml(fx, "c_nationkey", "o_orderpriority", "x", "filters")

    ws = seg.join(nat.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_nationkey",
        "c_mktsegment",
        F.concat(
            F.lit("<worksheet name='"),
            F.col("n_name"),
            F.lit("_"),
            F.col("c_mktsegment"),
            F.lit("'><table><view><datasources><datasource caption='"),
            F.col("n_name"),
            F.lit("' name='federated."),
            F.lower("n_name"),
            F.lit("'/></datasources><filter class='categorical' column='[federated."),
            F.lower("n_name"),
            F.lit("].[C_MKTSEGMENT]'><groupfilter function='member' level='[C_MKTSEGMENT]' member='"),
            F.col("c_mktsegment"),
            F.lit("' user:ui-enumeration='exclusive'/></filter></view><panes><pane><mark class='"),
            _map(SEGMENT_MARKS, F.col("c_mktsegment")),
            F.lit("'/><encodings><color column='[federated."),
            F.lower("n_name"),
            F.lit("].[none:C_MKTSEGMENT:nk]'/><size column='[federated."),
            F.lower("n_name"),
            F.lit("].[sum:C_ACCTBAL:qk]'/></encodings></pane></panes><rows>([federated."),
            F.lower("n_name"),
            F.lit("].[none:N_NAME:nk] / [federated."),
            F.lower("n_name"),
            F.lit("].[none:C_NAME:nk])</rows><cols>[federated."),
            F.lower("n_name"),
            F.lit("].[sum:C_ACCTBAL:qk]</cols></table></worksheet>"),
        ).alias("x"),
    )
    ws_x = _agg_xml(ws, "c_nationkey", "c_mktsegment", "x", "worksheets")

    st = occ.select("c_nationkey", "o_orderstatus").distinct().join(nat.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = occ.filter(F.col("c_mktsegment").isin(PLACED_SEGMENTS)).select("c_nationkey", "o_orderstatus", "c_mktsegment").distinct()
    pz = placed.join(nat.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("|", "c_nationkey", "o_orderstatus").alias("dkey"),
        "c_mktsegment",
        F.concat(
            F.lit("<zone h='400' id='"),
            F.when(F.col("c_mktsegment") == PLACED_SEGMENTS[0], F.lit("3")).otherwise(F.lit("4")),
            F.lit("' name='"),
            F.col("n_name"),
            F.lit("_"),
            F.col("c_mktsegment"),
            F.lit("' w='500' x='"),
            F.when(F.col("c_mktsegment") == PLACED_SEGMENTS[0], F.lit("0")).otherwise(F.lit("500")),
            F.lit("' y='100'/>"),
        ).alias("x"),
    )
    pz_x = _agg_xml(pz, "dkey", "c_mktsegment", "x", "zones")
    db = st.select(
        "c_nationkey",
        "o_orderstatus",
        F.concat_ws("|", "c_nationkey", "o_orderstatus").alias("dkey"),
        F.concat(
            F.lit("<dashboard name='"),
            F.col("n_name"),
            F.lit("_"),
            F.col("o_orderstatus"),
            F.lit("'><size maxheight='800' maxwidth='1000' sizing-mode='fixed'/><zones>"),
            F.lit("<zone h='100' id='1' type-v2='text' w='1000' x='0' y='0'><formatted-text><run>Orders "),
            F.col("o_orderstatus"),
            F.lit("</run></formatted-text></zone>"),
            F.lit("<zone h='100' id='2' type-v2='web' url='https://example.org/"),
            F.lower("n_name"),
            F.lit("' w='200' x='0' y='500'/><zone h='100' id='5' type-v2='empty' w='100' x='200' y='500'/>"),
            F.lit("<zone h='100' id='6' type-v2='bitmap' param='logo.png' w='100' x='300' y='500'/>"),
            F.lit("<zone h='50' id='7' type-v2='dashboard-object'>"),
            F.when(nested, F.lit("<button action='goto'><caption>Next</caption></button>")).otherwise(F.lit("<button action='goto' caption='Next'/>")),
            F.lit("</zone>"),
            F.lit("<zone h='50' id='8' name='[O_ORDERPRIORITY]' type-v2='filter' w='100' x='900' y='0'/>"),
        ).alias("head"),
    )
    db = db.join(pz_x, "dkey", "left").select("c_nationkey", "o_orderstatus", F.concat(F.col("head"), _wrap(nested, "<zone id='9' type-v2='layout-basic'><zone id='10' type-v2='layout-flow'>", F.coalesce(F.col("zones"), F.lit("")), "</zone></zone>"), F.lit("</zones></dashboard>")).alias("x"))
    db_x = _agg_xml(db, "c_nationkey", "o_orderstatus", "x", "dashboards")

    n = (
        nat.join(calc_x.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "left")
        .join(filt_x.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "left")
        .join(ws_x.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "left")
        .join(db_x.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "left")
    )
    conn = F.concat(F.lit("conn_"), F.lower("n_name"))
    clause = F.concat(
        F.lit("<clause type='join'><expression op='='><expression op='["), F.col("n_name"), F.lit("].[key]'/><expression op='["), F.col("next_name"), F.lit("].[key]'/></expression></clause>")
    )
    join_kind = F.concat(F.lit("join='"), _pick(JOIN_KINDS, F.col("n_nationkey") % 4), F.lit("' type='join'>"))
    joined = F.col("next_name").isNotNull()
    custom = F.when(
        F.col("n_nationkey") % 5 == 0,
        F.concat(F.lit("<relation connection='"), conn, F.lit("' name='Custom_SQL_"), F.col("n_name"), F.lit("' type='text'>SELECT * FROM "), F.col("n_name"), F.lit("</relation>")),
    ).otherwise(F.lit(""))
    extract = F.when(F.col("n_nationkey") % 3 == 0, F.lit("<extract enabled='true'/>")).otherwise(F.lit(""))
    table = F.concat(F.lit("<relation connection='"), conn, F.lit("' name='"), F.col("n_name"), F.lit("' table='[DB].["), F.col("r_name"), F.lit("].["), F.col("n_name"), F.lit("]' type='table'/>"))
    nested_doc = F.col("n_nationkey") % 3 != 0
    legacy, model = (f"_.fcp.ObjectModelEncapsulateLegacy.{x}...relation" for x in ("false", "true"))
    # three layouts of the same relations: side by side, in the legacy wrapper (which is the join itself), in the model wrapper with a nested join
    flat = F.concat(table, F.when(joined, F.concat(F.lit("<relation "), join_kind, clause, F.lit("</relation>"))).otherwise(F.lit("")), custom)
    in_legacy = F.concat(
        F.when(joined, F.concat(F.lit(f"<{legacy} "), join_kind, clause, table, custom, F.lit(f"</{legacy}>")))
        .when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(f"<{legacy} type='collection'>"), table, custom, F.lit(f"</{legacy}>")))
        .otherwise(F.replace(table, F.lit("<relation "), F.lit(f"<{legacy} "))),
        F.lit(f"<{model} type='collection'><relation name='ignored' table='[DB].[X].[ignored]' type='table'/></{model}>"),
    )
    in_model = F.concat(F.lit(f"<{model} type='collection'>"), F.when(joined, F.concat(F.lit("<relation "), join_kind, clause, table, custom, F.lit("</relation>"))).otherwise(F.concat(table, custom)), F.lit(f"</{model}>"))
    relations = F.when(F.col("n_nationkey") % 3 == 0, flat).when(F.col("n_nationkey") % 3 == 1, in_legacy).otherwise(in_model)
    head = F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8' ?><workbook><datasources><datasource caption='"),
        F.col("n_name"),
        F.lit("' name='federated."),
        F.lower("n_name"),
        F.lit("'><connection class='"),
        F.when(F.col("n_nationkey") % 7 == 6, F.lit("sqlproxy")).otherwise(F.lit("federated")),
        F.lit("' dbname='pub_"),
        F.lower("n_name"),
        F.lit("'><named-connections><named-connection caption='host' name='"),
        conn,
        F.lit("'><connection class='"),
        F.lower("connector"),
        F.lit("' dbname='DB'/></named-connection></named-connections>"),
        relations,
        F.when(nested_doc, F.lit("")).otherwise(F.lit("</connection>")),
        extract,
    )
    nation_parts = n.select(
        "n_nationkey",
        "n_name",
        "r_name",
        head.alias("head"),
        F.coalesce("calcs", F.lit("")).alias("calcs"),
        F.coalesce("filters", F.lit("")).alias("filters"),
        F.coalesce("worksheets", F.lit("")).alias("worksheets"),
        F.coalesce("dashboards", F.lit("")).alias("dashboards"),
    )
    out = docs.join(nation_parts, "n_nationkey").select(
        F.concat(F.lit("/corpus/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("_"), F.col("bucket").cast("string"), F.lit(".twb")).alias("path"),
        F.concat(
            F.col("head"),
            F.lit("<metadata-records>"),
            F.col("records"),
            F.lit("</metadata-records>"),
            F.when(F.col("n_nationkey") % 3 != 0, F.lit("</connection>")).otherwise(F.lit("")),  # there the records belong to the connection
            F.col("calcs"),
            F.col("filters"),
            F.lit("</datasource></datasources><worksheets>"),
            F.col("worksheets"),
            F.lit("</worksheets><dashboards>"),
            F.col("dashboards"),
            F.lit("</dashboards></workbook>"),
        ).alias("content"),
    )
    return _spread(out, t.supplier)


def odd_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per supplier with what an extractor can't evaluate, by the supplier's key modulo 6: a range of texts,
    one of dates and a period that is no number, two datasources of one caption, a repeated local name, items without
    a name, a range of ten million.  Each also has a readable filter, calculations and a join on a clause tree."""
    key = F.col("s_suppkey").cast("string")
    is_kind = lambda k, xml: F.when(F.col("s_suppkey") % 6 == k, F.concat(*xml)).otherwise(F.lit(""))
    lit = F.lit

    def pair(op, *operands):
        return [lit(f"<expression op='{op}'>"), *[x for o in operands for x in (lit("<expression op='"), *o, lit("'/>"))], lit("</expression>")]

    def calc(name, caption, formula):
        return [lit(f"<column {name} caption='"), *caption, lit("'><calculation class='formula' formula='"), lit(formula), lit("'/></column>")]

    def record(local, remote, parent):
        return [lit(f"<metadata-record class='column'><remote-name>{remote}</remote-name>{local}<parent-name>["), *parent, lit("]</parent-name><local-type>string</local-type></metadata-record>")]

    def ranged(lo, hi):
        return lit(f"<filter class='categorical' column='[A]'><groupfilter function='range' from='{lo}' to='{hi}'/></filter>")

    mine = lambda column: [lit("[T"), key, lit(f"].[{column}]")]
    other = lambda column: [lit(f"[U].[{column}]")]
    inner = [lit("<expression op='AND'>"), *pair("=", mine("l"), other("l")), *pair("&lt;=", other("m"), mine("m")), lit("</expression>")]
    clause = [lit("<relation join='inner' type='join'><clause type='join'><expression op='AND'>"), *pair("=", mine("k"), other("k")), *inner, lit("</expression></clause></relation>")]
    content = F.concat(
        lit("<?xml version='1.0' encoding='utf-8' ?><workbook><datasources><datasource caption='D"), key, lit("' name='n"), key, lit("'><connection class='federated'>"),
        *clause,
        lit("</connection><metadata-records>"),
        *record("<local-name>[k]</local-name>", "R", [lit("T"), key]),
        is_kind(3, record("<local-name>[k]</local-name>", "S", [lit("V")])),
        is_kind(4, record("", "S", [lit("V")])),
        lit("</metadata-records>"),
        *calc("name='[Calculation_1]'", [lit("First "), key], "SUM([k])"),
        *calc("name='[Calculation_2]'", [lit("Ratio")], "[Calculation_1] / 2"),
        is_kind(4, calc("", [lit("Nameless")], "1")),
        lit("<filter class='categorical' column='[G]'><groupfilter function='range' from='1' to='3'/></filter>"),
        is_kind(0, [ranged("a", "f")]),
        is_kind(1, [ranged("#2020-01-01#", "#2020-02-01#"), lit("<filter class='relative-date' column='[A]' first-period='soon' last-period='0' period-type='month'/>")]),
        is_kind(5, [ranged(1, 10_000_000)]),
        lit("</datasource>"),
        is_kind(2, [lit("<datasource caption='D"), key, lit("' name='m"), key, lit("'>"), *calc("name='[Calculation_1]'", [lit("Other")], "COUNT([k])"), *calc("name='[Calculation_2]'", [lit("Ratio")], "[Calculation_1] / 3"), lit("</datasource>")]),
        lit("</datasources></workbook>"),
    )
    supplier = Tables(spark, sf_dir).supplier
    return _spread(supplier.select(F.concat(lit("/odd/"), key, lit(".twb")).alias("path"), content.alias("content")), supplier)


# path of a corpus document in the oracle SQL
CORPUS_PATH_SQL = "'/corpus/' || r_name || '/' || n_name || '_' || CAST(CAST(floor(s_suppkey / {b}) AS BIGINT) AS VARCHAR) || '.twb'"
