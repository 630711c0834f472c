"""Extraction: workbook XML corpus -> property rows (EX-01 … EX-30).

Each workbook is parsed once, JVM-side, with ``from_xml`` against an explicit
schema (repeated elements declared as arrays; attributes carry the ``_``
prefix, element text is ``_VALUE``), then every extractor is an ``explode``
and projection of that struct — a narrow, per-document job with no shuffle
except where a distinct/numbering is part of the semantics.  Malformed
documents parse to NULL (PERMISSIVE) and are routed to error rows (EX-30)
instead of failing the job.  Values that an extractor can't evaluate (a range of
texts, a period that is no number) and names that aren't unique or missing give
typed error rows too (``problems``); all other rows of the document stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.layout import flatten_documents

_CHANNELS = ["color", "size", "text", "tooltip", "lod", "shape", "path", "angle", "geometry"]
_CH = ", ".join(f"{c}: ARRAY<STRUCT<_column: STRING>>" for c in _CHANNELS)
_GF_FIELDS = ["_function", "_level", "_member", "_from", "_to", "_end", "_count", "_expression", "_user:ui-enumeration", "_user:ui-pattern_type", "_user:ui-pattern_text"]
_GF_LEAF = ", ".join(f"`{f}`: STRING" for f in _GF_FIELDS)

WORKBOOK_SCHEMA = (
    "datasources STRUCT<datasource: ARRAY<STRUCT<"
    "_caption: STRING, _name: STRING, `_unread-relations`: STRING, "
    "connection: STRUCT<_class: STRING, _dbname: STRING, "
    "`named-connections`: STRUCT<`named-connection`: ARRAY<STRUCT<_caption: STRING, _name: STRING, connection: STRUCT<_class: STRING, _dbname: STRING>>>>, "
    "relation: ARRAY<STRUCT<_VALUE: STRING, _connection: STRING, _name: STRING, _table: STRING, _type: STRING, _join: STRING, "
    "clause: STRUCT<_type: STRING, expression: STRUCT<_op: STRING, _n: STRING, expression: ARRAY<STRUCT<_op: STRING, _n: STRING, _parent: STRING>>>>>>>, "
    "extract: STRUCT<_enabled: STRING>, "
    "`metadata-records`: STRUCT<`metadata-record`: ARRAY<STRUCT<_class: STRING, `remote-name`: STRING, `local-name`: STRING, `parent-name`: STRING, `local-type`: STRING>>>, "
    "column: ARRAY<STRUCT<_caption: STRING, _name: STRING, _datatype: STRING, _role: STRING, `_param-domain-type`: STRING, calculation: STRUCT<_class: STRING, _formula: STRING>>>, "
    "filter: ARRAY<STRUCT<_class: STRING, _column: STRING, `_included-values`: STRING, `_first-period`: STRING, `_last-period`: STRING, `_period-type`: STRING, "
    "`_include-null`: STRING, `_include-future`: STRING, `_anchor-date`: STRING, min: STRING, max: STRING, "
    f"groupfilter: STRUCT<{_GF_LEAF}, groupfilter: ARRAY<STRUCT<{_GF_LEAF}>>>>>"
    ">>>, "
    "worksheets STRUCT<worksheet: ARRAY<STRUCT<_name: STRING, table: STRUCT<"
    "view: STRUCT<datasources: STRUCT<datasource: ARRAY<STRUCT<_caption: STRING, _name: STRING>>>, "
    "filter: ARRAY<STRUCT<_class: STRING, _column: STRING, min: STRING, max: STRING, "
    f"groupfilter: STRUCT<{_GF_LEAF}, groupfilter: ARRAY<STRUCT<{_GF_LEAF}>>>>>>, "
    f"panes: STRUCT<pane: ARRAY<STRUCT<mark: STRUCT<_class: STRING>, encodings: STRUCT<{_CH}>>>>, "
    "rows: STRING, cols: STRING>>>>, "
    "dashboards STRUCT<dashboard: ARRAY<STRUCT<_name: STRING, "
    "size: STRUCT<_maxheight: STRING, _maxwidth: STRING, _minheight: STRING, _minwidth: STRING, `_sizing-mode`: STRING>, "
    "zones: STRUCT<zone: ARRAY<STRUCT<_id: STRING, _name: STRING, `_type-v2`: STRING, _h: STRING, _w: STRING, _x: STRING, _y: STRING, "
    "_url: STRING, _param: STRING, `formatted-text`: STRUCT<run: ARRAY<STRING>>, button: STRUCT<_action: STRING, _caption: STRING>>>>>>>"
)


def parse(docs: DataFrame) -> DataFrame:
    """IO-04: (path, content) -> (path, wb struct); NULL wb for malformed text.

    Documents of any layout are first rewritten to the flat one (``layout``)."""
    return flatten_documents(docs).select("path", F.from_xml(F.col("content"), WORKBOOK_SCHEMA, {"mode": "PERMISSIVE"}).alias("wb"), "content")


def errors(parsed: DataFrame) -> DataFrame:
    """EX-30: documents that did not parse, or hold relations that are not read, become error rows."""
    bad = parsed.filter(F.col("wb").isNull() | F.col("content").isNull() | F.col("wb.datasources").isNull())
    unread = parsed.filter(F.exists("wb.datasources.datasource", lambda d: d["_unread-relations"].isNotNull()))
    say = lambda df, what: df.select("path", F.lit("error").alias("object_type"), F.concat(F.lit(what), F.col("path")).alias("exec_error_details"))
    return say(bad, "could not parse ").unionByName(say(unread, "unread relations in "))


def problems(parsed: DataFrame) -> DataFrame:
    """EX-30 the error channel: path, object_type, extractor, subject, exec_error_details.

    Documents that can't be read, and of the others each value or name that an
    extractor left out, with the rule by which the rest was read.
    """
    said = lambda df, extractor, subject, text: df.select("path", F.lit("error").alias("object_type"), F.lit(extractor).alias("extractor"), subject.alias("subject"), text.alias("exec_error_details"))
    found = [errors(parsed).select("path", "object_type", F.lit("parse").alias("extractor"), F.lit(None).cast("string").alias("subject"), "exec_error_details")]
    ds = datasources(parsed)
    called = ds.select("path", F.col("ds._caption").alias("item")).groupBy("path", "item").count().filter("item IS NULL OR count > 1")
    text = F.concat(F.col("count").cast("string"), F.lit(" datasources are called "), F.col("item"), F.lit("; they are told apart by their place"))
    found.append(said(called, "datasources", F.col("item"), F.coalesce(text, F.lit("a datasource has neither caption nor name"))))
    for extractor, rows, name, what in (("calculations", calculated_fields(parsed, placed=True), "name", "a calculation"), ("columns", columns(parsed, placed=True), "local_column_name", "a column")):
        names = rows.groupBy("path", "ds_pos", "datasource_name", F.col(name).alias("item")).count().filter("item IS NULL OR count > 1")
        text = F.concat(F.col("item"), F.lit(" names "), F.col("count").cast("string"), F.lit(" items; the first counts"))
        found.append(said(names, extractor, F.col("datasource_name"), F.coalesce(text, F.lit(f"{what} has no name"))))
    owned = ds.select("path", F.col("ds._caption").alias("owner"), F.explode("ds.filter").alias("f")).select("path", "owner", F.col("f._column").alias("column"), F.col("f.groupfilter").alias("g"), F.array("f.`_first-period`", "f.`_last-period`").alias("periods"))
    sheets = _worksheets(parsed).select("path", F.col("ws._name").alias("owner"), F.explode("ws.table.view.filter").alias("f")).select("path", "owner", F.col("f._column").alias("column"), F.col("f.groupfilter").alias("g"), F.array().cast("array<string>"))
    of = F.concat(F.lit(" of "), F.coalesce("column", F.lit("a filter")))
    ranges = F.transform(group_filter_semantics(F.col("g"))["unread_ranges"], lambda r: F.concat(F.lit("range "), r, of, F.lit(f" is not one of up to {MAX_RANGE} whole numbers; it has no members")))
    odd = F.filter("periods", lambda p: p.isNotNull() & p.try_cast("int").isNull())
    periods = F.transform(odd, lambda p: F.concat(F.lit("period "), p, of, F.lit(" is no whole number")))
    told = owned.union(sheets).select("path", "owner", F.explode(F.concat(F.coalesce(ranges, F.array().cast("array<string>")), periods)).alias("text"))
    found.append(said(told, "filters", F.col("owner"), F.col("text")))
    return reduce(DataFrame.unionByName, found)


def datasources(parsed: DataFrame) -> DataFrame:
    """The datasources of each document, with their place: captions need not be unique."""
    return parsed.select("path", F.posexplode("wb.datasources.datasource").alias("ds_pos", "ds"))


def _unplaced(df: DataFrame, placed: bool) -> DataFrame:
    """Without the places of datasource and item, unless they are wanted."""
    return df if placed else df.drop("ds_pos", "pos")


def datasource_kind(parsed: DataFrame, live_flag: bool = False, placed: bool = False) -> DataFrame:
    """EX-01 Published Datasource (sqlproxy) / Extract / Live; ``live_flag``
    proposes Live for extracts."""
    ds = datasources(parsed)
    kind = (
        F.when(F.col("ds.connection._class") == "sqlproxy", F.lit("Published Datasource"))
        .when(F.col("ds.extract._enabled") == "true", F.lit("Extract"))
        .otherwise(F.lit("Live"))
    )
    proposed = F.when(F.lit(live_flag) & (kind == "Extract"), F.lit("Live")).otherwise(kind)
    return _unplaced(ds.select("path", "ds_pos", F.col("ds._caption").alias("datasource_name"), kind.alias("ds_type"), proposed.alias("proposed_value")), placed)


def connectors(parsed: DataFrame) -> DataFrame:
    """EX-02 one row per named connection, value = its class."""
    ds = datasources(parsed)
    nc = ds.select("path", F.col("ds._caption").alias("datasource_name"), F.explode("ds.connection.`named-connections`.`named-connection`").alias("nc"))
    return nc.select("path", "datasource_name", F.col("nc._name").alias("connection_name"), F.col("nc.connection._class").alias("connector"))


def _relations(parsed: DataFrame) -> DataFrame:
    ds = datasources(parsed)
    return ds.select("path", F.col("ds._caption").alias("datasource_name"), F.explode("ds.connection.relation").alias("rel"))


def join_clauses(parsed: DataFrame) -> DataFrame:
    """EX-03 one row per join clause: type and ``a::b`` operands ('=' dropped) of
    expressions at any depth; other operators (``AND``, ``<``) stay, in document order."""
    r = _relations(parsed).filter(F.col("rel._type") == "join")
    outer = F.col("rel.clause.expression")
    ops = F.filter(F.concat(F.array(outer["_op"]), F.transform(outer["expression"], lambda e: e["_op"])), lambda o: o != "=")
    return r.select("path", "datasource_name", F.col("rel._join").alias("join_type"), F.array_join(ops, "::").alias("operands"))


def clause_nodes(parsed: DataFrame) -> DataFrame:
    """EX-03 the join clauses as trees: path, datasource_name, relation (its place), join_type and nodes, an array of
    (n, op, parent) in document order; the outer expression has number 0 and no parent."""
    ds = datasources(parsed).select("path", F.col("ds._caption").alias("datasource_name"), F.posexplode("ds.connection.relation").alias("relation", "rel"))
    outer = F.col("rel.clause.expression")
    node = lambda n, op, parent: F.struct(n.cast("int").alias("n"), op.alias("op"), parent.cast("int").alias("parent"))
    first = F.array(node(outer["_n"], outer["_op"], F.lit(None)))
    others = F.coalesce(F.transform(outer["expression"], lambda e: node(e["_n"], e["_op"], e["_parent"])), F.array().cast("array<struct<n:int,op:string,parent:int>>"))
    joins = ds.filter((F.col("rel._type") == "join") & outer.isNotNull())
    return joins.select("path", "datasource_name", "relation", F.col("rel._join").alias("join_type"), F.concat(first, others).alias("nodes"))


def tables(parsed: DataFrame) -> DataFrame:
    """EX-04 relations with a table; brackets stripped.  EX-05: a ``sqlproxy``
    datasource takes the connection's db name as its table."""
    ds = datasources(parsed)
    r = ds.select("path", F.col("ds._caption").alias("datasource_name"), F.col("ds.connection._class").alias("cls"), F.col("ds.connection._dbname").alias("db"), F.explode("ds.connection.relation").alias("rel"))
    r = r.filter(F.col("rel._table").isNotNull())
    name = F.when(F.col("cls") == "sqlproxy", F.coalesce(F.col("db"), F.col("rel._name"))).otherwise(F.translate(F.col("rel._table"), "[]", ""))
    return r.select("path", "datasource_name", name.alias("table_name"), F.col("rel._connection").alias("connection_name"))


def custom_sql(parsed: DataFrame) -> DataFrame:
    """EX-06 query text + the class of its named connection (joined by name)."""
    r = _relations(parsed).filter(F.col("rel._type") == "text")
    q = r.select("path", "datasource_name", F.col("rel._name").alias("query_name"), F.trim(F.col("rel._VALUE")).alias("query"), F.col("rel._connection").alias("connection_name"))
    c = connectors(parsed).select("path", "datasource_name", "connection_name", "connector")
    return q.join(c, ["path", "datasource_name", "connection_name"], "left")


def columns(parsed: DataFrame, placed: bool = False) -> DataFrame:
    """EX-08 column metadata: table, local name, remote name, type."""
    ds = datasources(parsed)
    m = ds.select("path", "ds_pos", F.col("ds._caption").alias("datasource_name"), F.posexplode("ds.`metadata-records`.`metadata-record`").alias("pos", "m")).filter(F.col("m._class") == "column")
    strip = lambda c: F.regexp_replace(c, r"^\[|\]$", "")
    found = m.select(
        "path",
        "ds_pos",
        "pos",
        "datasource_name",
        strip(F.col("m.`parent-name`")).alias("table_name"),
        strip(F.col("m.`local-name`")).alias("local_column_name"),
        F.col("m.`remote-name`").alias("remote_column_name"),
        F.col("m.`local-type`").alias("data_type"),
    )
    return _unplaced(found, placed)


def calculated_fields(parsed: DataFrame, placed: bool = False) -> DataFrame:
    """EX-09 calculated fields; parameters (list/range domains) skipped."""
    ds = datasources(parsed)
    c = ds.select("path", "ds_pos", F.col("ds._caption").alias("datasource_name"), F.posexplode("ds.column").alias("pos", "c"))
    c = c.filter(F.col("c.calculation").isNotNull() & (F.col("c.`_param-domain-type`").isNull() | ~F.col("c.`_param-domain-type`").isin("list", "range")))
    found = c.select("path", "ds_pos", "pos", "datasource_name", F.col("c._name").alias("name"), F.col("c._caption").alias("caption"), F.col("c.calculation._formula").alias("formula"))
    return _unplaced(found, placed)


def first_map(df: DataFrame, keys: list[str], name: str, value: Column, name_of_map: str) -> DataFrame:
    """(keys..., map name -> value) of each group; of a repeated name the first by ``pos`` (by value, where there is
    no place) counts, rows without a name or a value don't."""
    named = df.select(*keys, F.col(name).alias("_name"), value.alias("_value"), (F.col("pos") if "pos" in df.columns else F.lit(0)).alias("_pos")).filter("_name IS NOT NULL AND _value IS NOT NULL")
    once = named.groupBy(*keys, "_name").agg(F.min(F.struct("_pos", "_value")).alias("_first"))
    return once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_name", F.col("_first._value")))).alias(name_of_map))


def with_map(df: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its group's map, null where the group has none; null keys match null keys."""
    other = maps.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in maps.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def resolve_references(calcs: DataFrame) -> DataFrame:
    """EX-10 replace ``[Calculation_…]`` ids by ``[caption]``.

    The id -> caption map is built per datasource (bounded by its column
    count) and applied with a higher-order ``aggregate`` over the ids found in
    each formula.  Placed calculations (``calculated_fields(placed=True)``) are told
    apart by their datasource's place, so datasources of one caption don't mix; of a
    repeated id the first counts (``problems`` reports it)."""
    keys = ["path", "ds_pos"] if "ds_pos" in calcs.columns else ["path", "datasource_name"]
    j = with_map(calcs, first_map(calcs, keys, "name", F.col("caption"), "ids"), keys)
    found = F.array_distinct(F.regexp_extract_all(F.col("formula"), F.lit(r"(\[Calculation_[^\]]*\])"), 1))
    resolved = F.aggregate(
        found,
        F.col("formula"),
        lambda acc, k: F.when(F.element_at(F.col("ids"), k).isNotNull(), F.replace(acc, k, F.concat(F.lit("["), F.element_at(F.col("ids"), k), F.lit("]")))).otherwise(acc),
    )
    return j.select("path", "datasource_name", "name", "caption", F.when(F.col("ids").isNull(), F.col("formula")).otherwise(resolved).alias("formula"))


def _worksheets(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("wb.worksheets.worksheet").alias("ws"))


def marks(parsed: DataFrame) -> DataFrame:
    """EX-11 mark class per pane."""
    p = _worksheets(parsed).select("path", F.col("ws._name").alias("worksheet_name"), F.explode("ws.table.panes.pane").alias("pane"))
    return p.select("path", "worksheet_name", F.col("pane.mark._class").alias("mark"))


FIELD_PATTERN = r"\.\[(.*?)\]"


def encodings(parsed: DataFrame) -> DataFrame:
    """EX-12 channel + field per encoding."""
    p = _worksheets(parsed).select("path", F.col("ws._name").alias("worksheet_name"), F.explode("ws.table.panes.pane").alias("pane"))
    def tag(channel):
        return lambda e: F.struct(F.lit(channel).alias("channel"), e["_column"].alias("col"))

    empty = F.array().cast("array<struct<_column:string>>")
    per_channel = F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"pane.encodings.{c}"), empty), tag(c)) for c in _CHANNELS]))
    e = p.select("path", "worksheet_name", F.explode(per_channel).alias("e"))
    return e.select("path", "worksheet_name", F.col("e.channel").alias("channel"), F.regexp_extract(F.col("e.col"), FIELD_PATTERN, 1).alias("field"))


def axes(parsed: DataFrame) -> DataFrame:
    """EX-13 rows/cols shelves split on ``/`` and ``+``; one row per field."""
    w = _worksheets(parsed).select("path", F.col("ws._name").alias("worksheet_name"), F.col("ws.table.rows").alias("rows"), F.col("ws.table.cols").alias("cols"))
    long = w.select("path", "worksheet_name", F.explode(F.array(F.struct(F.lit("rows").alias("axis"), F.col("rows").alias("v")), F.struct(F.lit("cols").alias("axis"), F.col("cols").alias("v")))).alias("a"))
    parts = long.select("path", "worksheet_name", F.col("a.axis").alias("axis"), F.posexplode(F.split(F.col("a.v"), r"[+/]")).alias("pos", "part"))
    return parts.select("path", "worksheet_name", "axis", "pos", F.regexp_extract(F.col("part"), FIELD_PATTERN, 1).alias("field")).filter(F.col("field") != "")


def chart_datasources(parsed: DataFrame) -> DataFrame:
    """EX-14 datasource captions per worksheet."""
    d = _worksheets(parsed).select("path", F.col("ws._name").alias("worksheet_name"), F.explode("ws.table.view.datasources.datasource").alias("d"))
    return d.select("path", "worksheet_name", F.col("d._caption").alias("datasource_name"))


def group_filter_semantics(gf: Column) -> dict[str, Column]:
    """EX-17 over a group filter and its child group filters (parent first,
    then children in document order), evaluated per row with higher-order
    functions (no shuffle):

    * kind: ``end`` -> top; ``filter`` with a pattern -> wildcard; ``filter``
      without -> condition; anything else -> general;
    * enumeration: the last one set by union/except/member/empty-level; an
      ``except`` without an enumeration over an exclusive selection flips it
      to inclusive ("except everything but …");
    * members: member values plus ``range from..to`` expanded (EX-18).
    """
    parent = F.struct(*[gf[f].alias(f) for f in _GF_FIELDS])
    gfs = F.filter(F.concat(F.array(parent), F.coalesce(gf["groupfilter"], F.array().cast(f"array<struct<{_GF_LEAF}>>"))), lambda g: g["_function"].isNotNull())
    fn = lambda g: g["_function"]
    en = lambda g: g["_user:ui-enumeration"]
    has_pattern = lambda g: g["_user:ui-pattern_type"].isNotNull() | g["_user:ui-pattern_text"].isNotNull()
    kind = (
        F.when(F.exists(gfs, lambda g: fn(g) == "end"), F.lit("top"))
        .when(F.exists(gfs, lambda g: (fn(g) == "filter") & has_pattern(g)), F.lit("wildcard"))
        .when(F.exists(gfs, lambda g: fn(g) == "filter"), F.lit("condition"))
        .when(F.size(gfs) > 0, F.lit("general"))
    )

    def set_enum(g):
        return (
            F.when((fn(g) == "union") & (en(g) == "inclusive"), F.lit("inclusive"))
            .when((fn(g) == "except") & en(g).isin("inclusive", "exclusive"), F.lit("exclusive"))
            .when((fn(g) == "member") & en(g).isin("inclusive", "exclusive"), en(g))
            .when(fn(g) == "empty-level", en(g))
        )

    enums = F.filter(F.transform(gfs, set_enum), lambda e: e.isNotNull())
    last_enum = F.try_element_at(enums, F.lit(-1))
    except_all = F.exists(gfs, lambda g: (fn(g) == "except") & (en(g).isNull() | ~en(g).isin("inclusive", "exclusive")))
    enumeration = F.when(except_all & (last_enum == "exclusive"), F.lit("inclusive")).otherwise(last_enum)
    members = F.flatten(
        F.transform(
            gfs,
            lambda g: F.when(fn(g) == "member", F.array(g["_member"]))
            .when(fn(g) == "range", F.coalesce(F.transform(range_members(g["_from"], g["_to"]), lambda i: i.cast("string")), F.array().cast("array<string>")))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    unread = F.filter(gfs, lambda g: (fn(g) == "range") & range_members(g["_from"], g["_to"]).isNull())
    ranges = F.transform(unread, lambda g: F.concat(F.coalesce(g["_from"], F.lit("")), F.lit(".."), F.coalesce(g["_to"], F.lit(""))))
    return {"function": gf["_function"], "filter_kind": kind, "enumeration": enumeration, "members": members, "unread_ranges": ranges}


def classify_filter(function: Column, enumeration: Column) -> Column:
    """EX-17 function code -> general / wildcard / top / condition."""
    return (
        F.when(function.isin("member", "union", "except", "range"), F.lit("general"))
        .when(function == "filter", F.lit("wildcard"))
        .when(function == "end", F.lit("top"))
        .when(function.isNotNull(), F.lit("condition"))
    )


def quantitative_kind(min_c: Column, max_c: Column) -> Column:
    """EX-19 min+max -> between, min -> atleast, max -> atmost, none -> undefined."""
    return (
        F.when(min_c.isNotNull() & max_c.isNotNull(), "between").when(min_c.isNotNull(), "atleast").when(max_c.isNotNull(), "atmost").otherwise("undefined")
    )


#: Members that a range may stand for; longer ones are error rows (a row holds all members of its filter).
MAX_RANGE = 100_000


def range_members(from_c: Column, to_c: Column) -> Column:
    """The whole numbers from..to (none where they fall); null where a bound is no whole number or the range is longer than MAX_RANGE."""
    lo, hi = F.trim(from_c).try_cast("bigint"), F.trim(to_c).try_cast("bigint")
    return F.when(lo > hi, F.array().cast("array<bigint>")).when(F.try_subtract(hi, lo) < MAX_RANGE, F.sequence(lo, hi))


def expand_member_range(from_c: Column, to_c: Column) -> Column:
    """EX-18 ``range from..to`` -> one member per integer; null where the range can't be read (as ``range_members``)."""
    return range_members(from_c.cast("string"), to_c.cast("string")).cast("array<int>")


def datasource_filters(parsed: DataFrame, as_of=None) -> DataFrame:
    """EX-15 (and EX-16 with a worksheet scope): one row per filter with its
    class, function, member / range / relative-date attributes; filters are
    numbered per datasource by ``row_number`` (Q19)."""
    ds = datasources(parsed)
    f = ds.select("path", "ds_pos", F.col("ds._caption").alias("datasource_name"), F.posexplode("ds.filter").alias("pos", "f"))
    w = Window.partitionBy("path", "datasource_name").orderBy("ds_pos", "pos")
    gs = group_filter_semantics(F.col("f.groupfilter"))
    return f.select(
        "path",
        "datasource_name",
        F.concat(F.lit("Filter_"), F.row_number().over(w).cast("string")).alias("filter_name"),
        F.col("f._class").alias("filter_class"),
        F.regexp_replace(F.col("f._column"), r"^\[|\]$", "").alias("column"),
        gs["function"].alias("function"),
        gs["filter_kind"].alias("filter_kind"),
        F.when(F.size(gs["members"]) > 0, F.array_join(gs["members"], ",")).alias("member"),
        gs["enumeration"].alias("enumeration"),
        F.col("f.min").alias("min"),
        F.col("f.max").alias("max"),
        F.when(F.col("f._class") == "quantitative", quantitative_kind(F.col("f.min"), F.col("f.max"))).alias("range_kind"),
        F.col("f.`_period-type`").alias("period_type"),
        F.col("f.`_first-period`").try_cast("int").alias("first_period"),
        F.col("f.`_last-period`").try_cast("int").alias("last_period"),
        # EX-20 anchor defaults to "today" (or an as-of date for reproducible runs)
        F.when(F.col("f._class") == "relative-date", F.coalesce(F.col("f.`_anchor-date`"), F.lit(as_of) if as_of else F.lit("today"))).alias("anchor"),
        F.when(F.col("f._class") == "relative-date", F.coalesce(F.col("f.`_include-null`"), F.lit("false"))).alias("include_null"),
    )


def worksheet_filters(parsed: DataFrame) -> DataFrame:
    """EX-16 worksheet filters; the datasource is resolved from the
    ``[datasource].[column]`` prefix through the name -> caption map of the
    worksheet's datasources (EX-17 classifier applied)."""
    ws = _worksheets(parsed).select("path", F.col("ws._name").alias("worksheet_name"), F.col("ws.table.view").alias("view"))
    f = ws.select("path", "worksheet_name", "view.datasources.datasource", F.posexplode("view.filter").alias("pos", "f"))
    parts = F.regexp_extract_all(F.col("f._column"), F.lit(r"\[([^\]]+)\]"), 1)
    ds_name = F.try_element_at(parts, F.lit(1))
    caption = F.try_element_at(F.filter(F.col("datasource"), lambda d: d["_name"] == ds_name), F.lit(1))["_caption"]
    w = Window.partitionBy("path", "worksheet_name").orderBy("pos")
    gs = group_filter_semantics(F.col("f.groupfilter"))
    return f.select(
        "path",
        "worksheet_name",
        F.concat(F.lit("Filter_"), F.row_number().over(w).cast("string")).alias("filter_name"),
        caption.alias("datasource_name"),
        F.try_element_at(parts, F.lit(-1)).alias("column"),
        F.col("f._class").alias("filter_class"),
        gs["function"].alias("function"),
        gs["filter_kind"].alias("filter_kind"),
        F.when(F.size(gs["members"]) > 0, F.array_join(gs["members"], ",")).alias("member"),
        gs["enumeration"].alias("enumeration"),
    )


def _dashboards(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("wb.dashboards.dashboard").alias("db"))


def dashboards(parsed: DataFrame) -> DataFrame:
    """EX-21 one row per dashboard; EX-26 its sizing mode."""
    d = _dashboards(parsed)
    return d.select("path", F.col("db._name").alias("dashboard_name"), F.col("db.size.`_sizing-mode`").alias("sizing_mode"))


def zones(parsed: DataFrame) -> DataFrame:
    d = _dashboards(parsed)
    return d.select("path", F.col("db._name").alias("dashboard_name"), F.posexplode("db.zones.zone").alias("pos", "z"))


# fixed values: zone type -> dashboard feature label
ZONE_LABELS = {"web": "Webpage (URL)", "bitmap": "Image(As Tile)", "empty": "Blank"}


def special_zones(parsed: DataFrame) -> DataFrame:
    """EX-22 web / image / blank zones, labelled and de-duplicated."""
    z = zones(parsed).filter(F.col("z.`_type-v2`").isin(list(ZONE_LABELS)))
    label = F.create_map(*[x for k, v in ZONE_LABELS.items() for x in (F.lit(k), F.lit(v))])[F.col("z.`_type-v2`")]
    return z.select("path", "dashboard_name", F.col("z.`_type-v2`").alias("zone_type"), label.alias("feature")).dropDuplicates()


def buttons(parsed: DataFrame) -> DataFrame:
    """EX-23 buttons, distinct on (type, caption, action)."""
    z = zones(parsed).filter(F.col("z.button").isNotNull())
    return z.select("path", "dashboard_name", F.lit("Dashboard Navigation").alias("button_type"), F.col("z.button._caption").alias("caption"), F.col("z.button._action").alias("action")).dropDuplicates(
        ["path", "dashboard_name", "button_type", "caption", "action"]
    )


def containers(parsed: DataFrame) -> DataFrame:
    """EX-24 zones sharing x (vertical) or y (horizontal), anchors per dashboard (Q20)."""
    z = zones(parsed).select("path", "dashboard_name", F.col("z._x").alias("x"), F.col("z._y").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    v = z.groupBy("path", "dashboard_name", F.col("x").alias("anchor")).agg(F.count(F.lit(1)).alias("zones")).filter("zones > 1").withColumn("orientation", F.lit("vert"))
    h = z.groupBy("path", "dashboard_name", F.col("y").alias("anchor")).agg(F.count(F.lit(1)).alias("zones")).filter("zones > 1").withColumn("orientation", F.lit("horz"))
    return v.unionByName(h)


def texts(parsed: DataFrame) -> DataFrame:
    """EX-25 text runs per dashboard."""
    z = zones(parsed).filter(F.col("z.`formatted-text`").isNotNull())
    return z.select("path", "dashboard_name", F.explode("z.`formatted-text`.run").alias("text")).filter(F.trim("text") != "")


def zone_layout(parsed: DataFrame) -> DataFrame:
    """EX-27 h, w, x, y of each worksheet zone -> long rows (``unpivot``)."""
    z = zones(parsed).filter(F.col("z._name").isNotNull() & F.col("z.`_type-v2`").isNull())
    wide = z.select("path", "dashboard_name", F.col("z._name").alias("worksheet_name"), F.col("z._h").alias("h"), F.col("z._w").alias("w"), F.col("z._x").alias("x"), F.col("z._y").alias("y")).dropDuplicates()
    return wide.unpivot(["path", "dashboard_name", "worksheet_name"], ["h", "w", "x", "y"], "property_name", "property_value")


def dashboard_filter_numbers(parsed: DataFrame) -> DataFrame:
    """EX-28 number distinct dashboard filters in order of first appearance."""
    z = zones(parsed).filter(F.col("z.`_type-v2`") == "filter").select("path", "dashboard_name", "pos", F.col("z._name").alias("filter_column"))
    first = z.groupBy("path", "dashboard_name", "filter_column").agg(F.min("pos").alias("first_pos"))
    w = Window.partitionBy("path", "dashboard_name").orderBy("first_pos")
    return first.select("path", "dashboard_name", "filter_column", F.concat(F.lit("filter_"), F.dense_rank().over(w).cast("string")).alias("filter_name"))
