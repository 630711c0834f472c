import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.operators import extract as X
from lodestar.operators import formulas as FC
from lodestar.operators import joins as J
from lodestar.operators.dump import extracted_rows
from lodestar.sources.workbooks import _unzip


def _ds(inside, caption="D", name="n"):
    return f"<datasource caption='{caption}' name='{name}'><connection class='federated'/>{inside}</datasource>"


def _parsed(spark, docs):
    return X.parse(spark.createDataFrame([(p, f"<workbook><datasources>{x}</datasources></workbook>") for p, x in docs], "path string, content string"))


def _range(lo, hi):
    return f"<filter class='categorical' column='[A]'><groupfilter function='union'><groupfilter function='range' from='{lo}' to='{hi}'/><groupfilter function='member' member='m'/></groupfilter></filter>"


def test_one_odd_value_leaves_the_other_rows(spark):
    odd = {
        "text": _range("a", "f"), "date": _range("#2020-01-01#", "#2020-02-01#"), "half": _range("1.5", "3"), "empty": _range("", "3"), "long": _range(1, X.MAX_RANGE + 1), "wide": _range(-(2**63), 2**63 - 1),
        "falls": _range(5, 3), "edge": _range(1, X.MAX_RANGE), "good": _range(" 2", "+4 "),
    }
    parsed = _parsed(spark, [(p, _ds(x)) for p, x in odd.items()]).checkpoint()
    members = {r.path: r.member for r in X.datasource_filters(parsed).collect()}
    assert members.pop("edge").split(",") == [*map(str, range(1, X.MAX_RANGE + 1)), "m"]
    assert members == {p: "m" for p in odd if p not in ("good", "edge")} | {"good": "2,3,4,m"}
    told = {r.path: r.exec_error_details for r in X.problems(parsed).collect()}
    assert told.keys() == {"text", "date", "half", "empty", "long", "wide"} and told["text"].startswith("range a..f of [A]")
    rows = extracted_rows(parsed)
    assert {r.path for r in rows.filter("object_type = 'error'").collect()} == told.keys()
    assert rows.filter("object_type = 'datasource property' AND property_name = 'member'").count() == len(odd)


def test_names_that_repeat_or_lack(spark):
    record = "<metadata-record class='column'><remote-name>{1}</remote-name>{0}<parent-name>[T]</parent-name></metadata-record>"
    column = "<column {0} caption='{1}'><calculation formula='{2}'/></column>"
    twice = _ds(column.format("name='[Calculation_1]'", "A", "1") + column.format("name='[Calculation_2]'", "B", "[Calculation_1]")) + _ds(column.format("name='[Calculation_1]'", "C", "2") + column.format("name='[Calculation_2]'", "D", "[Calculation_1]"), name="m")
    same = _ds(column.format("name='[Calculation_1]'", "A", "1") + column.format("name='[Calculation_1]'", "B", "[Calculation_1] + [Calculation_9]") + column.format("", "N", "3"))
    local = _ds("<metadata-records>" + record.format("<local-name>[k]</local-name>", "R") + record.format("<local-name>[k]</local-name>", "S") + record.format("", "U") + "</metadata-records>" + column.format("name='[Calculation_1]'", "A", "[k]"))
    nameless = "<datasource><connection class='x'/>" + column.format("name='[Calculation_1]'", "A", "1") + column.format("name='[Calculation_2]'", "B", "[Calculation_1]") + "</datasource>"
    parsed = _parsed(spark, [("twice", twice), ("same", same), ("local", local), ("nameless", nameless)]).checkpoint()
    calcs = X.calculated_fields(parsed, placed=True)
    got = sorted((r.path, r.caption, r.formula) for r in X.resolve_references(calcs).collect())
    assert got == sorted([("twice", "A", "1"), ("twice", "B", "[A]"), ("twice", "C", "2"), ("twice", "D", "[C]"), ("same", "A", "1"), ("same", "B", "[A] + [Calculation_9]"), ("same", "N", "3"), ("local", "A", "[k]"), ("nameless", "A", "1"), ("nameless", "B", "[A]")])
    assert X.resolve_references(X.calculated_fields(parsed)).count() == len(got)  # by caption: nothing fails there either
    rewritten = FC.rewrite_fields(calcs, X.columns(parsed, placed=True).drop("datasource_name"), X.datasource_kind(parsed, placed=True).drop("datasource_name"), ("path", "ds_pos"))
    assert [r.formula for r in rewritten.filter("path = 'local'").collect()] == ["[T::k]"] and rewritten.count() == len(got)
    plain = FC.rewrite_fields(X.calculated_fields(parsed), X.columns(parsed), X.datasource_kind(parsed).select("path", "datasource_name", "ds_type"))
    assert plain.count() == len(got)
    told = sorted((r.path, r.extractor, r.exec_error_details) for r in X.problems(parsed).collect())
    assert told == [
        ("local", "columns", "a column has no name"), ("local", "columns", "k names 2 items; the first counts"),
        ("nameless", "datasources", "a datasource has neither caption nor name"),
        ("same", "calculations", "[Calculation_1] names 2 items; the first counts"), ("same", "calculations", "a calculation has no name"),
        ("twice", "datasources", "2 datasources are called D; they are told apart by their place"),
    ]


def test_periods_and_worksheet_filters(spark):
    period = "<filter class='relative-date' column='[A]' first-period='{0}' last-period='0'/>"
    sheet = "<worksheets><worksheet name='w'><table><view><datasources><datasource caption='D' name='n'/></datasources><filter class='categorical' column='bare'><groupfilter function='range' from='x' to='y'/></filter><filter class='categorical' column='[other].[B]'><groupfilter function='member' member='m'/></filter></view></table></worksheet></worksheets>"
    docs = spark.createDataFrame([("p", f"<workbook><datasources>{_ds(period.format('soon') + period.format('-3'))}</datasources>{sheet}</workbook>")], "path string, content string")
    parsed = X.parse(docs).checkpoint()
    assert [(r.first_period, r.last_period) for r in X.datasource_filters(parsed).collect()] == [(None, 0), (-3, 0)]
    assert [(r.datasource_name, r.column, r.member) for r in X.worksheet_filters(parsed).collect()] == [(None, None, None), (None, "B", "m")]
    assert sorted(r.exec_error_details[:22] for r in X.problems(parsed).collect()) == ["period soon of [A] is ", "range x..y of bare is "]


def test_members_that_cannot_be_unpacked():
    import pandas as pd

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.twb", "<workbook>" + "x" * 500)
        z.writestr("b.twb", "<workbook/>")
    whole = buf.getvalue()
    at = whole.index(b"a.twb") + 5
    corrupt = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
    locked = bytearray(whole)
    for header, flags in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[whole.index(header) + flags] |= 1  # the first member says that it is encrypted
    out = next(_unzip(iter([pd.DataFrame({"path": ["c", "l", "n"], "content": [corrupt, bytes(locked), b""]})])))
    assert [(p, e is None or e != e) for p, e in zip(out["path"], out["error"])] == [("c!a.twb", False), ("c!b.twb", True), ("l!a.twb", False), ("l!b.twb", True), ("n", False)]


def _nodes(*rows):
    return [{"n": n, "op": op, "parent": parent} for n, op, parent in rows]


AND = _nodes((0, "AND", None), (1, "=", 0), (2, "[a].[k]", 1), (3, "[b].[k]", 1), (4, "<=", 0), (5, "[b].[m]", 4), (6, "[a].[m]", 4))


def test_clause_trees_run_as_joins(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 5), (None, 9)], "k int, m int")
    b = spark.createDataFrame([(1, 3), (2, 7), (3, 1)], "k int, m int").withColumn("v", F.col("m") * 10)
    edge = J.clause_relationship(AND, "left")
    assert (edge.left, edge.right, edge.keys, edge.compared) == ("a", "b", [("k", "k")], (("m", ">=", "m"),))
    got = J.star_join({"a": a, "b": b}, [edge]).select("k", "a__m", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 5, 30), (1, 1, None), (2, 5, None), (None, 9, None)], key=str)
    either = _nodes((0, "OR", None), (1, "=", 0), (2, "[a].[k]", 1), (3, "[b].[k]", 1), (4, "NOT", 0), (5, "<>", 4), (6, "[a].[m]", 5), (7, "[b].[m]", 5))
    on = J.clause_condition(either, lambda t, c: F.col(f"{t}.{c}"))
    rows = a.alias("a").join(b.alias("b"), on).select("a.k", "a.m", "b.m")
    assert sorted(map(tuple, rows.collect())) == sorted((x, y, z) for x, y in [(1, 5), (1, 1), (2, 5)] for w, z in [(1, 3), (2, 7), (3, 1)] if x == w or y == z)


def test_clauses_that_are_no_relationship():
    bad = {
        "OR": _nodes((0, "OR", None), (1, "=", 0), (2, "[a].[k]", 1), (3, "[b].[k]", 1)), "other operands": _nodes((0, "=", None), (1, "[a].[k]", 0), (2, "'x'", 0)),
        "between": _nodes((0, "AND", None), (1, "=", 0), (2, "[a].[k]", 1), (3, "[b].[k]", 1), (4, "=", 0), (5, "[a].[k]", 4), (6, "[c].[k]", 4)), "without": _nodes((0, "[a].[k]", None)),
    }
    for told, nodes in bad.items():
        with pytest.raises(ValueError, match=re.escape(told)):
            J.clause_relationship(nodes, "inner")
    with pytest.raises(ValueError, match="operands"):
        J.clause_condition(_nodes((0, "XOR", None), (1, "[a].[k]", 0)), lambda t, c: None)
