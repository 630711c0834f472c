"""Formula-corpus analytics (FC-01 … FC-06) over calculated fields at scale.

Formulas are text columns; every step is a built-in regex / array function
(JVM-side) plus joins to the small fixed support table (broadcast).  The
dependency depth (FC-05) is an iterative join over calc -> calc edges whose
rounds are bounded by the longest reference chain, not by the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import ship_library

# Function name -> support verdict of the target (Yes -> Full,
# NF -> NoSup; date functions whose support depends on the part -> Partial).
FUNCTION_SUPPORT = {
    "DATEADD": "Partial", "DATEDIFF": "Partial", "DATENAME": "Partial", "ELSEIF": "Full", "ENDSWITH": "NoSup",
    "FINDNTH": "NoSup", "IIF": "NoSup", "MAKEDATETIME": "NoSup", "RUNNING_AVG": "Full", "RUNNING_MAX": "Full",
    "RUNNING_MIN": "Full", "RUNNING_SUM": "Full", "COVARP": "NoSup", "AREA": "NoSup", "ASCII": "NoSup", "ATTR": "NoSup",
    "AVG": "Full", "BUFFER": "NoSup", "CEILING": "Full", "CHAR": "NoSup", "COLLECT": "NoSup", "CORR": "NoSup", "COT": "NoSup",
    "COUNTD": "Full", "COVAR": "NoSup", "DEGREES": "NoSup", "DISTANCE": "NoSup", "DIV": "Full", "FIND": "NoSup", "FIRST": "NoSup",
    "FULLNAME": "NoSup", "HEXBINX": "NoSup", "HEXBINY": "NoSup", "INDEX": "NoSup", "ISDATE": "NoSup", "ISFULLNAME": "NoSup",
    "ISMEMBEROF": "NoSup", "ISUSERNAME": "NoSup", "LAST": "NoSup", "LEN": "NoSup", "LOG": "Full", "LOOKUP": "NoSup", "LOWER": "Full",
    "LTRIM": "Full", "MAKEDATE": "NoSup", "MAKELINE": "NoSup", "MAKEPOINT": "NoSup", "MAKETIME": "NoSup", "MAX": "Full", "MIN": "Full",
    "MODEL_PERCENTILE": "NoSup", "MODEL_QUANTILE": "NoSup", "PERCENTILE": "Full", "PI": "NoSup", "POWER": "Full",
    "PREVIOUS_VALUE": "NoSup", "QUARTER": "Full", "RADIANS": "NoSup", "RANK_DENSE": "NoSup", "RANK_MODIFIED": "NoSup",
    "RANK_UNIQUE": "NoSup", "RAWSQL_BOOL": "NoSup", "RAWSQL_DATE": "NoSup", "RAWSQL_DATETIME": "NoSup", "RAWSQL_INT": "NoSup",
    "RAWSQL_REAL": "NoSup", "RAWSQL_STR": "NoSup", "RAWSQLAGG_BOOL": "NoSup", "RAWSQLAGG_DATE": "NoSup",
    "RAWSQLAGG_DATETIME": "NoSup", "RAWSQLAGG_INT": "NoSup", "RAWSQLAGG_REAL": "NoSup", "RAWSQLAGG_STR": "NoSup",
    "REPLACE": "NoSup", "RTRIM": "Full", "RUNNING_COUNT": "NoSup", "SIZE": "NoSup", "SPACE": "NoSup", "SPLIT": "NoSup",
    "SQUARE": "Full", "STARTSWITH": "NoSup", "TODAY": "Full", "TOTAL": "NoSup", "TRIM": "Full", "UPPER": "Full",
    "USERDOMAIN": "NoSup", "USERNAME": "NoSup", "VARP": "NoSup", "WEEK": "Full", "WINDOW_AVG": "NoSup", "WINDOW_CORR": "NoSup",
    "WINDOW_COUNT": "NoSup", "WINDOW_COVAR": "NoSup", "WINDOW_COVARP": "NoSup", "WINDOW_MAX": "NoSup",
    "WINDOW_MEDIAN": "NoSup", "WINDOW_MIN": "NoSup", "WINDOW_PERCENTILE": "NoSup", "WINDOW_STDEV": "NoSup",
    "WINDOW_STDEVP": "NoSup", "WINDOW_SUM": "NoSup", "WINDOW_VAR": "NoSup", "ZN": "NoSup",
}

# Workbook function -> target function name (FC-04).
RENAMES = {
    "CEILING": "ceil", "DIV": "safe_divide", "LOG": "log10", "POWER": "pow", "SQUARE": "sq", "LEN": "strlen", "MID": "substr",
    "QUARTER": "quarter_number", "WEEK": "week_number_of_year", "STDEV": "stddev", "RUNNING_AVG": "cumulative_average",
    "AVG": "average", "RUNNING_SUM": "cumulative_sum",
}

VERDICT_RANK = {"Full": 0, "Partial": 1, "NoSup": 2}
FUNCTION_PATTERN = r"([A-Z_][A-Z0-9_]*)\s*\("
FIELD_PATTERN = r"\[([^\]]+)\]"


# What a scan of a formula must take whole, first come first: string literals, bracketed names, comments.
_LITERAL, _NAME, _COMMENT = r"""\"[^\"]*\"|'[^']*'""", r"\[[^\]]*\]", r"//[^\n]*|/\*(?s:.*?)\*/"


def strip_comments(formula: Column) -> Column:
    """Remove ``//`` line comments and ``/* … */`` blocks before scanning; string
    literals (a URL, say) and bracketed names are kept whole."""
    return F.regexp_replace(formula, f"({_LITERAL}|{_NAME})|{_COMMENT}", "$1 ")


def function_usage(calcs: DataFrame, keys=("path", "name")) -> DataFrame:
    """FC-01 one row per (formula, function used); literals, names and comments are no calls."""
    code = F.regexp_replace(F.col("formula"), f"{_LITERAL}|{_NAME}|{_COMMENT}", " ")
    f = F.regexp_extract_all(F.upper(code), F.lit(FUNCTION_PATTERN), 1)
    return calcs.select(*keys, F.explode(F.array_distinct(f)).alias("function"))


def field_usage(calcs: DataFrame, keys=("path", "name")) -> DataFrame:
    """FC-02 one row per (formula, ``[field]`` referenced); brackets in literals and comments are no fields."""
    code = F.regexp_replace(F.col("formula"), f"({_NAME})|{_LITERAL}|{_COMMENT}", "$1 ")
    f = F.regexp_extract_all(code, F.lit(FIELD_PATTERN), 1)
    return calcs.select(*keys, F.explode(F.array_distinct(f)).alias("field"))


def support_table(spark: SparkSession) -> DataFrame:
    rows = [(k, v, VERDICT_RANK[v]) for k, v in FUNCTION_SUPPORT.items()]
    return spark.createDataFrame(rows, "function string, verdict string, verdict_rank int")


def classify(calcs: DataFrame, keys=("path", "name")) -> DataFrame:
    """FC-03 / MP-10 formula verdict = worst verdict of its functions
    (functions outside the table and formulas without functions are Full)."""
    spark = calcs.sparkSession
    use = function_usage(calcs, keys).join(F.broadcast(support_table(spark)), "function", "left")
    worst = use.groupBy(*keys).agg(F.max(F.coalesce("verdict_rank", F.lit(0))).alias("r"))
    out = calcs.select(*keys).distinct().join(worst, list(keys), "left")
    verdict = F.when(F.col("r") == 2, "NoSup").when(F.col("r") == 1, "Partial").otherwise("Full")
    return out.select(*keys, verdict.alias("verdict"))


def rename_functions(formula: Column) -> Column:
    """FC-04 apply the rename map (whole-word function names followed by ``(``)."""
    out = formula
    for src, dst in RENAMES.items():
        out = F.regexp_replace(out, rf"(?i)\b{src}\s*\(", f"{dst}(")
    return out


def dependency_depth(calcs: DataFrame, keys=("path",)) -> DataFrame:
    """FC-05 depth of calc -> calc references (0 = references no calculation).

    Edges come from FC-02 restricted to names of calculations in the same
    document.  A document's references are one bounded group, so each is resolved
    in one pass (``applyInPandas``) whatever its depth.  Calculations in a cycle,
    and those that need one, have a NULL depth and an ``error`` text."""
    bare = F.regexp_replace("name", r"^\[|\]$", "")
    names = calcs.select(*keys, bare.alias("callee")).distinct()
    edges = field_usage(calcs, (*keys, "name")).withColumnRenamed("field", "callee").join(names, [*keys, "callee"], "inner")
    edges = edges.select(*keys, bare.alias("caller"), "callee").distinct()
    every = calcs.select(*keys, bare.alias("caller"), F.lit(None).cast("string").alias("callee")).distinct().unionByName(edges)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.select(*keys).schema)
    k = len(keys)

    def resolve(key, pdf):
        import pandas as pd

        needs: dict[str, set] = {}
        for caller, callee in zip(pdf["caller"], pdf["callee"]):
            needs.setdefault(caller, set())
            if callee is not None and not pd.isna(callee):
                needs[caller].add(callee)
        used_by: dict[str, list] = {}
        for caller, callees in needs.items():
            for c in callees:
                used_by.setdefault(c, []).append(caller)
        waits = {c: len(x) for c, x in needs.items()}
        depth, ready = {c: 0 for c, n in waits.items() if n == 0}, [c for c, n in waits.items() if n == 0]
        while ready:
            done = ready.pop()
            for caller in used_by.get(done, []):
                waits[caller] -= 1
                depth[caller] = max(depth.get(caller, 0), depth[done] + 1)
                if waits[caller] == 0:
                    ready.append(caller)
        rows = [(*key[:k], c, depth[c] if waits[c] == 0 else None, None if waits[c] == 0 else "reference cycle") for c in needs]
        return pd.DataFrame(rows, columns=[*keys, "caller", "depth", "error"]).astype({"depth": "Int32"})

    ship_library(every.sparkSession)
    return every.groupBy(*keys).applyInPandas(resolve, f"{key_schema}, caller string, depth int, error string")


def convertible_share(verdicts: DataFrame, key: str = "path") -> DataFrame:
    """FC-06 converted / total per workbook."""
    return verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("formulas"),
        F.count(F.when(F.col("verdict") == "Full", 1)).alias("convertible"),
        F.round(F.count(F.when(F.col("verdict") == "Full", 1)) / F.count(F.lit(1)), 6).alias("share"),
    )


def rewrite_fields(calcs: DataFrame, columns: DataFrame, kind: DataFrame, keys=("path", "datasource_name")) -> DataFrame:
    """P-03 rewrite ``[local]`` references: Live -> ``[table::column]``,
    Extract -> ``[remote]``.

    ``columns`` = (keys…, local_column_name, remote_column_name, table_name);
    ``kind`` = (keys…, ds_type).  The local -> target map is built per
    datasource (bounded by its column count) and applied to the ``[...]``
    tokens of each formula with a higher-order ``aggregate``.  Of a repeated local
    name the first counts; where captions repeat, take placed rows of all three and
    the keys (path, ds_pos)."""
    from lodestar.operators.extract import first_map, with_map

    keys = list(keys)
    one_kind = kind.groupBy(*keys).agg(F.min("ds_type").alias("ds_type"))
    target = F.when(F.col("ds_type") == "Extract", F.col("remote_column_name")).otherwise(F.concat_ws("::", "table_name", "local_column_name"))
    j = with_map(calcs, first_map(columns.join(one_kind, keys), keys, "local_column_name", target, "fields"), keys)
    tokens = F.array_distinct(F.regexp_extract_all(F.col("formula"), F.lit(FIELD_PATTERN), 1))
    rewritten = F.aggregate(
        tokens,
        F.col("formula"),
        lambda acc, tok: F.when(
            F.element_at(F.col("fields"), tok).isNotNull(),
            F.replace(acc, F.concat(F.lit("["), tok, F.lit("]")), F.concat(F.lit("["), F.element_at(F.col("fields"), tok), F.lit("]"))),
        ).otherwise(acc),
    )
    return j.withColumn("formula", F.when(F.col("fields").isNull(), F.col("formula")).otherwise(rewritten)).drop("fields")
