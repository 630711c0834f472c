"""Sinks and the custom-SQL source (IO-05, IO-06, IO-07, IO-11)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.warehouse import conform_dump


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir`` (never a
    machine-local temp folder)."""
    from lodestar.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex[:12]}"


def append_dump(dump: DataFrame, path: str) -> None:
    """IO-05: conform to the dump columns (strings) and append by ``exec_id``;
    re-loading a run replaces only its partition (dynamic overwrite, Q15)."""
    conform_dump(dump).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exec_id").parquet(path)


def append_csv(df: DataFrame, path: str, run_id: str) -> None:
    """IO-06: combined CSV with a header, a folder for each run; a run that is
    written again replaces its own folder, so a retried job adds no row twice."""
    df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/run={run_id}")


def write_documents(df: DataFrame, key: str, fields: list[str], path: str) -> DataFrame:
    """IO-07: one nested JSON document per ``key`` (its rows as a sorted list),
    a line each.  Groups are model objects (columns of a datasource), bounded by
    construction; the number of files follows the data, not the keys."""
    docs = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    out = docs.select(key, F.to_json(F.struct(F.col(key).alias("name"), "items")).alias("value"))
    out.select("value").write.mode("overwrite").text(path)
    return out


# Pieces that are kept as they are: string literals, quoted names, comments.
_VERBATIM = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*(?:\n|$)|/\*.*?\*/""", re.S)
_DOUBLED = [(">>", ">"), ("<<", "<"), ("==", "=")]


def normalize_custom_sql(text: str) -> str:
    """IO-11 undo the doubled operators of workbook-escaped SQL and collapse white
    space, outside of literals, quoted names and comments."""

    def plain(part: str) -> str:
        for a, b in _DOUBLED:
            part = part.replace(a, b)
        return re.sub(r"\s+", " ", part)

    out, at = [], 0
    for m in _VERBATIM.finditer(text):
        out += [plain(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, plain(text[at:])]).strip()


def custom_sql_source(spark: SparkSession, name: str, text: str) -> DataFrame:
    """IO-11 a named sub-query registered as a temp view."""
    df = spark.sql(normalize_custom_sql(text))
    df.createOrReplaceTempView(name)
    return df
