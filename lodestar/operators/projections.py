"""Projection and name rewriting (P-02 … P-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_id(table, column) -> Column:
    """P-02 ``table::column``."""
    return F.concat_ws("::", table, column)


def clean_name(name: Column) -> Column:
    """P-04 strip brackets, drop a trailing `` (table)`` and keep the last dotted part."""
    s = F.regexp_replace(name, r"[\[\]]", "")
    s = F.regexp_replace(s, r"\s*\([^()]*\)\s*$", "")
    return F.element_at(F.split(s, r"\."), -1)


def split_qualified(name: Column) -> Column:
    """P-05 ``db.schema.table`` -> struct(database, schema, table); a plain name
    gives only the table."""
    s = F.regexp_replace(name, r"[\[\]]", "")
    parts = F.split(s, r"\.")
    three = F.size(parts) >= 3
    return F.struct(
        F.when(three, F.element_at(parts, -3)).alias("database"),
        F.when(three, F.element_at(parts, -2)).alias("schema"),
        F.element_at(parts, -1).alias("table"),
    )


def parse_part_reference(ref: Column) -> Column:
    """P-07 ``[agg:column:type]`` -> struct(part, column, kind)."""
    pat = r"^\[([^:\]]*):([^:\]]*):([^:\]]*)\]$"
    return F.struct(
        F.regexp_extract(ref, pat, 1).alias("part"),
        F.regexp_extract(ref, pat, 2).alias("column"),
        F.regexp_extract(ref, pat, 3).alias("kind"),
    )


def field_rewrite(formula: Column, mapping: dict[str, str]) -> Column:
    """P-03 rewrite ``[local]`` field references with a small, fixed mapping.

    For per-row mappings (columns of each table) use
    ``lodestar.operators.formulas.rewrite_fields`` (token explode + join)."""
    out = formula
    for local, target in mapping.items():
        out = F.replace(out, F.lit(f"[{local}]"), F.lit(f"[{target}]"))
    return out
