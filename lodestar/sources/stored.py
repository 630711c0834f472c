"""Stored layouts: tables bucketed by the keys of their relationships (J-02, J-05).

A star join shuffles its two largest tables on the relationship's keys each time
it runs.  ``store`` does so once, when the tables are written: both sides of a
relationship go to the same number of buckets by the hash of its keys, sorted by
them, one file a bucket.  Joins on these keys, and groupings by them, then read
bucket with bucket and plan no exchange of either table.

A table can lie in one order only.  ``bucket_keys`` gives it the keys of its
heaviest relationship (rows of both sides), heaviest first; other relationships
of the table are joined as before.  So are those to tables of few rows
(``least_rows``), which Spark sends to the other side instead.  A bucket is read by one task, and adaptive
execution doesn't split it.  So keys that would fill a bucket far beyond the
others (one key may hold a third of all rows, or none be known) are counted
before writing, and their tables are stored plainly: joins on them shuffle, and
adaptive execution splits the hot key.

The layout is described by a file of its own (``layout``) in the folder, so any
later application can ``attach`` it to its catalog.

Defined results: null keys lie in one bucket and match nothing; an empty table
is stored without files; the two sides of a relationship must have keys of the
same types, as hashes of different types differ (``ValueError``); relationships
without equal keys stay as they are.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.joins import Relationship, star_join

#: A bucket is hot beyond so many rows, if it also has so many times the mean.
HOT_ROWS, HOT_TIMES = 2_000_000, 4.0
#: Tables of fewer rows aren't bucketed.
LEAST_ROWS = 100_000


@dataclass(frozen=True)
class Layout:
    """Stored tables by name, with the keys of those that are bucketed."""

    spark: SparkSession
    path: str
    buckets: int
    keys: dict[str, tuple[str, ...]]
    names: dict[str, str]

    @cached_property
    def frames(self) -> dict[str, DataFrame]:
        return {t: self.spark.table(f"`{name}`") if t in self.keys else self.spark.read.parquet(f"{self.path}/{t}") for t, name in self.names.items()}

    def together(self, e: Relationship) -> bool:
        """Whether the sides of a relationship lie bucket by bucket."""
        sides = [self.keys.get(e.left), self.keys.get(e.right)]
        return None not in sides and list(zip(*sides)) == list(map(tuple, e.keys))

    def star(self, edges: list[Relationship], frames: dict[str, DataFrame] | None = None) -> DataFrame:
        """J-05 over the stored tables (``frames`` in place of some of them); relationships that are stored together are merged."""
        hinted = [replace(e, hint=e.hint or "merge") if self.together(e) else e for e in edges]
        return star_join(self.frames | (frames or {}), hinted)


def bucket_keys(rows: dict[str, int], edges: list[Relationship], least_rows: int = 0) -> dict[str, tuple[str, ...]]:
    """The keys by which tables are bucketed: relationships in turn, those with most rows first, whose tables are both free and not small."""
    keys: dict[str, tuple[str, ...]] = {}
    for e in sorted((e for e in edges if e.keys), key=lambda e: -(rows[e.left] + rows[e.right])):
        if e.left not in keys and e.right not in keys and e.left != e.right and min(rows[e.left], rows[e.right]) >= least_rows:
            keys[e.left], keys[e.right] = (tuple(k) for k in zip(*e.keys))
    return keys


def hot(df: DataFrame, keys: tuple[str, ...], buckets: int, hot_rows: int = HOT_ROWS, hot_times: float = HOT_TIMES) -> bool:
    """Whether a bucket would hold far more rows than the others."""
    bucket = F.pmod(F.hash(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets))
    counted = df.groupBy(bucket.alias("bucket")).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    return (counted.most or 0) > max(hot_rows, hot_times * (counted.total or 0) / buckets)


def store(
    frames: dict[str, DataFrame], edges: list[Relationship], path: str, buckets: int | None = None, least_rows: int = LEAST_ROWS, hot_rows: int = HOT_ROWS, hot_times: float = HOT_TIMES
) -> Layout:
    """Writes the tables of a star into a new folder, and the layout beside them.

    ``buckets`` (the session's shuffle partitions, if not given) should make a
    bucket of the largest table fit a task.
    """
    spark = next(iter(frames.values())).sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = {t: dict(df.dtypes) for t, df in frames.items()}
    for e in edges:
        for left, right in e.keys:
            if types[e.left][left] != types[e.right][right]:
                raise ValueError(f"{e.left}.{left} is {types[e.left][left]}, {e.right}.{right} is {types[e.right][right]}")
    linked = {t for e in edges if e.keys for t in (e.left, e.right)}
    keys = bucket_keys({t: frames[t].count() for t in linked}, edges, least_rows)
    for e in edges:  # a hot key on either side keeps both plain
        mine = [keys.get(e.left), keys.get(e.right)]
        if e.keys and mine == [tuple(k) for k in zip(*e.keys)] and any(hot(frames[t], k, buckets, hot_rows, hot_times) for t, k in zip((e.left, e.right), mine)):
            del keys[e.left], keys[e.right]
    for t, df in frames.items():
        if t in keys:
            # the exchange deals by the hash that names the buckets: a file a bucket
            dealt = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys[t]])
            dealt.write.option("path", f"{path}/{t}").format("parquet").bucketBy(buckets, *keys[t]).sortBy(*keys[t]).saveAsTable(_name(path, t))
        else:
            df.write.parquet(f"{path}/{t}")
    made = {t: {"keys": keys.get(t), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)} for t, df in frames.items()}
    spark.createDataFrame([(json.dumps({"buckets": buckets, "tables": made}),)], "value string").coalesce(1).write.text(f"{path}/layout")
    return attach(spark, path)


def attach(spark: SparkSession, path: str) -> Layout:
    """The layout in a folder; tables that this session's catalog does not know are named in it."""
    told = json.loads("".join(r.value for r in spark.read.text(f"{path}/layout").collect()))
    names = {t: _name(path, t) for t in told["tables"]}
    for t, table in told["tables"].items():
        if table["keys"]:
            by = ", ".join(f"`{k}`" for k in table["keys"])
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS `{names[t]}` ({table['schema']}) USING parquet "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {told['buckets']} BUCKETS LOCATION '{path}/{t}'"
            )
    return Layout(spark, path, told["buckets"], {t: tuple(x["keys"]) for t, x in told["tables"].items() if x["keys"]}, names)


def _name(path: str, table: str) -> str:
    """A table name in the catalog: of the folder's name and the table's."""
    return re.sub(r"\W", "_", f"{path.rstrip('/').rsplit('/', 1)[-1]}_{table}").lower()
