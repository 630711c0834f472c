"""Atomic publishing of runs (WH-21): staged tables and a manifest that readers resolve.

A load writes all its tables to folders of its own, which no reader looks at.
Then one manifest file, renamed into place, names for every table and run the
folder that holds it.  So a reader sees all tables of the old state or all of the
new one; a load that fails before the rename changes nothing, and what it left is
taken away by ``vacuum``.  Two loads at once: the second finds its version taken
and builds its manifest on the other's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifests that a commit may lose to other loads before it gives up.
ATTEMPTS = 20


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, out_dir: str) -> tuple[int, dict]:
    """The newest version and its content: {table: {"schema": ..., "runs": {run: folder}}}; version 0 is empty."""
    versions = [n for n in _names(spark, f"{out_dir}/manifest") if n.endswith(".json") and not n.startswith((".", "_"))]
    if not versions:
        return 0, {}
    fs, p = _path(spark, f"{out_dir}/manifest/{versions[-1]}")
    stream = fs.open(p)
    try:
        return int(versions[-1].removesuffix(".json")), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, out_dir: str, version: int, content: dict) -> bool:
    """Puts a version's manifest in place; False if there is one already."""
    fs, target = _path(spark, f"{out_dir}/manifest/{version:012d}.json")
    _, draft = _path(spark, f"{out_dir}/manifest/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def publish(tables: dict[str, DataFrame], runs: list[str], out_dir: str) -> int:
    """Writes tables with an ``exec_id`` column and publishes them as the whole content of ``runs``; the new version.

    Runs that are published already are replaced in every table, also where they
    have no rows now; other runs stay.
    """
    spark, out_dir, load = next(iter(tables.values())).sparkSession, out_dir.rstrip("/"), uuid.uuid4().hex
    staged = {}
    for name, df in tables.items():
        folder = f"{out_dir}/staged/{name}/load={load}"
        df.filter(F.col("exec_id").isin(runs)).write.partitionBy("exec_id").parquet(folder)
        staged[name] = {n.removeprefix("exec_id="): f"load={load}/{n}" for n in _names(spark, folder) if n.startswith("exec_id=")}
    for _ in range(ATTEMPTS):
        version, old = manifest(spark, out_dir)
        new = dict(old)
        for name, df in tables.items():
            kept = {r: f for r, f in old.get(name, {}).get("runs", {}).items() if r not in runs}
            new[name] = {"schema": df.schema.json(), "runs": kept | staged[name]}
        if _commit(spark, out_dir, version + 1, new):
            return version + 1
    raise RuntimeError(f"{out_dir}: other loads were faster {ATTEMPTS} times")


def read_published(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table as the newest manifest has it."""
    return at_version(spark, out_dir, name, manifest(spark, out_dir.rstrip("/"))[1])


def at_version(spark: SparkSession, out_dir: str, name: str, content: dict) -> DataFrame:
    """A table as a manifest has it: readers of several tables take one manifest for all."""
    entry, base = content[name], f"{out_dir.rstrip('/')}/staged/{name}"
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    if not entry["runs"]:
        return spark.createDataFrame([], schema)
    paths = [f"{base}/{folder}" for folder in sorted(entry["runs"].values())]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)


def vacuum(spark: SparkSession, out_dir: str) -> int:
    """Removes staged folders that the newest manifest doesn't name; how many.  Not while a load or a reader is at work."""
    out_dir = out_dir.rstrip("/")
    content, gone = manifest(spark, out_dir)[1], 0
    for name in _names(spark, f"{out_dir}/staged"):
        used = {f.split("/")[0] for f in content.get(name, {}).get("runs", {}).values()}
        for load in _names(spark, f"{out_dir}/staged/{name}"):
            if load.startswith("load=") and load not in used:
                fs, p = _path(spark, f"{out_dir}/staged/{name}/{load}")
                gone += fs.delete(p, True)
    return gone
