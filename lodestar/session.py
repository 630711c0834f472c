"""Spark session defaults for workbook analytics.

On a cluster the session is created by the platform; ``configure`` only sets
SQL options that are safe to change at runtime.  ``local_session`` is for
tests, benches and the smoke entry point.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime SQL options every job relies on.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only small, size-checked sides; AQE converts at runtime when a
    # shuffle stage turns out to be small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the options that this session has not set itself; a caller's own values stay."""
    own = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in SQL_DEFAULTS.items():
        if key not in own and (key == "spark.sql.session.timeZone" or spark.conf.get(key, None) is None):
            spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Sends this library's modules to the executors, once an application: their Python workers import it.

    The archive is served by the driver for as long as the application runs.  A
    library that was itself given to the application as an archive is there already.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestar-modules-"), "lodestar.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, module.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lodestar") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LODESTAR_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` as the cluster names it.  Only in local mode,
    where driver and tasks share one machine, a scratch folder is created when it
    is unset; on a cluster that is an error, as executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        configured = tempfile.mkdtemp(prefix="lodestar-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured
