"""Incremental workbook intake (IO-09, ST-01, ST-02).

``readStream`` over a folder of workbook files (``binaryFile`` needs an explicit
schema), ``foreachBatch`` parses and extracts each micro-batch and appends the
property rows stamped with a run id, partitioned by ``exec_id``.  A file is known
by its path, length, modification time and md5, and is taken once, whatever
checkpoint or stream delivers it: a log of the files of every run stands beside the
rows, and the run's id is that of its files.  The log is written first and counts
once the run's rows are committed, so a batch that failed in between is taken again
and nothing twice.  One stream at a time may write to an output.
``trigger(availableNow=True)`` drains what is there and stops, which is how a
scheduled job uses it.  ST-02 drops re-delivered copies of the same document
(md5 of the content): the keys are state of the stream, so a file of any age is
taken if its content was never seen, and a batch costs what it holds itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import extract as X
from lodestar.operators.dump import extracted_rows
from lodestar.sources.workbooks import BINARY_SCHEMA, ROWS_A_TASK


def workbook_stream(spark: SparkSession, folder: str, pattern: str = "*.twb", max_files: int | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """ST-01 source: new files of ``folder`` as (path, modificationTime, length, content).

    A micro-batch has its own cost (plans, state, log of runs), whatever it holds, so
    batches are cut by the bytes that they bring; by a number of files where one is given."""
    limit = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option(*limit)
        .load(folder)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Beside the rows: the files of each run (readers of the rows skip names with an underscore).
_FILES = "_files"
_FILE_SCHEMA = "path string, length long, modificationTime timestamp, content_md5 string, file_key string"


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The names of a folder's entries that start with ``prefix``."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(n for n in (s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)) if n.startswith(prefix))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def taken_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """IO-09: the log of the files whose rows are in ``out_dir``, with the run (``exec_id``) that took them."""
    base = out_dir.rstrip("/")
    runs = [n.removeprefix("exec_id=") for n in _children(spark, f"{base}/{_FILES}", "exec_id=")]
    whole = [r for r in runs if _exists(spark, f"{base}/exec_id={r}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], f"{_FILE_SCHEMA}, exec_id string")
    paths = [f"{base}/{_FILES}/exec_id={r}" for r in whole]
    return spark.read.schema(f"{_FILE_SCHEMA}, exec_id string").option("basePath", f"{base}/{_FILES}").parquet(*paths)


def write_intake_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """The dump rows of a micro-batch's files that no run has taken (every kind that extraction has), as one run.

    ``batch``: path and content, with length and modificationTime where the source
    has them.  The parsed documents are kept while the kinds are taken from them, so
    each document is parsed once."""
    spark, base = batch.sparkSession, out_dir.rstrip("/")
    for name in _children(spark, base, "exec_id="):  # rows of a run that failed while it was written
        if not _exists(spark, f"{base}/{name}/_SUCCESS"):
            _remove(spark, f"{base}/{name}")
    known = [F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in (("length", "long"), ("modificationTime", "timestamp"))]
    files = batch.select("path", "content", *known).withColumn("content_md5", F.md5(F.coalesce(F.col("content"), F.lit("")).cast("binary")))
    text = F.concat_ws("\n", F.col("path"), F.coalesce(F.col("length").cast("string"), F.lit("")), F.coalesce(F.unix_micros(F.col("modificationTime")).cast("string"), F.lit("")), F.col("content_md5"))
    keyed = files.withColumn("file_key", F.md5(text)).dropDuplicates(["file_key"])
    fresh = keyed.join(taken_files(spark, out_dir).select("file_key"), "file_key", "left_anti").persist()
    n, mark = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_key").cast("decimal(38,0)"))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))  # by documents: their bytes say little of the parse
    parsed = X.parse(fresh.repartition(tasks, "file_key")).persist()
    try:
        if not n:
            return
        run = hashlib.md5(f"stream-files-{n}-{mark}".encode()).hexdigest()  # of the files, not of the batch's number
        fresh.select("path", "length", "modificationTime", "content_md5", "file_key").write.mode("overwrite").parquet(f"{base}/{_FILES}/exec_id={run}")
        extracted_rows(parsed).write.mode("overwrite").parquet(f"{base}/exec_id={run}")
    finally:
        parsed.unpersist()
        fresh.unpersist()


_SEEN_SCHEMA = "path string, modificationTime timestamp, twb_key string, batch_id string"


def write_dedupe_batch(batch: DataFrame, batch_id: int | str, out_dir: str) -> None:
    """The documents of a micro-batch whose content no other batch has, once each (smallest path).

    The seen keys are the output table itself, but for this batch's own partition
    (a replay must not find itself); the anti-join is on the md5 key.  All keys are
    read in each batch: ``run_dedupe`` looks up those of the batch only."""
    spark = batch.sparkSession
    first = batch.groupBy("twb_key").agg(F.min_by(F.struct("path", "modificationTime"), "path").alias("f")).select("twb_key", "f.*")
    if _exists(spark, out_dir):
        seen = spark.read.schema(_SEEN_SCHEMA).parquet(out_dir).filter(F.col("batch_id") != str(batch_id)).select("twb_key")
        first = first.join(seen, "twb_key", "left_anti")
    _write_first(first, batch_id, out_dir)


def _write_first(first: DataFrame, batch_id: int | str, out_dir: str) -> None:
    first.select("path", "modificationTime", "twb_key").write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")


class FirstOfContent(StatefulProcessor):
    """A content's smallest path in the first batch that has it; nothing in later ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        first = None
        for chunk in rows:  # a content that is delivered very often comes in many chunks
            least = chunk.loc[[chunk["path"].idxmin()], ["path", "modificationTime"]]
            first = least if first is None or least["path"].iloc[0] < first["path"].iloc[0] else first
        self.seen.update((first["path"].iloc[0],))
        yield first.assign(twb_key=key[0])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((initialState["path"].iloc[0],))

    def close(self) -> None:
        pass


def first_of_content(keyed: DataFrame, seen: DataFrame) -> DataFrame:
    """ST-02: of a stream (path, modificationTime, twb_key) one row a key, ever.

    The keys are state by key, so a batch looks up its own keys only, whatever came
    before; ``seen`` (twb_key, path) is the state that a new checkpoint starts from."""
    return keyed.groupBy("twb_key").transformWithStateInPandas(
        FirstOfContent(), "path string, modificationTime timestamp, twb_key string", "Append", "None", initialState=seen.groupBy("twb_key")
    )


def _seen_before(spark: SparkSession, out_dir: str, checkpoint: str) -> DataFrame:
    """The keys that other streams, or earlier checkpoints, have written.

    What this checkpoint wrote is in its state; a replay of its first batch must not find itself."""
    if not _exists(spark, out_dir):
        return spark.createDataFrame([], "twb_key string, path string")
    seen = spark.read.schema(_SEEN_SCHEMA).parquet(out_dir)
    if _exists(spark, f"{checkpoint.rstrip('/')}/metadata"):
        own = spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        seen = seen.filter(~F.col("batch_id").startswith(own))
    return seen.groupBy("twb_key").agg(F.min("path").alias("path"))


def run_intake(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, pattern: str = "*.twb") -> None:
    """ST-01: drain new files into ``out_dir`` (partitioned by exec_id, a run for each micro-batch)."""
    src = workbook_stream(spark, folder, pattern).select("path", "length", "modificationTime", F.col("content").cast("string").alias("content"))
    write = lambda batch, batch_id: write_intake_batch(batch, batch_id, out_dir)
    q = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Keys on the executors' disks, and only a batch's changes written to the checkpoint.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_dedupe(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, pattern: str = "*.twb") -> None:
    """ST-02: keep one file of each content, whatever its modification time.

    A batch's rows are named by the checkpoint's stream and the batch, so a replay
    writes the same rows again and a new checkpoint adds to what is there."""
    src = workbook_stream(spark, folder, pattern)
    keyed = src.select("path", "modificationTime", F.md5(F.col("content")).alias("twb_key"))
    first = first_of_content(keyed, _seen_before(spark, out_dir, checkpoint))

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write_first(batch, f"{stream}-{batch_id}", out_dir)

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        q = first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
