"""Helpers shared by the operators: table access, batches, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space that separates words: [\x20\x09-\x0D].  ``bytes.split()``
# splits at exactly these bytes, so UTF-8 text needs no decoding for words.
WORD_SPLIT_SQL = r"[\x20\x09-\x0D]+"

#: Words whose hashes a worker keeps; the memo is emptied beyond it.
MEMO_WORDS = 200_000
#: Bytes of an Arrow batch between Spark and its Python workers (and one row beyond it).
BATCH_BYTES, _BATCH_KEY = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: UTF-8 bytes of text that one vectorised step takes (a longer text is a step of its own).
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_library(spark: SparkSession) -> None:
    """Prepares a session for the operators' Python workers.

    They must have this library's modules, which the driver sends, and get Arrow
    batches of bounded bytes: rows hold whole texts, and Spark's default of 64 MB a
    batch is held several times over between the JVM and the worker.  A bound that
    the session has set itself stays.
    """
    from lodestar.session import ship_library as ship

    if spark.conf.get(_BATCH_KEY, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (tests: a folder of the local session)."""
    from lodestar.session import checkpoint_dir

    return checkpoint_dir(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a partition of a compacted table holds.
COMPACT_ROWS = 200_000


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint in as many partitions as its counted rows ask for, and the count.

    Iterations over tables that have become small otherwise write a file for every
    pair of partitions; a table of one partition needs no exchange at all.
    """
    kept = checkpoint(df)
    n = kept.count()
    return kept.coalesce(max(1, -(-n // COMPACT_ROWS))), n


#: Rows of a counted table of ids or id pairs (8 or 16 bytes each) up to which it is broadcast.
MAX_BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame, n: int) -> DataFrame:
    """The counted ids as a broadcast side where they are within the bound; joined by exchange beyond it."""
    return F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_documents(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame | None]:
    """``df`` with a further column, its name, and a table of the column's values (doc, id) or None.

    The column is a long for each distinct (id, text), in the order of ids (nulls
    last), then of text digests.  Where every row has an id and no id has two
    texts, that is the id itself, without a table.  If not, documents are numbered.
    """
    doc_id, text, key = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), fresh(df, "_doc")
    ids = df.select(doc_id.alias("i"), F.xxhash64(text).alias("h")).groupBy("i").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    if not ids.filter("i IS NULL OR lo <> hi").limit(1).count():
        return df.withColumn(key, doc_id), key, None
    columns = df.columns
    place, digest = fresh(df, "_place"), fresh(df, "_digest")
    named = df.withColumns({place: doc_id, digest: F.coalesce(F.md5(text.cast("binary")), F.lit(""))})
    found = named.select(F.col(place).alias("id"), F.col(digest).alias("digest")).distinct()
    numbers = checkpoint(found.orderBy(F.asc_nulls_last("id"), "digest").withColumn("doc", F.monotonically_increasing_id()))
    a, b = named.alias("a"), numbers.alias("b")
    keyed = a.join(b, F.col(f"a.{place}").eqNullSafe(F.col("b.id")) & (F.col(f"a.{digest}") == F.col("b.digest")))
    return keyed.select(*[F.col(f"a.`{c}`") for c in columns], F.col("b.doc").alias(key)), key, numbers.select("doc", "id")


def tidy(run):
    """The map ``run`` over a task's batches, giving memory back when they end: Spark uses its Python workers again,
    and what one stage's batches held would otherwise stay on top of the next stage's."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return mapped


def parts(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's shuffle setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that the texts of a slice hold at most ``limit`` bytes, or are one text."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
            yield batch
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        ends, start = np.cumsum(lens, dtype=np.int64), 0
        while start < n:
            base = ends[start] - lens[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return column(batch, name).cast(pa.binary()).to_pylist()


class WordHash(dict):
    """word (bytes) -> signed 64-bit hash, remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        v = xxhash.xxh3_64_intdigest(word)
        v = v - (1 << 64) if v >> 63 else v
        self[word] = v
        return v

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrap-around arithmetic) over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written, through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
