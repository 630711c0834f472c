"""Exact top-k inner-product search by tiled matrix products (operator 6).

Vectors become integers, floor(scale * x).  Queries and candidates are packed
into blocks (an integer matrix and its ids); a tile is one query block against
one shard of candidates: a matrix product, of which each query keeps its best
scores.  The per-query lists of the tiles are merged in a tree, a fan of shards
at a time, so no query gathers all its shards in one task.

Every query block meets every shard: that is the stated query set against all
rows, in blocks of bounded size.  The work is divided by tile, and a tile holds
QUERY_BLOCK and SHARD rows at most, whatever the vectors are.

Exactness: products are taken in float64 where every partial sum stays under
2**53, in int64 where it stays under 2**63, in Python's integers otherwise; a
score that does not fit 64 bits fails the job.

Defined results: vectors that are null, empty or hold null or non-finite
components (or components that are not finite once scaled) take no part, nor do rows with a null id; a query and a candidate of
different lengths are not compared; ties go to the smaller id.  A row is not its
own candidate: rows with the query's id are left out, rows of another id with the
same vector are not.  Repeated rows of a query id are one query (that of the smallest vector), and as often
as they occur as candidates.  Further columns are ignored; the table may be empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, column, parts, ship_library, table

SCALE, K = 1024, 10
#: Rows of a query block and of a shard.
QUERY_BLOCK, SHARD = 1024, 4096
#: Lists merged at once in the tree.
FAN = 16


def packed(rows: DataFrame, blocks: int, scale: int) -> DataFrame:
    """(block, dim, ids binary, matrix binary) of rows (id, vector): int64 or, where values are larger, decimal text.

    Rows are dealt to ``blocks`` blocks by the hash of their id and packed by
    task; a block whose rows come in several pieces has a row for each piece.
    """
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(max(1, min(blocks, 4096)), "block").sortWithinPartitions("block", "id")

    def run(batches):
        for b in batches:
            block, ids, vectors = column(b, "block").to_numpy(), column(b, "id").to_numpy(), column(b, "vector")
            lens, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lens)])
            key = np.stack([block, lens], axis=1)
            edges = np.flatnonzero((np.diff(key, axis=0, prepend=key[:1] - 1) != 0).any(axis=1))
            out = []
            for lo, hi in zip(edges, [*edges[1:], len(ids)]):
                x = np.floor(flat[starts[lo] : starts[hi]].astype(np.float64) * scale)
                out.append((int(block[lo]), int(lens[lo]), ids[lo:hi].astype(np.int64).tobytes(), _dump(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "dim", "ids", "matrix"])

    return dealt.mapInArrow(run, "block int, dim int, ids binary, matrix binary")


def _dump(x: np.ndarray) -> bytes:
    """Whole float64 values: as int16 or int64 if they fit, else as the exact floats."""
    most = np.abs(x).max(initial=0.0)
    if most < 1 << 15:
        return b"s" + x.astype(np.int16).tobytes()
    return b"q" + x.astype(np.int64).tobytes() if most < 2.0**62 else b"d" + x.tobytes()


def _load(raw: bytes, dim: int) -> np.ndarray:
    kind = {b"s": np.int16, b"q": np.int64, b"d": np.float64}[raw[:1]]
    return np.frombuffer(raw, dtype=kind, offset=1).reshape(-1, dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products a @ b.T."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0.0)) * float(np.abs(b.astype(np.float64)).max(initial=0.0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(v) for v in r] for r in a], dtype=object) @ np.array([[int(v) for v in r] for r in b], dtype=object).T
    return whole.astype(np.int64)  # an overflow raises


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of scores the k best (score, id) of other ids, ties to the smaller id; ``ids`` ascending."""
    out = []
    for row, q in zip(scores, own):
        at = np.flatnonzero(ids != q) if (ids == q).any() else np.arange(len(ids))
        s = row[at]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            above, equal = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
            pick = np.concatenate([above, equal[: k - len(above)]])  # ids ascend, so the first equal ones are the smallest
        else:
            pick = np.arange(len(s))
        pick = pick[np.lexsort((ids[at[pick]], -s[pick]))]
        out.append((s[pick], ids[at[pick]]))
    return out


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row."""
    ship_library(rows.sparkSession)
    vectors = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), is_query.alias("is_query"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    vectors = vectors.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    queries = vectors.filter("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    n, n_queries = vectors.count(), queries.count()
    blocks, shards = -(-max(1, n_queries) // query_block), -(-max(1, n) // shard)
    q = checkpoint(packed(queries, blocks, scale)).selectExpr("block AS q_block", "dim", "ids AS q_ids", "matrix AS q_matrix")
    c = packed(vectors.select("id", "vector"), shards, scale).withColumnRenamed("block", "shard")
    # the tiles: shards stay in one copy, every query block is sent to every shard
    sent = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    n_parts = max(1, min(shards, max(4096, parts(rows))))
    met = sent.repartition(n_parts, "shard", "dim").join(c.repartition(n_parts, "shard", "dim"), ["shard", "dim"])
    tiles = met.select("shard", "dim", "q_ids", "q_matrix", "ids", "matrix")

    def run(batches):
        for b in batches:
            for part, dim, q_ids, q_matrix, ids, matrix in zip(*(column(b, x).to_pylist() for x in ("shard", "dim", "q_ids", "q_matrix", "ids", "matrix"))):
                own, ids = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                x, y = _load(q_matrix, dim), _load(matrix, dim)
                for a in range(0, len(own), 128):
                    lists = best(product(x[a : a + 128], y), ids, own[a : a + 128], k)
                    sizes = [len(s) for s, _ in lists]
                    columns = [np.repeat(own[a : a + 128], sizes), np.concatenate([i for _, i in lists]), np.concatenate([s for s, _ in lists])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), part, dtype=np.int32))], ["query_id", "vec_id", "score", "part"])

    lists, width = tiles.mapInArrow(run, "query_id long, vec_id long, score long, part int"), shards
    while True:  # the tree: FAN lists become one
        width = -(-width // FAN)
        lists = _ranked(lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), k)
        if width <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


TOPK_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""

QUERIES = {"op6_topk_search": op6_topk_search}
ORACLE = {"op6_topk_search": TOPK_SQL}
