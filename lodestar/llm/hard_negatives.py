"""Hard-negative mining with Four-Russians scoring (operator 12).

Vectors become integers, floor(scale * x).  A candidate's integers are stored as
bit planes: of every eight dimensions one byte a plane.  For an anchor, a table of
256 subset sums is made once for every eight dimensions.  A candidate's score is
then read off: per plane, from the sign's down, the sum so far is doubled and the
table entries of the plane's bytes are added (the sign's are taken off).  These
are the full inner products, exactly.

Two passes over tiles, a block of anchors against a shard of candidates:

1. Positives.  Shards are made by label: all rows of a small label are in one, a
   large label has several.  So an anchor meets the rows of its label, and few
   others.  Each tile gives its best rows of the anchors' labels.
2. Negatives.  Every block of anchors, with its positives' scores, is sent to every
   shard (that is the stated set of anchors against all rows).  Each tile gives the
   best rows of other labels between the bounds of each positive.

The lists of the tiles are cut again to the best ones, in the tasks before the
shuffle too.  Shards are packed once and stay where they are; only blocks of
anchors are copied.  A label with a third of all rows is many shards.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part, nor do vectors with a component so large that
scores might leave 64 bits (|scale * x| * sqrt(length) of 2**31 or more).  Vectors
of different lengths are not compared; empty ones score 0 with each other.  Ties
go to the smaller id.  Rows with the anchor's id are neither its positives nor its
negatives.  Repeated rows of an anchor id are one anchor (that of the smallest
label, then vector), and as often as they occur positives and negatives.  The
table may be empty; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, column, compact, parts, ship_library, small_side, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a shard, anchors of a block, candidates scored at once.
SHARD, BLOCK, CHUNK = 4096, 128, 1024


def bit_planes(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of bits b of the whole numbers x (rows, dim), and (b, groups of 8 dimensions, rows) bytes; plane b - 1 has the signs."""
    rows, dim = x.shape
    bits = 1 + max(int(x.max(initial=0)).bit_length(), (-1 - int(x.min(initial=0))).bit_length())
    wide = np.zeros((rows, -(-dim // 8) * 8), dtype=np.int64)
    wide[:, :dim] = x
    out = np.empty((bits, wide.shape[1] // 8, rows), dtype=np.uint8)
    for j in range(bits):
        out[j] = np.packbits((wide >> j & 1).astype(np.uint8), axis=1, bitorder="little").T
    return bits, out


def subset_sums(anchors: np.ndarray, kind: type) -> list[np.ndarray]:
    """For each eight dimensions (256, anchors): the sums of every subset of an anchor's eight integers."""
    out = []
    for a in range(0, anchors.shape[1], 8):
        sums = np.zeros((256, len(anchors)), dtype=kind)
        for i, values in enumerate(anchors[:, a : a + 8].T.astype(kind)):
            sums[1 << i : 2 << i] = sums[: 1 << i] + values
        for i in range(min(8, anchors.shape[1] - a), 8):  # dimensions that are not there
            sums[1 << i : 2 << i] = sums[: 1 << i]
        out.append(sums)
    return out


def scores(sums: list[np.ndarray], planes: np.ndarray, anchors: int, kind: type) -> np.ndarray:
    """(candidates, anchors): the inner products."""
    bits, _, rows = planes.shape
    out = np.zeros((rows, anchors), dtype=kind)
    found = np.empty_like(out)
    for j in range(bits - 1, -1, -1):
        if j < bits - 1:
            np.left_shift(out, 1, out=out)
        for table_, byte in zip(sums, planes[j]):
            np.take(table_, byte, axis=0, out=found, mode="clip")
            (np.subtract if j == bits - 1 else np.add)(out, found, out=out)
    return out


def best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The places among ``at`` of the k best scores, ties to the smaller id (``ids`` ascend)."""
    s = score[at]
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        above, equal = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
        pick = np.concatenate([above, equal[: k - len(above)]])
    else:
        pick = np.arange(len(s))
    return at[pick[np.lexsort((ids[at[pick]], -s[pick]))]]


def bounds(score: int) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives: LOW * score <= 100 * negative <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _dealt(rows: DataFrame, cells: int) -> DataFrame:
    """The rows by cell (c1, c2) and length of their vectors, in as many partitions as there are cells, within reason."""
    return rows.withColumn("dim", F.size("vector")).repartition(max(1, min(cells, max(4096, parts(rows)))), "c1", "c2", "dim")


def _cuts(b: pa.RecordBatch, limit: int) -> list[tuple[int, int]]:
    """The pieces of a sorted batch that have one cell and length and at most ``limit`` rows."""
    key = np.stack([column(b, c).to_numpy() for c in ("c1", "c2", "dim")])
    edges = [*np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, b.num_rows]
    out, lo = [], 0
    for hi in edges:
        out += [(a, min(a + limit, hi)) for a in range(lo, hi, limit)]
        lo = hi
    return out


def _matrix(b: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    flat = column(b, "vector").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(hi - lo, column(b, "dim")[lo].as_py())


def _shards(rows: DataFrame, cells: int) -> DataFrame:
    """(c1, c2, dim, ids, labels, bits, planes) of rows (c1, c2, id, label, vector): ids ascend within a shard."""

    def run(batches):
        for b in batches:
            ids, labels = column(b, "id").to_numpy(), column(b, "label").to_numpy()
            out = []
            for lo, hi in _cuts(b, SHARD) if b.num_rows else ():
                bits, planes = bit_planes(_matrix(b, lo, hi))
                out.append((*(column(b, c)[lo].as_py() for c in ("c1", "c2", "dim")), ids[lo:hi].tobytes(), labels[lo:hi].tobytes(), bits, planes.tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["c1", "c2", "dim", "ids", "labels", "bits", "planes"])

    dealt = _dealt(rows, cells).sortWithinPartitions("c1", "c2", "dim", "id")
    return dealt.mapInArrow(run, "c1 long, c2 long, dim int, ids binary, labels binary, bits int, planes binary")


_ANCHORS = ("a_ids", "a_labels", "a_matrix", "p_counts", "p_ids", "p_scores")


def _blocks(rows: DataFrame, cells: int) -> DataFrame:
    """(c1, c2, dim, a_ids, a_labels, a_matrix, p_counts, p_ids, p_scores) of rows (c1, c2, id, label, vector, positives)."""

    def run(batches):
        for b in batches:
            ids, labels, positives = column(b, "id").to_numpy(), column(b, "label").to_numpy(), column(b, "positives")
            out = []
            for lo, hi in _cuts(b, BLOCK) if b.num_rows else ():
                own = positives.slice(lo, hi - lo)
                flat = own.flatten()
                packs = (ids[lo:hi], labels[lo:hi], _matrix(b, lo, hi), np.diff(own.offsets.to_numpy()).astype(np.int64), flat.field("id").to_numpy(), flat.field("score").to_numpy())
                out.append((*(column(b, c)[lo].as_py() for c in ("c1", "c2", "dim")), *(x.tobytes() for x in packs)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * len(_ANCHORS))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["c1", "c2", "dim", *_ANCHORS])

    dealt = _dealt(rows, cells).sortWithinPartitions("c1", "c2", "dim", "id")
    return dealt.mapInArrow(run, "c1 long, c2 long, dim int, " + ", ".join(f"{c} binary" for c in _ANCHORS))


def _tile(row: dict, positives: int | None, k: int):
    """The best rows of a tile: (anchor_id, no, positive_id, positive_score, id, score) arrays.

    ``positives``: how many rows of the anchor's label are wanted; None for the ``k`` negatives of each positive.
    """
    whole = lambda c: np.frombuffer(row[c], dtype=np.int64)
    own, own_labels, ids, labels = whole("a_ids"), whole("a_labels"), whole("ids"), whole("labels")
    anchors = whole("a_matrix").reshape(len(own), row["dim"])
    planes = np.frombuffer(row["planes"], dtype=np.uint8).reshape(row["bits"], -(-row["dim"] // 8), len(ids))
    largest = max(int(anchors.max(initial=0)), -int(anchors.min(initial=0)))
    kind = np.int32 if largest * row["dim"] << row["bits"] < 1 << 31 else np.int64
    sums = subset_sums(anchors, kind)
    score = np.concatenate([scores(sums, planes[:, :, a : a + CHUNK], len(own), kind) for a in range(0, len(ids), CHUNK)])
    score = np.ascontiguousarray(score.T).astype(np.int64, copy=False)
    firsts = np.concatenate([[0], np.cumsum(whole("p_counts"))])
    p_ids, p_scores = whole("p_ids"), whole("p_scores")
    out = []
    for i, (anchor, label) in enumerate(zip(own.tolist(), own_labels.tolist())):
        other = ids != anchor
        if positives is not None:
            at = best(score[i], ids, np.flatnonzero(other & (labels == label)), positives)
            out.append((anchor, 0, 0, 0, ids[at], score[i][at]))
            continue
        unlike = np.flatnonzero(other & (labels != label))
        s = score[i][unlike]
        for no, j in enumerate(range(firsts[i], firsts[i + 1])):
            low, high = bounds(int(p_scores[j]))
            at = best(score[i], ids, unlike[(s >= low) & (s <= high)], k)
            out.append((anchor, no, p_ids[j], p_scores[j], ids[at], score[i][at]))
    sizes = [len(r[4]) for r in out]
    fixed = [np.repeat(np.array([r[c] for r in out], dtype=np.int64), sizes) for c in range(4)]
    return [*fixed, *(np.concatenate([r[c] for r in out]) if out else np.zeros(0, np.int64) for c in (4, 5))]


_FOUND = ["anchor_id", "no", "positive_id", "positive_score", "id", "score"]


def _met(blocks: DataFrame, shards: DataFrame, cells: int, positives: int | None, k: int) -> DataFrame:
    """The rows that the tiles of equal cells give."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = _tile(b.slice(i, 1).to_pylist()[0], positives, k)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], _FOUND)

    n = max(1, min(cells, max(4096, parts(shards))))
    tiles = blocks.repartition(n, "c1", "c2", "dim").join(shards.repartition(n, "c1", "c2", "dim"), ["c1", "c2", "dim"])
    return tiles.mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: of each anchor's best
    ``positives`` rows of its label the best ``negatives`` rows of other labels between the bounds."""
    ship_library(rows.sparkSession)
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    typed = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), (F.col(f"`{vector_col}`").cast("array<double>")).alias("x"), is_anchor.alias("is_anchor"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) * F.sqrt(F.size("x")) < 2.0**31))
    usable = typed.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(fits)
    vectors = checkpoint(usable.select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("vector"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")))
    n = vectors.count()
    cells = max(1, -(-n // shard))

    # pass 1: shards by label; only labels of more than a shard need be known (at most n / shard of them)
    large, n_large = compact(vectors.groupBy("label").count().filter(F.col("count") > shard).select("label", F.ceil(F.col("count") / shard).alias("pieces")))
    placed = vectors.join(small_side(large, n_large), "label", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("c1", F.pmod(F.xxhash64("label"), F.lit(cells)))
    shards = _shards(placed.withColumn("c2", F.pmod(F.xxhash64("id"), F.col("pieces"))), cells)
    anchors = placed.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vector", "c1", "pieces")).alias("a")).select("id", "a.*")
    nothing = F.array().cast("array<struct<id:bigint,score:bigint>>")
    sent = anchors.withColumn("c2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("positives", nothing)
    found = _met(_blocks(sent, cells), shards, cells, positives, 0)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= positives)
    lists = ranked.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))

    # pass 2: every block of anchors to every shard
    both = anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vector", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    groups = max(1, -(-vectors.filter("is_anchor").count() // BLOCK))
    blocks = checkpoint(_blocks(both.withColumns({"c1": F.pmod(F.xxhash64("id"), F.lit(groups)), "c2": F.lit(0).cast("long")}), groups))
    everywhere = blocks.withColumn("c1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    mixed = _shards(vectors.withColumns({"c1": F.pmod(F.xxhash64("id"), F.lit(cells)), "c2": F.lit(0).cast("long")}), cells)
    found = _met(everywhere, mixed, cells, None, negatives)
    by_score = Window.partitionBy("anchor_id", "no").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label_col=label)


HARD_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM e a JOIN e c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2, 3),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {"op12_hard_negatives": HARD_NEGATIVES_SQL}
