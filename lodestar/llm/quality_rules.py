"""Quality rules and an isolation forest on their statistics (operator 10).

Every document gets rule statistics over its whole text.  Plain base rules
reject some documents outright; of the others, an isolation forest (random
splits of a bounded sample; anomalies are isolated after short paths) gives an
anomaly score, and a threshold calibrated on all labelled rows decides.

Words are runs of bytes other than ASCII white space.  Defined results: a null
or empty text has no words and fails the base rules; a repeated row counts as
often as it occurs; without labelled rows the forest rejects nothing; equal
scores at the threshold are kept.  A very long text is one row, never cut.
Further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import MAX_BROADCAST_IDS, MEMO_WORDS, as_bytes, checkpoint, column, compact, ship_library, small_side, steps, table

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Labelled documents that the forest is grown on (smallest hashes of their ids); the threshold takes all of them.
MAX_FIT_DOCS = 20_000
TREES = 100
SUBSAMPLE = 256
SEED = 7
#: Share of good documents that the threshold may reject, and by how many standard deviations of
#: that share the labelled ones may exceed it (few labels say little about a small share).
MAX_GOOD_LOSS, LOSS_DEVIATIONS = 0.005, 2.0
#: Ranges of scores among which the one with the threshold is looked for.
RANGES = 256

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on: by how much a ratio exceeds the range that its rule takes as ordinary
#: (so that ordinary variation does not look like an anomaly).  None depends on a text's length or language.
FEATURES = ("symbols_per_word", "upper_share", "marks_per_word", "dup_line_share", "repeat_share", "chars_per_word")
ORDINARY = ((0.0, 0.0), (0.0, 0.3), (0.0, 0.1), (0.0, 0.3), (0.0, 0.2), (3.0, 10.0))


class _Ids(dict):
    """word -> small integer, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = v = len(self)
        return v


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice (the first occurrence included)."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        codes = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # too many distinct words for one packed integer: rank the pairs first
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1].astype(np.int64)
        codes = pairs[:-1] << 32 | ids[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(codes, twice)
    cover = np.zeros(len(ids), dtype=bool)
    cover[:-2] |= at
    cover[1:-1] |= at
    cover[2:] |= at
    return int(cover.sum())


def statistics(texts: list[bytes | None], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """(n, 5) base counts and (n, 6) forest features of UTF-8 texts."""
    base, features = np.zeros((len(texts), len(BASE)), dtype=np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text or not (words := text.split()):
            continue
        if len(ids) > MEMO_WORDS:
            ids.clear()
        joined = b"".join(words)
        n, chars = len(words), len(joined.decode("utf-8", "replace"))
        symbols = len(joined) - len(joined.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines = len(lines) - len(set(lines))
        repeat = _repeat_words(np.array(list(map(ids.__getitem__, words)), dtype=np.int64))
        upper = len(joined) - len(joined.translate(None, UPPER))
        marks = len(joined) - len(joined.translate(None, MARKS))
        base[i] = n, chars, symbols, dup_lines, repeat
        features[i] = symbols / n, upper / chars, marks / n, dup_lines / len(lines), repeat / n, chars / n
    low, high = np.array(ORDINARY).T
    beyond = np.maximum(features - high, 0.0) + np.maximum(low - features, 0.0)
    return base, np.where((base[:, :1] > 0), beyond, 0.0)


def base_failed(base: np.ndarray) -> np.ndarray:
    n, repeat = base[:, 0], base[:, 4]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


@dataclass
class Forest:
    """Trees as flat arrays; ``threshold`` is the largest anomaly score that is kept."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    child: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    depth: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    norm: float = 1.0
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0..1: two to the power of minus the mean path length over its expectation."""
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, depth in zip(self.feature, self.split, self.child, self.depth, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := child[node] > 0).any():
                at = node[inner]
                right = x[rows[inner], feature[at]] >= split[at]
                node[inner] = child[at] + right
            total += depth[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """An isolation forest: each tree splits a subsample at random until rows are alone or deep enough."""
    if len(x) < 2:
        return Forest()
    rng, size = np.random.default_rng(seed), min(subsample, len(x))
    limit = int(np.ceil(np.log2(size)))
    built = []
    for _ in range(trees):
        feature, split, child, depth = [0], [0.0], [0], [0.0]
        todo = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, rows, level = todo.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if level >= limit or len(spread) == 0:
                depth[node] = level + _mean_path(len(rows))
                continue
            f = int(rng.choice(spread))
            lo, hi = rows[:, f].min(), rows[:, f].max()
            cut = hi - rng.random() * (hi - lo)  # lo < cut <= hi, so both sides hold rows
            if not lo < cut <= hi:
                cut = hi
            feature[node], split[node], child[node] = f, cut, len(feature)
            for side in (rows[rows[:, f] < cut], rows[rows[:, f] >= cut]):
                todo.append((len(feature), side, level + 1))
                feature.append(0), split.append(0.0), child.append(0), depth.append(0.0)
        built.append((feature, split, child, depth))
    width = max(len(t[0]) for t in built)
    pack = lambda k, kind: np.array([np.pad(np.array(t[k], dtype=kind), (0, width - len(t[k]))) for t in built])
    return Forest(pack(0, np.int64), pack(1, float), pack(2, np.int64), pack(3, float), max(_mean_path(size), 1e-9))


def tolerated(good: int, share: float = MAX_GOOD_LOSS) -> int:
    """How many of so many good rows may be rejected: as many as a true loss of ``share`` would reject at LOSS_DEVIATIONS above its mean."""
    return int(share * good + LOSS_DEVIATIONS * math.sqrt(share * (1.0 - share) * good) + 1e-9)


def calibrate(scored: DataFrame, max_good_loss: float | Fraction = MAX_GOOD_LOSS, ranges: int = RANGES) -> float:
    """The threshold that best separates the rows (score, good 1 or 0), and rejects at most the given share of the good ones.

    Best: the share of bad rows rejected less the share of good rows rejected.
    Equal thresholds go to the most lenient, which is put halfway to the next score.

    A sketch proposes ranges of the distinct scores; their exact counts say which
    ones can hold the threshold, and only those are ordered.
    """
    spark = scored.sparkSession
    counts = checkpoint(scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    splits = sorted(set(counts.approxQuantile("score", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))))
    ranged = counts.withColumn("range", F.size(F.filter(F.array(*map(F.lit, splits)).cast("array<double>"), lambda s: s < F.col("score"))))
    sums = ranged.groupBy("range").agg(F.min("score").alias("lo"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    all_good, all_bad = sum(r["good"] for r in sums), sum(r["bad"] for r in sums)
    if not all_good or not all_bad:
        return 1.0
    may_lose = int(Fraction(str(max_good_loss)) * all_good)
    # from the highest range down: what lies above it, and the gain of a cut at its end
    good, bad, above, known, held = 0, 0, None, 0, []
    for r in sorted(sums, key=lambda r: -r["range"]):
        if good > may_lose:
            break
        known = max(known, bad * all_good - good * all_bad)
        held.append((r["range"], good, bad, above, (bad + r["bad"]) * all_good - good * all_bad))
        good, bad, above = good + r["good"], bad + r["bad"], r["lo"]
    near = spark.createDataFrame([h[:4] for h in held if h[4] >= known], "range int, good_0 long, bad_0 long, above double")
    order = Window.partitionBy("range").orderBy(F.desc("score"))
    over = order.rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("good_0") + F.coalesce(F.sum("good").over(over), F.lit(0))
    caught = F.col("bad_0") + F.coalesce(F.sum("bad").over(over), F.lit(0))
    placed = ranged.join(F.broadcast(near), "range").select("score", lost.alias("lost"), caught.alias("caught"), F.coalesce(F.lag("score").over(order), "above").alias("next"))
    gain = F.expr(f"CAST(caught AS DECIMAL(19)) * {all_good} - CAST(lost AS DECIMAL(19)) * {all_bad}")
    cut = placed.filter(F.col("lost") <= may_lose).agg(F.max(F.struct(gain.alias("gain"), "score", "next"))).first()[0]
    return cut["score"] if cut["next"] is None else (cut["score"] + cut["next"]) / 2.0


def _mapped(df: DataFrame, names: list[str], finish, schema: str) -> DataFrame:
    """Applies ``finish(base, features)`` to the statistics of each slice of rows."""

    def run(batches):
        ids = _Ids()
        for b in steps(batches, "_text"):
            base, features = statistics(as_bytes(b, "_text"), ids)
            extra = finish(base, features)
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), *extra.values()], [*names, *extra])

    ship_library(df.sparkSession)
    return df.mapInArrow(run, schema)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, features, good int): the labelled documents that the base rules pass, repeated rows once.

    The texts stay where they are: only ids and statistics are joined.
    """
    marked, n = compact(labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good")))
    texts = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text AS _text")
    if n <= MAX_BROADCAST_IDS:  # else the statistics of all documents are taken
        texts = texts.join(F.broadcast(marked), "doc_id", "left_semi")
    finish = lambda base, features: {"failed": pa.array(base_failed(base)), "features": pa.array(list(features), pa.list_(pa.float64()))}
    rows = _mapped(texts.select("doc_id", "_text"), ["doc_id"], finish, "doc_id long, failed boolean, features array<double>")
    return rows.filter("NOT failed").select("doc_id", "features").distinct().join(small_side(marked, n), "doc_id")


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """(score, good) of (doc_id, features, good).  A map over the rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(column(b, "features").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(shipped.value.score(x)), column(b, "good")], ["score", "good"])

    return rows.select("features", "good").mapInArrow(run, "score double, good int")


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = MAX_FIT_DOCS, max_good_loss: float = MAX_GOOD_LOSS) -> Forest:
    """Forest from at most ``max_fit_docs`` labelled documents, threshold from all of them.

    Labels: doc_id, quality (1 good, 0 bad; null or other values are not
    labels).  A document with both labels is taken as bad.  The statistics of
    the forest's documents are collected (a few numbers each, bounded by the
    parameter).
    """
    rows = checkpoint(_labelled(docs, labels))
    # a hash share of at least about twice the sample goes to the ordering, however many labelled documents there are
    share = (2.0 * max_fit_docs + 100) / max(1, rows.count())
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    chosen = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_fit_docs).select("doc_id", "features").collect()
    forest = grow(np.array([r["features"] for r in sorted(chosen)]))
    if len(forest.feature):
        good = rows.filter("good = 1").count()
        forest.threshold = calibrate(_scored(rows, forest), Fraction(tolerated(good, max_good_loss), max(1, good)))
    return forest


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts, base_failed, anomaly double, kept boolean.  A map over the rows: no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(forest)
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(base, features):
        failed, score = base_failed(base), shipped.value.score(features)
        out = {n: pa.array(base[:, k]) for k, n in enumerate(BASE)}
        return out | {"base_failed": pa.array(failed), "anomaly": pa.array(score), "kept": pa.array(~failed & (score <= shipped.value.threshold))}

    cols = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
    counts = ", ".join(f"{n} long" for n in BASE)
    return _mapped(cols, ["_id"], finish, f"_id {id_type}, {counts}, base_failed boolean, anomaly double, kept boolean").withColumnRenamed("_id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
