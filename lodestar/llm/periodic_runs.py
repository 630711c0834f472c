"""Periodic runs of words by a dictionary of basic factors (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of at least max(``shortest``, 2 * q) words, that no neighbouring
word extends.

Method, on the words of a step of documents at once:

1. Dictionary of basic factors: for L = 1, 2, 4, ... every stretch of L words of
   a document gets a name, equal for equal stretches of that document only.  The
   name of 2L words is that of a pair of names.  A stretch that occurs once needs
   no name, nor does a longer one around it.
2. Proposals: periods of L to 2L - 1 are looked for at length L.  The occurrences
   of a stretch that start L to 2L - 1 words after it lie within twice its length,
   so they form one arithmetic progression; its first and its last member propose
   their distances as periods.  That misses no run: were the run's period the
   distance of an inner member, the stretch would itself be periodic with the
   progression's difference d.  If that d-periodic stretch ends within the run's
   first copies, the last stretch of it has the last member at the run's period;
   if not, run and d-periodic stretch overlap by both periods, and the run's
   smallest period would be a divisor.
3. Extension: a proposal grows to both sides while the names at its distance
   agree, longest stretches first.
4. Neighbouring proposals of one period are one; of equal stretches the smallest
   period stays.

Documents are independent rows of a map: nothing is shuffled or collected, and a
lost task is simply run again.

Defined results: words are runs of other bytes than ASCII white space; a null or
empty text, or one of white space, has no words and no runs.  Repeated rows give
a row each; ids may be null.  The table may be empty; further columns are
ignored.  A very long text is a step of its own, never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_bytes, column, ship_library, steps, table

SHORTEST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Factors:
    """Names of all stretches of 1, 2, 4, ... words that occur again in their document; -1 for the others."""

    def __init__(self, words: list[bytes], ends: np.ndarray):
        code: dict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        n = len(words)
        sizes = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), sizes)
        self.n, self.end = n, np.repeat(ends, sizes)
        at, key = np.arange(n), doc * (n + 1) + np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=n)
        #: Per length: names by place, and the sorted keys name * stride + place.  No two names are within 2 * n of each other.
        self.stride = 3 * n + 1
        self.names: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        length = 1
        while len(at):
            _, name, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[name] > 1
            at, name = at[again], name[again]
            if not len(at):
                break
            names = np.full(n, -1, dtype=np.int32)
            names[at] = name
            self.names.append(names)
            self.places.append(np.sort(name * self.stride + at))
            # the next length: both halves occur again and lie in the document
            at = at[at + 2 * length <= self.end[at]]
            second = names[at + length]
            at, second = at[second >= 0], second[second >= 0]
            key = names[at].astype(np.int64) * n + second
            length *= 2

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period), neighbouring places of one period once."""
        found = []
        for k, places in enumerate(self.places):
            length = 1 << k
            first = np.searchsorted(places, places + length)
            last = np.searchsorted(places, places + 2 * length) - 1
            has = np.flatnonzero(first <= last)  # so both are of the stretch's own name
            for pick in (first[has], last[has]):
                found.append((places[pick] - places[has]) * self.stride + places[has] % self.stride)
        period, place = np.divmod(np.unique(np.concatenate(found)), self.stride) if found else np.zeros((2, 0), dtype=np.int64)
        head = (np.diff(period, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1)
        return place[head], period[head]

    def extended(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (behind the last word) of the maximal stretches of the periods around the places."""
        left, right = place.copy(), place.copy()
        for k in range(len(self.names) - 1, -1, -1):
            length, names = 1 << k, self.names[k]
            a, b = np.minimum(right, self.n - 1), np.minimum(right + period, self.n - 1)
            same = (right + period < self.n) & (names[a] >= 0) & (names[a] == names[b])
            right = np.where(same, right + length, right)
            a, b = np.maximum(left - length, 0), np.maximum(left - length + period, 0)
            same = (left >= length) & (names[a] >= 0) & (names[a] == names[b])
            left = np.where(same, left - length, left)
        return left, right + period


def runs_of(words: list[bytes], ends: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``words``), length and period of all runs of the concatenated documents, by start, then period."""
    factors = _Factors(words, ends)
    place, period = factors.proposals()
    start, end = factors.extended(place, period)
    long = end - start >= np.maximum(shortest, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)  # the smallest period of a stretch
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _gone(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row per input row: id, n_words, runs (start, length, period; by start, then period) and collapsed, the
    text without the words that a run contains after its first period (joined by one space).

    ``rewrite`` maps the id and the words of a document to the words that are judged.
    """
    ship_library(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in steps(batches, "text"):
            ids = column(b, "doc_id")
            words: list[bytes] = []
            ends = np.zeros(b.num_rows, dtype=np.int64)
            for i, (doc_id, text) in enumerate(zip(ids.to_pylist(), as_bytes(b, "text"))):
                own = (text or b"").split()
                words += rewrite(doc_id, own) if rewrite else own
                ends[i] = len(words)
            start, length, period = runs_of(words, ends, shortest)
            keep = ~_gone(len(words), start, length, period)
            begins = np.concatenate([[0], ends[:-1]])
            doc = np.searchsorted(ends, start, side="right")
            offsets = np.searchsorted(doc, np.arange(b.num_rows + 1))
            runs = pa.StructArray.from_arrays([pa.array(start - begins[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            kept = [b" ".join(words[lo:hi] if keep[lo:hi].all() else [words[j] for j in (lo + np.flatnonzero(keep[lo:hi])).tolist()]) for lo, hi in zip(begins, ends)]
            columns = [ids, pa.array(ends - begins), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("doc_id", id_col)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: a tenth of the documents, by the crc32 of their id, repeat a stretch up to their end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_report(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the longest run (ties: smallest start, then period), and digests of the runs and the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    longest = runs.withColumn("best", best)
    return longest.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.l) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
