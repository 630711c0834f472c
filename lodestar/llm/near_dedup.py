"""MinHash near-duplicate detection (operator 9).

Each document's set of word shingles gets a one-permutation sketch: one hash a
shingle, the smallest of every bin, and optimal densification (an empty bin
borrows from the first filled bin of an order of its own).  Documents with equal
sets form one class at once.  Of the class representatives, those that agree in
a band of bins share a bucket, and a bucket proposes star-shaped candidates
only: its centre with each member.  Candidates are confirmed on full sets.

A star can miss a link between two members that both differ from the centre.  So
buckets whose members are not yet one component get a second star, around the
member with most links.  Documents that still share an unsettled bucket meet once
more by an exact prefix filter (similar sets share one of their rarest shingles),
with ever more centres a round, until every such bucket is one component or
all its pairs were tried.  Nothing is capped.

With 48 bands of 6 bins, two sets at similarity 0.8 share no band with a
probability of (1 - 0.8**6)**48, about five in ten million.

Defined results: words are runs of other bytes than ASCII white space, A-Z
lower-cased; fewer words than a shingle form one shingle of all of them; a null
text or one without words has an empty set and is linked with nothing.  Repeated
rows (same id and text) are one document and give a row each; texts that share an
id are documents of their own, in the order of their digests.  Rows with a null id
come after all others: in the report they have a null component and are kept; where
rows are dropped, a null-id copy goes, and of copies that all lack an id the one
with the smallest digest stays.  The table may be empty; further columns are
ignored.  A very long text is one row, never cut.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WordHash, as_bytes, checkpoint, column, compact, keyed_documents, mix, ship_library, small_side, steps, table, tidy
from lodestar.llm.graph import components

BANDS, ROWS = 48, 6
#: By how much the centres of an unsettled bucket grow from round to round.
MORE_CENTRES = 32
#: Full sets that a partition holds.
SETS_PER_PARTITION = 4_096
SEED = 9
#: Documents whose sketches are densified at once.
BLOCK = 1024


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each bin its own random order of all bins."""
    rng = np.random.default_rng((SEED, bins))
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def shingles(text: bytes | None, hashes: WordHash, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.int64).view(np.uint64)
    n = max(1, len(h) - size + 1)
    taken = min(size, len(h))
    acc = np.full(n, np.uint64(taken), dtype=np.uint64)  # a shorter sequence never equals a full shingle
    for j in range(taken):
        acc = mix(acc ^ h[j : j + n]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(acc))


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(len(sets), bins) one-permutation minima, densified; the sets must not be empty."""
    out, filled = np.zeros((len(sets), bins), dtype=np.uint64), np.zeros((len(sets), bins), dtype=bool)
    for i, s in enumerate(sets):
        b = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out[i, b[first]], filled[i, b[first]] = s[first], True
    order, (doc, at) = _donors(bins), np.nonzero(~filled)
    for t in range(bins):
        if not len(doc):
            break
        donor = order[at, t]
        has = filled[doc, donor]
        out[doc[has], at[has]] = out[doc[has], donor[has]]
        doc, at = doc[~has], at[~has]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for j in range(rows):
        acc = mix(acc ^ parts[:, :, j]) + np.uint64(0x9E3779B97F4A7C15)
    return acc.view(np.int64)


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id long, n_shingles long, set_key binary, bands array<long>) of (doc_id, text); the last two null for empty sets."""

    def run(batches):
        import xxhash

        hashes = WordHash()
        for b in steps(batches, "text"):
            ids, texts = column(b, "doc_id"), as_bytes(b, "text")
            for a in range(0, len(texts), BLOCK):
                hashes.trim()
                sets = [shingles(t, hashes, size) for t in texts[a : a + BLOCK]]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(sketch(full, bands * rows), bands, rows).tolist() if full else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, BLOCK),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, items array<long>): the whole shingle set of each document."""

    def run(batches):
        hashes = WordHash()
        for b in steps(batches, "text", 1 << 20):
            hashes.trim()
            sets = [shingles(t, hashes, size).view(np.int64) for t in as_bytes(b, "text")]
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "items"])

    return docs.mapInArrow(tidy(run), "doc_id long, items array<long>")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, root): the smallest document linked, for documents (doc_id, text) with unlike ids.

    Links: 100 * intersection >= percent * union of the sets of ``size``-word shingles.
    """
    sk = checkpoint(sketches(docs, size, bands, rows))
    # equal sets: one class, represented by its smallest id (grouped minimum, combined before the shuffle)
    reps = checkpoint(
        sk.filter("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    )
    roots = _linked(docs, reps, size, percent)
    placed = sk.select("doc_id", "n_shingles", "set_key").join(reps.select("set_key", "rep"), "set_key", "left")
    return placed.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest linked id, its own included), kept.  Options as in ``classes``."""
    ship_library(df.sparkSession)
    keyed, key, numbers = keyed_documents(df.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col)
    out = classes(keyed.select(F.col(key).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), **options)
    if numbers is None:
        return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("root").alias("component_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
    named = out.join(numbers.toDF("doc_id", "own"), "doc_id").join(numbers.toDF("root", "of"), "root")
    has_id = F.col("own").isNotNull()
    return named.select(F.col("own").alias(id_col), "n_shingles", F.when(has_id, F.col("of")).alias("component_id"), (~has_id | (F.col("doc_id") == F.col("root"))).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept: of each group of near duplicates the first document, once.  Options as in ``classes``."""
    ship_library(df.sparkSession)
    keyed, key, _ = keyed_documents(df, id_col, text_col)
    found = classes(keyed.select(F.col(key).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), **options)
    verdict = checkpoint(found.select(F.col("doc_id").alias(key), (F.col("doc_id") == F.col("root")).alias("kept")))
    gone = small_side(*compact(verdict.filter("NOT kept").select(key).distinct()))
    left = keyed.join(gone, key, "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    repeated, n = compact(verdict.filter("kept").groupBy(key).count().filter("count > 1").select(key))
    if not n:
        return left.select(*columns)
    repeated = small_side(repeated, n)
    # rows that repeat an id and its text are one document
    again = left.join(repeated, key, "left_semi").dropDuplicates([key])
    return left.join(repeated, key, "left_anti").select(*columns).unionByName(again.select(*columns))


class _Links:
    """Confirmed links between representatives, the pairs tried, and the components so far."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tried = self.links = sets.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0)
        self.roots = sets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")).limit(0)

    def test(self, pairs: DataFrame) -> None:
        """Confirms the pairs (u < v) that were not tried before, on full sets."""
        fresh, n = compact(pairs.join(self.tried, ["u", "v"], "left_anti"))
        if not n:
            return
        confirmed, n = compact(_confirm(small_side(fresh, n), self.sets, self.percent))
        self.tried = compact(self.tried.union(fresh))[0]
        if n:
            self.links = compact(self.links.union(confirmed))[0]
            self.roots = components(self.roots.selectExpr("node AS u", "root AS v").union(confirmed))

    def open(self, members: DataFrame) -> tuple[DataFrame, int]:
        """The rows of buckets that are more than one component, with root and degree (number of links); how many."""
        ends = self.links.select(F.explode(F.array("u", "v")).alias("rep"))
        known = self.roots.withColumnRenamed("node", "rep").join(ends.groupBy("rep").agg(F.count("*").alias("degree")), "rep")
        labelled = members.join(known, "rep", "left").withColumns({"root": F.coalesce("root", "rep"), "degree": F.coalesce("degree", F.lit(0))})
        split = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        return compact(labelled.join(split, "bucket"))


def _linked(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the class representatives that have confirmed links."""
    rows = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    members, _ = compact(rows.join(shared, "bucket"))  # only buckets with company
    wanted, n = compact(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = checkpoint(full_sets(docs.join(small_side(wanted, n), "doc_id", "left_semi"), size).dropDuplicates(["doc_id"]))
    sets = sets.coalesce(max(1, -(-n // SETS_PER_PARTITION)))
    links = _Links(sets, percent)
    links.test(_stars(members.withColumns({"root": F.col("rep"), "degree": F.lit(0)}), 1, percent))
    left, n = links.open(members)
    if n:
        links.test(_stars(left, 1, percent))  # now around the members with most links
        left, n = links.open(members)
    if not n:
        return links.roots
    # what still shares a bucket without being one component meets again on its rarest shingles only
    still = small_side(*compact(left.select(F.col("rep").alias("doc_id")).distinct()))
    rare, _ = compact(_rare_buckets(sets.join(still, "doc_id", "left_semi"), percent))
    centres = 1
    while True:
        left, _ = links.open(rare)
        largest = left.groupBy("bucket").count().agg(F.max("count")).first()[0]
        if largest is None:
            return links.roots
        links.test(_stars(left, min(centres, largest), percent, every=centres >= largest))
        if centres >= largest:  # every member was a centre: all pairs are tried
            return links.roots
        centres *= MORE_CENTRES


def _rare_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep, n, pos): the shingles that two similar sets must share one of.

    With all shingles in one order, rare ones first, sets of the similarity agree in
    one of their first n - ceil(percent * n / 100) + 1 shingles (prefix filter).
    """
    rows = sets.select(F.col("doc_id").alias("rep"), F.size("items").cast("long").alias("n"), F.explode("items").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count("*").alias("docs"))
    order = Window.partitionBy("rep").orderBy("docs", "bucket")
    placed = rows.join(often, "bucket").withColumn("pos", F.row_number().over(order).cast("long") - 1)
    return placed.filter(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).filter("docs > 1").select("bucket", "rep", "n", "pos")


def _stars(members: DataFrame, centres: int, percent: int, every: bool = False) -> DataFrame:
    """Pairs (u < v) of a centre with a member of its bucket that is not in its component.

    Centres: of each of so many hashed groups of a bucket the member with most links,
    then the smallest id; or every member.  Pairs whose sizes, or whose places of a
    shared rare shingle, rule the similarity out are no candidates.
    """
    placed = "pos" in members.columns
    cols = ["rep", "n", "root", *(["pos"] if placed else [])]
    if every:
        heads = members.select("bucket", *cols)
    else:
        group = F.pmod(F.xxhash64("rep", F.lit(centres)), F.lit(centres))
        heads = members.groupBy("bucket", group.alias("g")).agg(F.min(F.struct((-F.col("degree")).alias("d"), *cols)).alias("c")).select("bucket", "c.*")
    heads = heads.select("bucket", *[F.col(c).alias(f"c_{c}") for c in cols])
    fits = f"rep <> c_rep AND root <> c_root AND 100 * least(n, c_n) >= {percent} * greatest(n, c_n)"
    if placed:  # the first shared shingle in the common order bounds the intersection
        fits += f" AND (100 + {percent}) * (1 + least(n - 1 - pos, c_n - 1 - c_pos)) >= {percent} * (n + c_n)"
    return members.join(heads, "bucket").filter(fits).selectExpr("least(rep, c_rep) AS u", "greatest(rep, c_rep) AS v").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.selectExpr("doc_id AS u", "items AS a"), sets.selectExpr("doc_id AS v", "items AS b")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    return both.filter(f"100 * common >= {percent} * (sizes - common)").select("u", "v")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


QUERIES = {"op9_near_dedup": op9_near_dedup}
