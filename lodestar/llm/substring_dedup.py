"""Removal of repeated word passages by super-k-mer partitioning (operator 3).

A window is ``k`` consecutive words of a document.  Its minimiser is the
smallest hash among its runs of ``m`` words (leftmost on ties).  Consecutive
windows whose minimiser is the same run form a super-k-mer, which travels as one
packed string to the bucket of that minimiser; equal windows always meet there,
and sorting the bucket's windows shows which occurrence starts first.  All later
occurrences mark their words for removal.

The job is one Spark plan:

1. Every text is cut into super-k-mers; only (minimiser, place) is shuffled.  A
   minimiser that occurs once in the corpus belongs to windows that occur once,
   so those super-k-mers end here (an exact test, not a cap).
2. The others are packed from the texts and shuffled by minimiser, sorted and
   compared.
3. The marked intervals are joined to the documents by id.

Hot groups: equal super-k-mers of a batch are settled within it (only the first
goes on), and a minimiser with very many super-k-mers is *hot*: its windows
travel one by one, by the hash of the window, again only the first of a batch.
So no bucket holds more than ``HOT_TOTAL`` packed strings, and a window that is
in every document reaches its bucket once a batch.

Defined results: words are runs of bytes other than ASCII white space; a null
text has none.  Windows are judged on the input.  Rows with equal id and text are
one document: neither starts earlier than the other at the same word.  Texts that
share an id are documents in the order of their digests, and so are texts without
an id, after all that have one (the largest long included).  The table may be
empty and may have further columns, which are ignored.  A text is one row and
never cut.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WordHash, as_bytes, column, keyed_documents, mix, parts, ship_library, steps, tidy, table

#: Words of a window, and words of the runs that minimisers are taken from.
K, M = 20, 4
#: Super-k-mers with one minimiser in a batch, and in all, from which it is hot.
HOT_LOCAL, HOT_TOTAL = 64, 4096
STEP = 2 << 20
# Kinds of marks.
_OPEN, _HOT, _REMOVE = 0, 1, 2


def _minimisers(h: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of concatenated documents: first word, number of windows, hash of the minimiser.

    ``h``: word hashes; ``ends``: where each document ends.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < k:
        return none, none, none
    n = len(h) - m + 1
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(m):
        runs = mix(runs ^ h[j : j + n].view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    value, place, width, w = runs, np.arange(n), 1, k - m + 1
    while width < w:  # the smallest of ever more neighbours, the leftmost on ties
        shift = min(width, w - width)
        right = value[shift:] < value[: len(value) - shift]
        place = np.where(right, place[shift:], place[: len(place) - shift])
        value = np.where(right, value[shift:], value[: len(value) - shift])
        width += shift
    doc_end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(place)) + k <= doc_end[: len(place)])
    if not len(at):
        return none, none, none
    place = place[at]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return at[first], np.diff(first, append=len(at)), runs[place[first]].view(np.int64)


def _mark(k: int, m: int):
    """Step 1 on (did, text): rows (key, did, mark, many)."""

    def run(batches):
        hashes = WordHash()
        for b in steps(batches, "text", STEP):
            hashes.trim()
            texts = as_bytes(b, "text")
            words: list[bytes] = []
            ends = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                words += (t or b"").split()
                ends[i] = len(words)
            first, n, key = _minimisers(np.array(list(map(hashes.__getitem__, words)), dtype=np.int64), ends, k, m)
            if not len(first):
                continue
            doc = np.searchsorted(ends, first, side="right")
            did = column(b, "did").to_numpy()[doc]
            start = first - np.concatenate([[0], ends[:-1]])[doc]
            kind, many = np.zeros(len(first), dtype=np.int64), np.ones(len(first), dtype=np.int64)
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            company = np.flatnonzero(counts[inverse] > 1)
            if len(company):
                # equal super-k-mers of this batch: only the earliest can be the corpus's first
                strings = [b" ".join(words[a : a + c + k - 1]) for a, c in zip(first[company].tolist(), n[company].tolist())]
                places = list(zip(did[company].tolist(), start[company].tolist()))
                earliest: dict[bytes, tuple] = {}
                for s, p in zip(strings, places):
                    if s not in earliest or p < earliest[s]:
                        earliest[s] = p
                kind[company] = [_REMOVE if p != earliest[s] else _OPEN for s, p in zip(strings, places)]
                left = Counter(key[company[kind[company] == _OPEN]].tolist())
                hot = {x for x, c in left.items() if c >= HOT_LOCAL}
                if hot:
                    seen = set()
                    for i in company[kind[company] == _OPEN].tolist():
                        if (x := int(key[i])) in hot:
                            many[i] = HOT_TOTAL  # tells the other batches
                            if x in seen:
                                kind[i] = _HOT
                            seen.add(x)
                # settled removals that follow one another in a document become one
                follows = np.flatnonzero((kind[1:] == _REMOVE) & (kind[:-1] == _REMOVE) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + n[:-1])) + 1
                heads = np.setdiff1d(np.arange(len(kind)), follows)
                n = np.add.reduceat(n, heads)
                key, did, start, kind, many = (x[heads] for x in (key, did, start, kind, many))
                alone = kind != _OPEN  # need not meet their minimiser: spread evenly
                key = np.where(alone, mix(mix(did.view(np.uint64)) + start.astype(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(did), pa.array(start << 32 | n << 2 | kind), pa.array(many)], ["key", "did", "mark", "many"]
            )

    return run


def _unpacked(batches):
    """Batches whose struct ``doc`` (text and further columns) is laid open."""
    for b in batches:
        doc = column(b, "doc")
        fields = {f.name: doc.field(f.name) for f in doc.type}
        rest = {n: column(b, n) for n in b.schema.names if n != "doc"}
        yield pa.RecordBatch.from_arrays([*fields.values(), *rest.values()], [*fields, *rest])


def _packed(k: int):
    """Step 2 on (did, doc, marks): rows (key, s, did, start, n) with the packed strings; n = -words for settled removals."""

    def run(batches):
        import xxhash

        for b in steps(_unpacked(batches), "text", STEP):
            out: list[tuple] = []
            hot: dict[bytes, tuple] = {}
            marks = column(b, "marks")
            offsets = marks.offsets.to_numpy()
            flat = marks.values
            mark, key = flat.field("mark").to_numpy(zero_copy_only=False).tolist(), flat.field("key").to_numpy(zero_copy_only=False).tolist()
            for i, (did, text) in enumerate(zip(column(b, "did").to_pylist(), as_bytes(b, "text"))):
                words = text.split()
                for j in range(offsets[i], offsets[i + 1]):
                    start, n, kind = mark[j] >> 32, mark[j] >> 2 & 0x3FFFFFFF, mark[j] & 3
                    if kind == _REMOVE:
                        out.append((key[j], None, did, start, -(n + k - 1)))
                    elif kind == _OPEN:
                        out.append((key[j], b" ".join(words[start : start + n + k - 1]), did, start, n))
                    else:
                        for a in range(start, start + n):
                            s, here = b" ".join(words[a : a + k]), (did, a)
                            best = hot.get(s)
                            if best is None:
                                hot[s] = here
                                continue
                            late = max(best, here)
                            hot[s] = min(best, here)
                            if late != hot[s]:
                                out.append((key[j], None, *late, -k))
            out += [(xxhash.xxh3_64_intdigest(s) - (1 << 63), s, *place, 1) for s, place in hot.items()]
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "s", "did", "start", "n"])

    return run


def _compare(k: int):
    """Buckets, sorted by (key, s, did, start): rows (did, start, words) to be removed."""

    def settle(group: list[tuple]) -> list[tuple]:
        """Intervals of a bucket's windows that start earlier elsewhere."""
        windows = []
        for s, did, start, n in group:
            cut = [0, *(i + 1 for i, c in enumerate(s) if c == 32), len(s) + 1]
            windows += [(s[cut[i] : cut[i + k] - 1], did, start + i) for i in range(n)]
        windows.sort()
        late = []
        head = (None, 0, 0)
        for w in windows:
            if w[0] != head[0]:
                head = w
            elif w[1:] != head[1:]:
                late.append(w[1:])
        late.sort()
        out: list[tuple] = []
        for did, start in late:  # neighbours become one interval
            if out and out[-1][0] == did and start <= out[-1][1] + out[-1][2]:
                out[-1] = (did, out[-1][1], start + k - out[-1][1])
            else:
                out.append((did, start, k))
        return out

    def run(batches):
        group, of, last = [], None, None
        for b in batches:
            out: list[tuple] = []
            rows = zip(*(as_bytes(b, "s") if c == "s" else column(b, c).to_pylist() for c in ("key", "s", "did", "start", "n")))
            for key, s, did, start, n in rows:
                if n < 0:
                    out.append((did, start, -n))
                    continue
                if key != of:
                    if len(group) > 1:
                        out += settle(group)
                    group, of, last = [], key, None
                if last is not None and s == last[0]:
                    # sorted: the first row of a string is its earliest; later ones need not be held
                    if (did, start) != last[1:]:
                        out.append((did, start, n + k - 1))
                    continue
                last = (s, did, start)
                group.append((s, did, start, n))
            if out:
                yield _intervals(out)
        if len(group) > 1 and (out := settle(group)):
            yield _intervals(out)

    return run


def _intervals(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64()))], ["did", "start", "words"])


def repeated_intervals(rows: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(did, start, words): word intervals covered by windows that start earlier elsewhere; rows: (did, doc with a text)."""
    if not 1 <= m <= k:
        raise ValueError("needs 1 <= m <= k")
    marks = rows.select("did", F.col("doc.text").alias("text")).mapInArrow(tidy(_mark(k, m)), "key long, did long, mark long, many long")
    shared = marks.withColumn("total", F.sum("many").over(Window.partitionBy("key")))
    # a mark goes on if its minimiser occurs again, or if it is settled or hot already
    kept = shared.filter(F.col("mark").bitwiseAND(3).isin(_HOT, _REMOVE) | (F.col("total") > 1))
    hot = F.when((F.col("total") >= HOT_TOTAL) & (F.col("mark").bitwiseAND(3) == _OPEN), F.col("mark") + _HOT).otherwise(F.col("mark"))
    by_doc = kept.select("did", F.struct(hot.alias("mark"), "key").alias("x")).groupBy("did").agg(F.collect_set("x").alias("marks"))
    packed = rows.join(by_doc, "did").select("did", "doc", "marks").mapInArrow(tidy(_packed(k)), "key long, s binary, did long, start long, n long")
    dealt = packed.repartition(parts(rows), "key").sortWithinPartitions("key", "s", "did", "start")
    return dealt.mapInArrow(tidy(_compare(k)), "did long, start long, words long")


def _finish(names: list[str], digests: bool):
    def run(batches):
        for b in steps(_unpacked(batches), "text", STEP):
            spans = column(b, "spans")
            offsets = spans.offsets.to_numpy()
            start = spans.values.field("start").to_numpy(zero_copy_only=False)
            length = spans.values.field("words").to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(as_bytes(b, "text")):
                words = (text or b"").split()
                n_words.append(len(words))
                lo, hi = offsets[i], offsets[i + 1]
                if hi > lo:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, np.minimum(start[lo:hi], len(words)), 1)
                    np.add.at(edge, np.minimum(start[lo:hi] + length[lo:hi], len(words)), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                if digests:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    kept.append(text if not n_removed[-1] else b" ".join(words))
            last = pa.array(kept, pa.string()) if digests else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], [*names, "n_words", "n_removed", "kept"])

    return run


def _judged(df: DataFrame, id_col: str, text_col: str, k: int, m: int, digests: bool) -> DataFrame:
    """id, the further columns as c0, c1, ... (none with digests), n_words, n_removed, kept."""
    ship_library(df.sparkSession)
    others = [c for c in df.columns if c not in (id_col, text_col)] if not digests else []
    keyed, key, numbers = keyed_documents(df, id_col, text_col)
    # text and further columns travel as one struct, so that both joins below use one and the same exchange
    further = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    if numbers is not None:  # else the key is the id
        further.append(F.col(f"`{id_col}`").cast("long").alias("id"))
    # the key is never null, and says so: a join on it would else filter one side, and the two exchanges differ
    rows = keyed.select(F.coalesce(F.col(key), F.lit(0).cast("long")).alias("did"), F.struct(F.col(f"`{text_col}`").alias("text"), *further).alias("doc"))
    spans = repeated_intervals(rows, k, m).groupBy("did").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,words:bigint>>")
    joined = rows.join(spans, "did", "left").select("did", "doc", F.coalesce("spans", none).alias("spans"))
    fields = [f for f in joined.schema["doc"].dataType if f.name != "text"]
    schema = ", ".join(["did bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])
    out = joined.mapInArrow(tidy(_finish(["did", *(f.name for f in fields)], digests)), f"{schema}, n_words long, n_removed long, kept string")
    own = F.col("did") if numbers is None else F.col("id")
    return out.select(own.alias("id"), *[f"c{i}" for i in range(len(others))], "n_words", "n_removed", "kept")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``df`` with the repeated words gone from its texts (a changed text has its words joined by one space)."""
    out = _judged(df, id_col, text_col, k, m, digests=False)
    others = iter(range(len(df.columns)))
    own = {id_col: "id", text_col: "kept"}
    return out.select(*[F.col(own[c] if c in own else f"c{next(others)}").alias(c) for c in df.columns])


def repeat_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    out = _judged(df, id_col, text_col, k, m, digests=True)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
