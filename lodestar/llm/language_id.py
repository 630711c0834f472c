"""Language identification with hyperdimensional profiles (operator 1).

Every symbol (lower-cased letter, or the space that stands for anything else)
has a fixed random vector of +1 and -1.  A letter with its two neighbours is an
n-gram vector: the three vectors are permuted by place (cyclic shifts by 2, 1
and 0) and bound by multiplication.  A document's profile is the bundle (sum)
of its n-gram vectors, a language's prototype the bundle over its training
documents, and a document gets the language with the largest cosine.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if no language was learned; equal cosines go to the smaller language name;
negative cosines count as 0.  Null ids are never training rows of the query.
Texts are taken whole, in pieces of ``PIECE`` characters whose bundles add up,
so a very long text needs no more memory than a short one.  Further columns
are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import column, compact, ship_library, small_side, steps, table

#: Components of a vector.
DIM = 1024
SEED = 20_240_607
#: Distinct n-grams whose vectors are held at once.
GRAM_BLOCK = 1 << 12
#: Characters of a text that are bundled at once.
PIECE = 1 << 19
#: Training documents of a language (those with the smallest hashes of their ids).
MAX_TRAIN_DOCS = 2_000
#: Languages whose partial bundles a task holds at once (8 KB each).
LANGUAGE_BLOCK = 1 << 11
#: Cosines of a block of documents that are held at once.
COSINES = 1 << 22
UNDETERMINED = "und"
_SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=8192)
def symbol_vector(code: int) -> np.ndarray:
    """The fixed random +1/-1 vector of a symbol."""
    return np.random.default_rng((SEED, code)).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


def _ngrams(text: str) -> np.ndarray:
    """(n, 3) code points: each letter with its neighbours, non-letters as spaces.  ``text`` is already lower-cased."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    padded = np.full(len(codes) + 2, _SPACE, dtype=np.int64)
    letter = _is_letter()[codes]
    padded[1:-1] = np.where(letter, codes, _SPACE)
    at = np.flatnonzero(letter)
    return padded[at[:, None] + np.arange(3)]


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Profiles (len(texts), DIM) of the texts, and how many letters each has."""
    out, letters = np.zeros((len(texts), DIM)), np.zeros(len(texts), dtype=np.int64)
    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        low = text.lower()
        for a in range(0, len(low), PIECE):
            # one character more on either side, for the neighbours of the piece's ends
            grams = _ngrams(low[max(a - 1, 0) : a + PIECE + 1])
            if a and low[a - 1].isalpha():
                grams = grams[1:]
            if a + PIECE < len(low) and low[a + PIECE].isalpha():
                grams = grams[:-1]
            letters[i] += len(grams)
            if len(grams):
                group.append((i, grams))
                held += len(grams)
            if held >= PIECE:
                _add_group(out, group)
                group, held = [], 0
    if group:
        _add_group(out, group)
    return out, letters


def _add_group(out: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
    grams = np.concatenate([g for _, g in group])
    present = np.zeros(0x110000, dtype=bool)
    present[grams.ravel()] = True
    symbols = np.flatnonzero(present)
    index = np.zeros(0x110000, dtype=np.int64)
    index[symbols] = np.arange(len(symbols))
    a = len(symbols)
    local = index[grams]
    codes = (local[:, 0] * a + local[:, 1]) * a + local[:, 2]
    if a**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(codes, minlength=a**3))
        rank = np.zeros(a**3, dtype=np.int64)
        rank[used] = np.arange(len(used))
        codes = rank[codes]
    else:
        used, codes = np.unique(codes, return_inverse=True)
    vectors = np.stack([symbol_vector(int(s)) for s in symbols])
    ends = np.cumsum([len(g) for _, g in group])
    # documents by blocks whose count matrix stays small, n-grams by blocks too
    docs = max(1, (1 << 21) // len(used))
    for d in range(0, len(group), docs):
        part = group[d : d + docs]
        lo, hi = (ends[d - 1] if d else 0), ends[min(d + docs, len(group)) - 1]
        rows = np.repeat(np.arange(len(part)), [len(g) for _, g in part])
        counts = np.bincount(rows * len(used) + codes[lo:hi], minlength=len(part) * len(used)).astype(np.float32).reshape(len(part), len(used))
        total = np.zeros((len(part), DIM), dtype=np.float32)
        for u in range(0, len(used), GRAM_BLOCK):
            total += counts[:, u : u + GRAM_BLOCK] @ _gram_vectors(used[u : u + GRAM_BLOCK], a, vectors)
        np.add.at(out, [i for i, _ in part], total)


def _gram_vectors(grams: np.ndarray, a: int, vectors: np.ndarray) -> np.ndarray:
    first, second, third = grams // (a * a), grams // a % a, grams % a
    return (np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]).astype(np.float32)


@dataclass
class Prototypes:
    """Learned languages in name order and their unit prototypes (languages, DIM)."""

    languages: list[str]
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the texts have letters."""
        profiles, letters = bundle([t or "" for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), (letters > 0).tolist()
        norm = np.linalg.norm(profiles, axis=1)
        best, score, block = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), max(1, COSINES // len(self.languages))
        for a in range(0, len(texts), block):
            at = slice(a, a + block)
            cosine = (profiles[at] @ self.matrix.T) / np.where(norm[at] > 0, norm[at], 1.0)[:, None]
            best[at] = cosine.argmax(axis=1)
            score[at] = np.clip(cosine.max(axis=1), 0.0, 1.0)
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0).tolist(), known.tolist()


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_docs: int = MAX_TRAIN_DOCS,
    max_languages: int | None = None,
) -> Prototypes:
    """Prototypes of the languages of ``df`` (the ``max_languages`` most frequent ones, if given), from a bounded sample of each.

    At most ``max_train_docs`` documents of a language are read.  Their partial
    bundles are summed by language in Spark, so the driver gets one prototype
    (8 KB) a language.
    """
    named = df.selectExpr(f"`{id_col}` AS id", f"`{lang_col}` AS lang", f"`{text_col}` AS text").filter("lang IS NOT NULL AND id IS NOT NULL")
    top = named.groupBy("lang").agg(F.count("*").alias("docs"))
    top = small_side(*compact(top if max_languages is None else top.orderBy(F.desc("docs"), "lang").limit(max_languages)))
    # a hash share of about twice the sample goes to the ordering, however many rows a language has
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") * F.col("docs") < float(2 * max_train_docs) * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    drawn = named.join(top, "lang").filter(share).drop("docs")
    keys = drawn.select("id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_train_docs).select("id", "lang")
    keys, n = compact(keys.distinct())
    tasks = max(8, -(-n // max(1, max_train_docs)))
    sample = drawn.join(small_side(keys, n), ["id", "lang"], "left_semi").select("lang", "text").repartition(tasks)

    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in steps(batches, "text"):
            profiles, _ = bundle([t or "" for t in column(b, "text").to_pylist()])
            for lang, p in zip(column(b, "lang").to_pylist(), profiles, strict=True):
                sums[lang] = sums[lang] + p if lang in sums else p
            if len(sums) > LANGUAGE_BLOCK:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def add(part: pa.Table) -> pa.Table:  # at most a row for each training document of the language
        total = np.zeros(DIM)
        for v in part.column("bundle").to_pylist():
            total += np.frombuffer(v)
        return pa.table({"lang": part.column("lang").slice(0, 1), "bundle": pa.array([total.tobytes()], pa.binary())})

    summed = sample.mapInArrow(run, "lang string, bundle binary").groupBy("lang").applyInArrow(add, "lang string, bundle binary")
    total = {r["lang"]: np.frombuffer(r["bundle"]) for r in summed.collect()}
    languages = sorted(k for k, v in total.items() if v.any())
    matrix = np.stack([total[k] / np.linalg.norm(total[k]) for k in languages]) if languages else np.zeros((0, DIM))
    return Prototypes(languages, matrix)


def predict(df: DataFrame, prototypes: Prototypes, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (name -> Column of df) with ``lang_pred`` and ``score``.  A map over the rows: no shuffle."""
    keep = keep or {"doc_id": F.col("doc_id")}
    cols = df.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text_col}`").alias("_text"))
    return _predicted(cols, prototypes, "_text", list(keep)).drop("_lettered")


def _predicted(cols: DataFrame, prototypes: Prototypes, text: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name in names)
    ship_library(cols.sparkSession)
    shipped = cols.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches):
        for b in steps(batches, text):
            lang, score, lettered = shipped.value.judge(column(b, text).to_pylist())
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lettered, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), *found], [*names, "lang_pred", "score", "_lettered"])

    return cols.mapInArrow(run, f"{schema}, lang_pred string, score double, _lettered boolean")


def accepted(df: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has letters; a null language is filled with the predicted one (``und`` if none was learned)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    judged = _predicted(df.toDF(*names), prototypes, names[df.columns.index(text_col)], names)
    filled = [F.coalesce(n, "lang_pred").alias(c) if c == lang_col else F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]
    return judged.filter("_lettered").select(*filled)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents kept out of training: crc32 of the id's text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.filter(~held_out()))
    return predict(docs, prototypes, keep={"doc_id": F.col("doc_id"), "held_out": held_out()}).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
