"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents without letters go, a null language is filled;
2. MinHash near-dedup over five-word shingles at similarity 0.8: one document of each group stays;
3. substring dedup: words of 20-word windows that start earlier elsewhere go;
4. mixing: the token budget is spread over domains, languages and sources, in up to two epochs;
5. byte-level BPE: token ids, decoded again to see that nothing was lost.

Null ids and texts are handled as the operators say; repeated rows are one
document from stage 2 on; rows that stage 4 takes twice appear twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, language_id, mixing, near_dedup, substring_dedup
from lodestar.llm.common import scratch, ship_library, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_library(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_library(spark)
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_library(spark)
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_library(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as pt

    ship_library(spark)
    return byte_bpe.encode_rows(docs, pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixture),
    ("byte_bpe", encode),
]

#: Language ID, similarity and byte-pair merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return last(spark, docs, sf_dir)
