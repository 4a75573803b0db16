"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns
of ``documents``.

1. quality rules: failing lines go, then documents that fail or lose too much;
2. n-gram Jaccard join: of each component of near copies (five-word shingles, 0.8) the
   document with the smallest id stays;
3. benchmark decontamination: documents holding a benchmark item go;
4. secret scan: secrets are masked in the text;
5. packing: pieces of sequences of at most 1024 tokens, with their ids.

Null ids: such documents are cleaned, decontaminated, redacted and packed like others;
as near copies are named by id, the join leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from callwise.llm.textbytes import checkpointed

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaks are tied to their documents by the text, which every document has."""
    key = F.xxhash64("text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(docs.select(key.alias("doc_id"), "text"), benchmark)
    return docs.join(found.select(F.col("doc_id").alias("_key")).distinct(), key == F.col("_key"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *packing.vocabulary())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", packed),
]

# learned models, connected components and tokenization are beyond SQL; tests/llm holds
# the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs, f"stage{i + 1}")
    return docs
