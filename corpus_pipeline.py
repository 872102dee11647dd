"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: rejected documents go.  2. quality: rejected documents go.  3. near duplicates (five-word shingles, similarity of 0.8 or more): the
document of the smallest id of each group stays.  4. decontamination: documents that overlap with a benchmark item go.  5. byte-level BPE: doc_id,
lang, source, n_tokens, token_ids and the digest of the decoded bytes.

The two classifiers learn from labelled documents of the table documents, outside the held-out folds of their modules, and score all their stage gets.
Null texts go through the classifiers as empty ones; rows with a null doc_id have no groups but those of equal texts. An empty table gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontamination, neardup, quality, toxicity
from tidegrid.llm.common import shared_dir, table
from tidegrid.llm.compression import scored

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs, model, DOCUMENTS).where("predicted = 0").select(DOCUMENTS)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs, model, DOCUMENTS).where("predicted = 1").select(DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs.select(DOCUMENTS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs.select(DOCUMENTS), table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "lang", "source"]
    done = bpe.encode(docs, keep, decoded=True)
    return done.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL expresses none of the compression, banding and encoding stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
