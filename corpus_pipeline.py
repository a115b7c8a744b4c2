"""From raw documents to token ids, in five stages; each takes the documents that the stage before it has written.

Toxic documents go, one document of each near-duplicate group stays, passages that an earlier document holds are cut out,
documents that leak benchmark items go, and the rest is encoded and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.bpe import bpe_encode_decode, default_path
from scriptorium.llm.common import scratch_dir, table
from scriptorium.llm.decontaminate import leaks
from scriptorium.llm.passages import cut_passages, repeated_passages
from scriptorium.llm.simhash import first_of_groups
from scriptorium.llm.toxicity import toxicity, training_labels
from scriptorium.plans.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the lexicon is learned outside the held-out fold."""
    ship(spark)
    return toxicity(docs, training_labels(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of fingerprints linked at 3 or fewer differing bits."""
    ship(spark)
    return first_of_groups(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are taken out of the text."""
    ship(spark)
    return cut_passages(docs, repeated_passages(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item."""
    ship(spark)
    leaking = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (binary, little-endian uint32), their number, and the text decoded from them."""
    ship(spark)
    return bpe_encode_decode(docs, default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: SQL has neither fitted lexicons nor fingerprints, alignments or merges; tests/llm/test_pipeline.py holds each stage against its rule, the first but for its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    base, docs = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
