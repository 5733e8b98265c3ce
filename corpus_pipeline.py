"""A corpus from raw documents to tokens, in stages that each write a table.

Quality, near-duplicates, repeated passages, benchmark leaks, tokens. Every stage works on
all that its predecessor kept, and is written to the shared folder before the next one
reads it, so a lost executor costs tasks and never a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import decontaminate, knn_quality, piece_codec, simhash, substring_dedup
from gossamer.llm.common import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours reject go."""
    return knn_quality.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = simhash.near_duplicates(docs)
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; what is left are words joined by one space.

    Texts without such a passage stay as they are. Documents of which nothing is left go.
    """
    return substring_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hits = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = materialize(hits.select("doc_id").distinct(), "pipeline-leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    return piece_codec.digest_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_tokens),
]

#: Fingerprints, latent spaces and pieces are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
