"""From raw documents to token ids: toxicity, exact and near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the rows it keeps
with the columns of documents; the last returns token ids. run() writes each stage's rows as Parquet in the
shared checkpoint folder and goes on from the files, so a lost executor costs one stage at most. Whole texts go to Python
in batches of at most 1000 rows: the stages leave the session so, since their results are computed later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from weftline.llm.common import ensure_checkpoint_dir, small_batches, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learns only from labelled rows among the stage's own documents.
    Null and empty texts are scored and stay unless predicted toxic; repeated rows share their fate; columns may have any name."""
    small_batches(spark, 1000)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the row with the smallest doc_id stays. Null counts
    as empty; of repeated rows one stays."""
    small_batches(spark, 1000)
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays: SimHash links, decided on all five-word
    shingles, and what fingerprints miss of that similarity.
    Null and wordless texts are equal to each other; very long texts are compared by all their shingles."""
    return simhash.one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; null sources are one source, a text without words adds none."""
    small_batches(spark, 1000)
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row; null counts as empty."""
    small_batches(spark, 1000)
    return bpe.encode(docs).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Fitted models, hashing and sampling are not expressible in SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
