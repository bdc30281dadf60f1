"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it kept and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes every stage as
Parquet in the shared checkpoint folder and rereads it as the next one's docs, so that a lost
executor costs a stage's tasks and not the stages before. A stage's table goes once the next one is
written; the last one, which the result reads, is the caller's to clear.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verdict.llm import op2_quality, op3_mixing, op5_jaccard, op6_suffix, op8_decontaminate
from verdict.llm.common import read_table
from verdict.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return op2_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op5_jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also stand earlier in the corpus are cut out; every document stays."""
    return op6_suffix.cut_documents(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op8_decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return op3_mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminate),
    ("source mix", mix),
]
#: Suffix arrays and graph components have no plain SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this run on whatever file system holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
