"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing and token ids, each stage a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import common, leaks, mixing, quality, simhash, sstable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all rows in sorted-string-table shards, read back."""
    return sstable.read(sstable.write(docs))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("source mixture", mixture), ("token ids", token_ids)]
#: SQL can't express the fingerprints, embeddings and tokenizer of the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        mark = common.written()
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.clean(spark, mark, but=common.last_written())  # what the stage wrote on its way
    return docs
