"""Table and document sinks with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.status import manifest


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; a byte order mark stands before the first column's name so that spreadsheets read it as UTF-8."""
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """Parquet by partition columns; returns the manifest of its files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return manifest(df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path))


def freeze(df: DataFrame, path: str) -> DataFrame:
    """A protocol (one row) that is written once: a later one must be equal.

    The row is written beside the path and renamed to it, which fails if another writer was first; then that one's row counts.
    """
    spark, text = df.sparkSession, df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
        text.coalesce(1).write.text(own.toString())
        if not fs.exists(at) and fs.rename(own, at) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, own.getName())):
            return df
        fs.delete(own, True)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, own.getName()), True)  # where a rename moves into a folder that is there
    old = spark.read.text(path).first()
    if old is None or old["value"] != text.first()["value"]:
        raise ValueError("the protocol differs from the frozen one")
    return df


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or have other contents."""
    return before.join(after.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path")
