"""What the operators share: the cluster's shared folder, cut lineage, row keys and byte-balanced shards."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A null identifier sorts after all others.
NO_ID = (1 << 63) - 1
#: The most rows of a side that is ever broadcast.
BROADCAST_ROWS = 100_000


_local: dict[str, str] = {}
#: What the run of this thread or context has written: runs beside each other have lists of their own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def own_written() -> list[str]:
    found = _written.get()
    if found is None:
        _written.set(found := [])
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which spark.checkpoint.dir names.

    Where it is unset, a local session gets a temporary folder; on a cluster, whose machines would not share one, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pairloom-"))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own_written().append(path)
    return path


def written() -> int:
    """A mark for `clean`."""
    return len(own_written())


def last_written() -> str:
    return own_written()[-1]


def clean(spark: SparkSession, since: int = 0, but: str = "") -> None:
    """Deletes what this run wrote to the shared folder after the mark, except under the path `but`. Results that are not written elsewhere are lost by that."""
    written = own_written()
    for path in written[since:]:
        if path != but:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    written[since:] = [but] if but in written[since:] else []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a table of the shared folder and read from there: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, x, doc_id, text): d is the identifier (nulls last), x tells rows of one identifier apart by their text.

    Repeated rows have one key and one fate. Other columns go, so clashing names cannot matter.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
        F.xxhash64(F.col(text_col)).alias("x"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def crc_mod(id_col: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


#: The most shards of a table (the driver holds PIVOTS of their bounds each), and pivots of a shard. Beyond it shards are larger.
SHARDS, PIVOTS = 50_000, 16


def id_shards(rows: DataFrame, weight: Column, target: int) -> tuple[int, Column]:
    """How many ascending ranges of the keys (d, x), longs, of about `target` weight each, and a column with the range of a row.

    The ranges are the same for any partitioning of the rows. Pivots are rows chosen by a hash of the key, in proportion to their weight; every so many
    of them a range begins. As x is a hash of the row's content, ranges part rows of equal or no identifier too; only wholly equal rows stay together.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 0
    shards = min(SHARDS, -(-total // target))
    if shards <= 1:
        return 1, F.lit(0)
    each = total / (shards * PIVOTS)
    draw = (F.xxhash64("d", "x", F.lit("pivot")).bitwiseAND((1 << 53) - 1) + 1).cast("double") / float(1 << 53)
    chosen = rows.select("d", "x", weight.cast("double").alias("w")).where(draw * each <= F.col("w")).groupBy("d", "x").agg(F.sum(F.greatest("w", F.lit(each))).alias("w"))
    pivots = chosen.toPandas().sort_values(["d", "x"])
    run, bounds = 0.0, []
    for d, x, w in zip(pivots["d"].tolist(), pivots["x"].tolist(), pivots["w"].tolist()):
        if run and run + w > PIVOTS * each:
            bounds.append((d, x))
            run = 0.0
        run += w
    low, high = (np.array([b[k] for b in bounds], dtype=np.int64) for k in (0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((low, high))  # at most SHARDS bounds

    @F.pandas_udf("int")
    def shard_of(d: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(bounds_below(*shared.value, d.to_numpy(), x.to_numpy()))

    return len(bounds) + 1, shard_of("d", "x")


def bounds_below(low: np.ndarray, high: np.ndarray, d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds (low, high) are at or below each (d, x), by binary search."""
    out, end = np.searchsorted(low, d, side="left"), np.searchsorted(low, d, side="right")
    tie = np.flatnonzero(end > out)
    for v in np.unique(d[tie]).tolist():  # identifiers that are bounds
        own = tie[d[tie] == v]
        a, b = out[own[0]], end[own[0]]
        out[own] = a + np.searchsorted(high[a:b], x[own], side="right")
    return out.astype(np.int32)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filesystem(uri: str):
    """pyarrow's file system for a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.normpath("/" + uri[5:].lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def arrow_rows(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """At most so many rows, and about so many bytes, in a batch to Python, that batches of long texts stay small; lower settings are kept.

    Python workers get this library's folder on their path, wherever the driver was started.
    """
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > 1 << 30:  # its default is no bound
        spark.conf.set(key, size)


def pylist(batch, name: str) -> list[bytes]:
    """A text or binary column as bytes; null is empty."""
    import pyarrow as pa

    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]
