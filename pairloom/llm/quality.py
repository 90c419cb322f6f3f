"""Quality rules: base rules on every text and a hashed n-gram log-likelihood ratio between trusted and raw multinomials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T

#: Hashed features; the driver and every worker hold one double for each.
BUCKETS_LOG2 = 15
#: The most trusted documents whose n-grams make the target (a hash-ordered sample of the labelled rows).
TRUSTED = 20_000
#: Documents whose n-grams are on average less likely than this in the target, against the raw corpus (natural log), are rejected.
THRESHOLD = -0.12
#: Added to the trusted count of a bucket and to the count that the corpus would give as many n-grams; rare n-grams then say little.
SMOOTHING = 5.0
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def features(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, and the text of each."""
    down, h = np.uint64(64 - BUCKETS_LOG2), w.hash
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w) > 1 else np.zeros(0, dtype=np.int64)
    two = T.mix(h[pair] * np.uint64(3) + h[pair + 1]) if len(pair) else h[:0]
    return np.concatenate((h >> down, two >> down)).astype(np.int64), np.concatenate((w.doc, w.doc[pair]))


def base(texts: list[bytes], w: T.Words) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    n, a, b = len(texts), w.offset[:-1], w.offset[1:] - 1
    cum = lambda x: (s := np.concatenate(([0], np.cumsum(x))))[b] - s[a]
    lines = np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            own = [x for x in t.split(b"\n") if x and not x.isspace()]
            lines[i] = len(own) - len(set(own))
    repeated = np.zeros(n, dtype=np.int64)
    if len(w) >= 8:
        j = np.flatnonzero(w.doc[7:] == w.doc[:-7])
        key = T.between(T.prefix(w.hash), j, j + 8) ^ T.mix(w.doc[j].astype(np.uint64) + np.uint64(1))
        o = np.argsort(key)
        same = np.concatenate(([False], key[o][1:] == key[o][:-1]))
        twice = j[o[same | np.concatenate((same[1:], [False]))]]
        repeated = np.bincount(w.doc[T.spans_mask(len(w), twice, twice + 8)], minlength=n)
    return {
        "n_words": np.diff(w.first),
        "word_chars": cum(~T._SPACE[w.buf] & ((w.buf & 0xC0) != 0x80)),
        "n_symbols": cum(_SYMBOL[w.buf]),
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
    }


def log_ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | corpus), from counts over all documents; one number a bucket on the driver."""
    spark = docs.sparkSession
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    chosen = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.collect()], dtype=np.int64)))

    def count(batches):
        seen = np.zeros((2, 1 << BUCKETS_LOG2), dtype=np.int64)
        for batch in batches:
            texts = C.pylist(batch, "text")
            good = np.isin(batch.column("doc_id").fill_null(C.NO_ID).to_numpy(), chosen.value)
            for a, b in T.chunks(texts):
                bucket, doc = features(T.Words(texts[a:b]))
                seen[1] += np.bincount(bucket, minlength=seen.shape[1])
                seen[0] += np.bincount(bucket[good[a:b][doc]], minlength=seen.shape[1])
        k = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_pydict({"bucket": k.astype(np.int32), "good": seen[0][k], "every": seen[1][k]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "bucket int, good long, every long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every")).toPandas()
    both = np.zeros((2, 1 << BUCKETS_LOG2))
    both[0, rows["bucket"]], both[1, rows["bucket"]] = rows["good"], rows["every"]
    if not both[0].sum():
        return np.zeros(both.shape[1])  # nothing to trust: no document is less likely than another
    expected = both[1] * (both[0].sum() / both[1].sum())
    return np.log(both[0] + SMOOTHING) - np.log(expected + SMOOTHING)


def verdicts(texts: list[bytes], table: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The base measures, score, base_failed and kept of each text; nothing for no texts."""
    parts = []
    for a, b in T.chunks(texts):
        w = T.Words(texts[a:b])
        m = base(texts[a:b], w)
        bucket, doc = features(w)
        m["score"] = np.bincount(doc, weights=table[bucket], minlength=b - a) / np.maximum(1, np.bincount(doc, minlength=b - a))
        parts.append(m)
    if not parts:
        return {}
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & (out["score"] >= threshold)}


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, score (mean log ratio of its n-grams) and kept.

    Null and empty texts have no words: base_failed, score 0. Rows of one identifier are judged one by one. Ties cannot
    arise: a score of the threshold itself is kept. Without trusted labels all scores are 0. Other columns are ignored.
    """
    C.arrow_rows(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, trusted))

    def judge(batches):
        for batch in batches:
            if out := verdicts(C.pylist(batch, "text"), table.value, threshold):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: v if v.dtype in (bool, np.float64) else v.astype(np.int64) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever these are called. Null and empty texts go; repeated rows have one fate."""
    C.arrow_rows(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, trusted))

    def run(batches):
        for batch in batches:
            if out := verdicts(C.pylist(batch, "text"), table.value, threshold):
                yield batch.filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
