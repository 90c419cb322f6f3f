"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm import common as C

#: Fixed values of the mixing contract: weights in turn, share of all words, most repeats of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one (source, size) row each.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all words by weight. A target stops
    at `most` times its source's size; what is over goes to the others by weight until none is above. With sources ordered by
    cap / weight, those that stop are the first ones: a source stops if its cap per weight is at most what is left per weight
    left before it, so that prefix sums give the fixed point at once. The table has one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    order = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left, heavy = F.col("budget") - F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.col("all_weight") - F.coalesce(F.sum("w").over(order), F.lit(0.0))
    return (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("w").over(every))
        .withColumn("stops", F.col("ratio") * heavy <= left)
        .withColumn("level", (F.col("budget") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(every)) / F.nullif(F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(every), F.lit(0.0)))
        .select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))
    )


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone (52 bits of md5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: int = 20260920, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(row, size, source_size, target, copies): row is a row of docs, whatever its columns are called; copies are floor(rate) and one more
    with the fraction's probability, for rate = target / source size.

    Null texts have size 0, null sources are a source of their own, rows of one identifier draw alike, an empty table gives an empty
    one, a source without words has target 0 and no copies.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = C.stored(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "name")
    if targets.count() <= C.BROADCAST_ROWS:
        targets = F.broadcast(targets)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    more = (draw(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return sized.join(targets, F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate).select("row", "size", "source_size", "target", (F.floor("rate") + more).cast("long").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it had."""
    return mix(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(C.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT source, source_size, ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w FROM o),
k AS (SELECT *, ratio * (all_w - coalesce(sum(w) OVER p, 0)) <= budget - coalesce(sum(cap) OVER p, 0) AS stops FROM c
      WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE
             (budget - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stops THEN 0 ELSE w END) OVER (), 0) * w END AS target FROM k),
r AS (SELECT doc_id, size, source_size, target, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate,
             CAST(('0x' || substr(md5('20260920|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""
