"""Half-open interval algebra. Touching is not overlapping; a center c is in [start, end) if start <= c < end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.ranges import TILE, running_sums, segments


def range_join(left: DataFrame, right: DataFrame, bucket: int, l: tuple[str, str] = ("w_start", "w_end"), r: tuple[str, str] = ("s_start", "s_end"), on: str = "chrom") -> DataFrame:
    """Pairs that overlap, by an equi-join on (chrom, bucket of coordinates) in place of a nested loop.

    A pair can meet in several buckets; only the bucket in which the later of the two starts lies counts, so no distinct is needed.
    """
    cut = lambda a, b: F.explode(F.sequence(F.expr(f"CAST({a} AS BIGINT) div {bucket}"), F.greatest(F.expr(f"(CAST({b} AS BIGINT) - 1) div {bucket}"), F.expr(f"CAST({a} AS BIGINT) div {bucket}"))))
    a, b = left.withColumn("_bucket", cut(*l)), right.withColumnRenamed(on, "_on").withColumn("_own", cut(*r))
    meet = (F.col(on) == F.col("_on")) & (F.col("_bucket") == F.col("_own")) & (F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0]))
    return a.join(b, meet).where(F.expr(f"greatest(CAST({l[0]} AS BIGINT), CAST({r[0]} AS BIGINT)) div {bucket} = _bucket")).drop("_bucket", "_own", "_on")


def center_join(left: DataFrame, right: DataFrame, bucket: int, center: str = "center", l: tuple[str, str] = ("w_start", "w_end"), on: str = "chrom") -> DataFrame:
    """Pairs in which the right row's center lies in the left interval; the right side is in one bucket, so pairs meet once."""
    a = left.withColumn("_bucket", F.explode(F.sequence(F.expr(f"CAST({l[0]} AS BIGINT) div {bucket}"), F.expr(f"(CAST({l[1]} AS BIGINT) - 1) div {bucket}"))))
    b = right.withColumnRenamed(on, "_on").withColumn("_own", F.expr(f"CAST(floor({center}) AS BIGINT) div {bucket}"))
    return a.join(b, (F.col(on) == F.col("_on")) & (F.col("_bucket") == F.col("_own")) & (F.col(l[0]) <= b[center]) & (b[center] < F.col(l[1]))).drop("_bucket", "_own", "_on")


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, **names) -> DataFrame:
    """Left rows that overlap no right row."""
    return left.join(range_join(left, right, bucket, **names).select(*keys).distinct(), keys, "left_anti")


def with_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, **names) -> DataFrame:
    return left.join(range_join(left, right, bucket, **names).select(*keys).distinct(), keys, "left_semi")


def islands(df: DataFrame, start: str, end: str, order: list[str], keys: list[str], tile: int = TILE) -> DataFrame:
    """df with island: a new one begins where start >= the largest end before (touching does not merge)."""
    return segments(df, keys, start, [end, *order], F.col(end), lambda seen: F.col(start) >= seen, "island", tile)


def gap_islands(df: DataFrame, at: str, most: float | Column, order: list[str], keys: list[str], tile: int = TILE, least: bool = False) -> DataFrame:
    """df with island: a new one begins where the place is more than `most` behind the one before (least: `most` or more)."""
    far = (lambda seen: F.col(at) - seen >= most) if least else (lambda seen: F.col(at) - seen > most)
    return segments(df, keys, at, order, F.col(at), far, "island", tile)


def union_bp(df: DataFrame, start: str, end: str, keys: list[str], by: str = "chrom") -> DataFrame:
    """Base pairs that the intervals cover, by keys."""
    k = list(dict.fromkeys([*keys, by]))
    return islands(df, start, end, [], k).groupBy(*k, "island").agg((F.max(end) - F.min(start)).alias("bp")).groupBy(*keys).agg(F.sum("bp").cast("long").alias("union_bp")) if keys else islands(df, start, end, [], k).groupBy(*k, "island").agg((F.max(end) - F.min(start)).alias("bp")).agg(F.coalesce(F.sum("bp"), F.lit(0)).cast("long").alias("union_bp"))


def cumulative_union(df: DataFrame, start: str, end: str, rank: str, keys: list[str], bucket: int, by: str = "chrom", wide: bool = False) -> DataFrame:
    """(keys, rank, cumulative_bp): what the intervals of each rank and better cover. Elementary segments take the least rank over them.

    wide: for few keys with many ranks; sums run in ranges, and before_bp, without the rank's own, is there too.
    """
    k = list(dict.fromkeys([*keys, by]))
    at = df.select(*k, F.explode(F.array(start, end)).alias("_a")).distinct()
    seg = at.withColumn("_b", F.lead("_a").over(W.partitionBy(*k).orderBy("_a"))).where("_b IS NOT NULL").withColumn("_key", F.concat_ws("\u0001", *k))
    own = df.select(F.concat_ws("\u0001", *k).alias("_key"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(rank).alias("_rank"))
    least = range_join(seg, own, bucket, ("_a", "_b"), ("_s", "_e"), "_key").groupBy(*k, "_a", "_b").agg(F.min("_rank").alias(rank))
    added = df.select(*keys, rank).distinct().join(least.groupBy(*keys, rank).agg(F.sum(F.col("_b") - F.col("_a")).alias("added")), [*keys, rank], "left")
    if wide:
        run = running_sums(added.withColumn("added", F.coalesce("added", F.lit(0))), rank, {"cumulative_bp": "added"}, keys)
        return run.select(*keys, rank, F.col("cumulative_bp").cast("long").alias("cumulative_bp"), (F.col("cumulative_bp") - F.col("added")).cast("long").alias("before_bp"))
    return added.select(*keys, rank, F.sum(F.coalesce("added", F.lit(0))).over(W.partitionBy(*keys).orderBy(rank)).cast("long").alias("cumulative_bp"))


def overlap_pairs(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], by: str = "chrom") -> DataFrame:
    """(chrom, pairs): how many pairs overlap, by counts of ends and starts without making the pairs: for each left interval,
    right starts before its end less right ends at or before its start."""
    row = lambda df, c, turn, *flags: df.select(by, F.col(c).alias("at"), F.lit(turn).alias("turn"), *[F.lit(int(f == k)).alias(f) for f in ("s", "e", "qs", "qe") for k in flags])
    every = row(left, l[1], 0, "qs").unionByName(row(right, r[0], 1, "s")).unionByName(row(right, r[1], 1, "e")).unionByName(row(left, l[0], 2, "qe"))
    w = W.partitionBy(by).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    run = every.withColumns({"n_s": F.sum("s").over(w), "n_e": F.sum("e").over(w)})
    return run.groupBy(by).agg((F.sum(F.col("qs") * F.col("n_s")) - F.sum(F.col("qe") * F.col("n_e"))).cast("long").alias("pairs"))


def nearest(points: DataFrame, centers: DataFrame, point: str, center: str, on: str = "chrom") -> DataFrame:
    """points with the nearest center and its distance (the lower of two equally near): the last one at or before and the first
    one after, from one sorted union instead of a cross join."""
    both = points.withColumns({"_at": F.col(point).cast("double"), "_c": F.lit(None).cast("double")}).unionByName(centers.select(on, F.col(center).cast("double").alias("_at"), F.col(center).cast("double").alias("_c")).distinct(), allowMissingColumns=True)
    w = W.partitionBy(on).orderBy("_at", F.col("_c").asc_nulls_last())
    low, high = F.last("_c", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("_c", True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = F.when(F.col("_high").isNull() | (F.col("_at") - F.col("_low") <= F.col("_high") - F.col("_at")), F.col("_low")).otherwise(F.col("_high"))
    return both.withColumns({"_low": low, "_high": high}).where("_c IS NULL").withColumn("nearest_center", near).withColumn("center_distance", F.abs(F.col("_at") - F.col("nearest_center"))).drop("_at", "_c", "_low", "_high")


def best_overlap(targets: DataFrame, ranked: DataFrame, keys: list[str], rank: Column, bucket: int, t: tuple[str, str] = ("s_start", "s_end"), r: tuple[str, str] = ("w_start", "w_end"), keep: list[str] = ()) -> DataFrame:
    """For each target the best ranked interval that overlaps it: one row a target, by a partial minimum rather than a sort."""
    return range_join(ranked, targets, bucket, r, t).groupBy(*keys).agg(F.min(F.struct(rank.alias("_rank"), *keep)).alias("_b")).select(*keys, F.col("_b._rank").alias("best_rank"), *[F.col(f"_b.{c}").alias(c) for c in keep])
