"""How well selected intervals recall annotated structures, for many methods, budgets and repeats at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.intervals import range_join, union_bp

#: The classes of structures.
CLASSES = ("CHIN", "OPCID", "CHID")


def recalls(selected: DataFrame, structures: DataFrame, keys: list[str], bucket: int, at: tuple[str, str] = ("w_start", "w_end")) -> DataFrame:
    """(keys, recall, overlap_recall and both of each class): shares of structures whose center lies in a selected interval, or that overlap one.

    keys without a hit are not in the result; a class without structures has no share. structures: structure, type, chrom, s_start, s_end, s_center.
    """
    inside = (F.col(at[0]) <= F.col("s_center")) & (F.col("s_center") < F.col(at[1]))
    hit = range_join(selected.select(*keys, "chrom", *at), structures, bucket, at).groupBy(*keys, "structure", "type").agg(F.bool_or(inside).alias("center"))
    of = lambda c: [c == k for k in CLASSES]
    names = ["", *[f"{k}_" for k in CLASSES]]
    total = structures.agg(*[F.count_if(x).alias(f"_{n}n") for n, x in zip(names, [F.lit(True), *of(F.col("type"))])])
    counts = hit.groupBy(*keys).agg(
        *[F.count_if(x & F.col("center")).alias(f"{n}recall") for n, x in zip(names, [F.lit(True), *of(F.col("type"))])],
        *[F.count_if(x).alias(f"{n}overlap_recall") for n, x in zip(names, [F.lit(True), *of(F.col("type"))])],
    )
    share = [F.try_divide(F.col(f"{n}{m}").cast("double"), F.col(f"_{n}n").cast("double")).alias(f"{n}{m}") for m in ("recall", "overlap_recall") for n in names]
    return counts.crossJoin(F.broadcast(total)).select(*keys, *share)  # one row


def comparison(selected: DataFrame, structures: DataFrame, keys: list[str], bucket: int, at: tuple[str, str] = ("w_start", "w_end")) -> DataFrame:
    """(keys, n, union_bp, recalls): one row for each key that has intervals."""
    size = selected.groupBy(*keys).agg(F.count("*").alias("n")).join(union_bp(selected, *at, keys), keys)
    names = [f"{n}{m}" for m in ("recall", "overlap_recall") for n in ("", *[f"{k}_" for k in CLASSES])]
    return size.join(recalls(selected, structures, keys, bucket, at), keys, "left").select(*keys, "n", "union_bp", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def budgets(cumulative: DataFrame, total_bp: DataFrame, shares: list[float], keys: list[str] = (), rank: str = "rank") -> DataFrame:
    """cumulative with budget, for every share of the whole: the ranked regions until their union reaches it, the overshoot stays.

    cumulative has cumulative_bp and before_bp of each rank; total_bp is one row.
    """
    each = cumulative.crossJoin(F.broadcast(total_bp)).withColumn("budget", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return each.where(F.col("before_bp") < F.round(F.col("budget") * F.col("total_bp"), 6))
