"""Robust scales, empirical tails, correlations and classification metrics, exact throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.ranges import quantile, running_sums, settled

MAD = 1.4826


def robust_scale(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """(keys, median, mad); fitted on what is given, by exact order statistics in ranges."""
    own = settled(df.select(*keys, value))
    med = quantile(own, value, 0.5, keys, "median")
    both = own.join(med, list(keys)) if keys else own.crossJoin(F.broadcast(med))  # one row
    mad = quantile(both.withColumn("_off", F.abs(F.col(value) - F.col("median"))), "_off", 0.5, keys, "mad")
    return med.join(mad, list(keys)) if keys else med.crossJoin(mad)  # one row each


def robust_z(value: Column, median: Column, mad: Column, eps: float = 1e-8) -> Column:
    return (value - median) / (MAD * mad + eps)


def tail_p(query: DataFrame, calibration: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """query with p = (1 + calibration values at or above it) / (n + 1): one ordered pass over both, no pairs."""
    both = query.withColumn("_from", F.lit(0)).unionByName(calibration.select(*keys, value).withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return tail_p_within(both, value, F.col("_from") == 1, keys).where("_from = 0").drop("_from")


def tail_p_within(df: DataFrame, value: str, calibrates: Column, keys: list[str] = ()) -> DataFrame:
    """df with p as tail_p gives it, where the rows for which `calibrates` holds are the calibration: one pass over df itself, in ranges of the value."""
    counted = running_sums(df.withColumn("_cal", F.coalesce(calibrates.cast("long"), F.lit(0).cast("long"))), value, {"_up": "_cal"}, keys, descending=True)
    return counted.withColumn("p", (1 + F.col("_up")) / (F.col("all__up") + 1)).drop("_cal", "_up", "all__up")


def pearson(a: str, b: str) -> Column:
    """Null for fewer than two pairs or a constant side (the built-in raises there)."""
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) > 1, F.try_divide(F.covar_pop(a, b), F.when(sd > 1e-12, sd)))


def average_ranks(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """df with rank_<value>: ranks by keys, equal values sharing the mean."""
    for v in values:
        df = df.withColumn(f"rank_{v}", F.rank().over(W.partitionBy(*keys).orderBy(v)) + (F.count("*").over(W.partitionBy(*keys, v)) - 1) / 2.0)
    return df


def wide_ranks(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """average_ranks for few keys with many rows: ranks come from the counts of distinct values, in ranges."""
    for v in values:
        counts = running_sums(df.groupBy(*keys, v).agg(F.count("*").alias("_ties")), v, {"_upto": "_ties"}, keys)
        df = df.join(counts.select(*keys, v, (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias(f"rank_{v}")), [*keys, v], "left")
    return df


def correlations(df: DataFrame, a: str, b: str, keys: list[str], wide: bool = False) -> DataFrame:
    """(keys, n, pearson, spearman). wide: few keys with many rows each."""
    return (wide_ranks if wide else average_ranks)(df, [a, b], keys).groupBy(*keys).agg(F.count("*").alias("n"), pearson(a, b).alias("pearson"), pearson(f"rank_{a}", f"rank_{b}").alias("spearman"))


def quartile_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """N, mean, median, sample std and quartiles of each class and of ALL, in one pass by grouping sets."""
    g = df.groupingSets([[by], []], by).agg(F.grouping(by).alias("_all"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.expr(f"percentile({value}, 0.25)").alias("q1"), F.expr(f"percentile({value}, 0.75)").alias("q3"))
    return g.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n, share of the true class), classes that meet nowhere with 0."""
    classes = df.select(F.col(true).alias("c")).union(df.select(pred)).distinct()
    grid = classes.select(F.col("c").alias(true)).crossJoin(F.broadcast(classes.select(F.col("c").alias(pred))))  # classes by classes
    n = grid.join(df.groupBy(true, pred).agg(F.count("*").alias("n")), [true, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return n.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy(true)).cast("double")), F.lit(0.0)))


def class_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined, and its support."""
    c = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    rows = c.select(F.explode(F.array(F.struct(F.col(true).alias("c"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("z")).select("z.*")
    s = rows.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    s = s.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select(F.col("c").alias("class"), "support", "precision", "recall", "f1")


def summary_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1 in one row."""
    m = class_metrics(df, true, pred)
    return m.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """roc_auc (Mann-Whitney with ties) and average_precision (steps at distinct scores), from counts by score."""
    s = df.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    r = running_sums(s, score, {"tp": "pos", "fp": "neg"}, descending=True)
    p, n = F.sum("pos"), F.sum("neg")
    return r.agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), p * n).alias("roc_auc"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), p).alias("average_precision"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labelings, from their contingency table."""
    c = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    both = c.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("all"))
    left = c.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    right = c.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    one = both.crossJoin(left).crossJoin(right).withColumn("e", F.try_divide(F.col("i") * F.col("j"), pairs(F.col("all"))))  # one row each
    return one.select(F.coalesce(F.try_divide(F.col("ij") - F.col("e"), (F.col("i") + F.col("j")) / 2 - F.col("e")), F.lit(1.0)).alias("ari"))


def known_floor(df: DataFrame, pearson_: str, spearman_: str, q: float = 0.05) -> DataFrame:
    """Lower percentiles of known pairs, invalid if negative or missing."""
    f = df.agg(F.expr(f"percentile({pearson_}, {q})").alias("pearson_floor"), F.expr(f"percentile({spearman_}, {q})").alias("spearman_floor"))
    return f.withColumn("valid", F.coalesce((F.col("pearson_floor") >= 0) & (F.col("spearman_floor") >= 0), F.lit(False)))


def map_diagnostics(points: DataFrame) -> DataFrame:
    """One row for points(kind, x, y) of kinds known, background and candidate: the distance of the known and the background centroid over the
    mean of their spreads (mean distances to the centroid), the quadrants around the mean of all points that hold candidates, and their number."""
    mean = lambda k, c: F.avg(F.when(F.col("kind") == k, F.col(c)))
    at = points.agg(*[mean(k, c).alias(f"{k}_{c}") for k in ("known", "background") for c in "xy"], F.avg("x").alias("_ox"), F.avg("y").alias("_oy"))
    p = points.crossJoin(F.broadcast(at))  # one row
    off = lambda k: F.sqrt(F.pow(F.col("x") - F.col(f"{k}_x"), F.lit(2.0)) + F.pow(F.col("y") - F.col(f"{k}_y"), F.lit(2.0)))
    spread = lambda k: F.avg(F.when(F.col("kind") == k, off(k)))
    apart = F.first(F.sqrt(F.pow(F.col("known_x") - F.col("background_x"), F.lit(2.0)) + F.pow(F.col("known_y") - F.col("background_y"), F.lit(2.0))))
    candidate = F.col("kind") == "candidate"
    quadrant = F.when(candidate, (F.col("x") >= F.col("_ox")).cast("int") * 2 + (F.col("y") >= F.col("_oy")).cast("int"))
    return p.agg((apart / F.greatest((spread("known") + spread("background")) / 2, F.lit(1e-12))).alias("separation_over_spread"), F.count_distinct(quadrant).alias("occupied_quadrants"), F.count_if(candidate).alias("candidates"))
