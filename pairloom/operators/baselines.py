"""Seeded Monte-Carlo baselines: every (budget, repeat) is a task of its own over a table of windows of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The most windows that the tasks of coverage_matched hold.
MOST_WINDOWS = 2_000_000


def repeats(spark, settings: list[float], n: int) -> DataFrame:
    return spark.createDataFrame([(float(s), k) for s in settings for k in range(n)], "setting double, repeat int").repartition(max(1, min(64, len(settings) * n)), "setting", "repeat")


def random_windows(windows: DataFrame, fractions: list[float], n: int, seed: int, key: list[str] = ("chrom", "w_start")) -> DataFrame:
    """windows with setting and repeat: for each fraction and repeat the ceil(n * fraction) windows with the least hashes of seed, fraction, repeat and place.

    A draw without replacement that any engine can repeat; every draw is a task of its own.
    """
    draws = windows.withColumn("setting", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), F.format_string("%.4f", "setting"), F.col("repeat").cast("string"), *[F.col(k).cast("string") for k in key])
    w = W.partitionBy("setting", "repeat")
    placed = draws.withColumn("_h", F.sha2(text, 256)).withColumns({"_k": F.row_number().over(w.orderBy("_h", *key)), "_n": F.count("*").over(w)})
    return placed.where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * F.col("setting"), 9)))).drop("_h", "_k", "_n")


def coverage_matched(spark, windows: DataFrame, targets_bp: list[float], n: int, seed: int, tolerance: float = 0.02, attempts: int = 32) -> DataFrame:
    """(setting, repeat, covered_bp, windows, matched, chosen): windows in random order, each taken if the union stays within the target; the
    nearest of up to `attempts` orders, done at the first within the tolerance. chosen: the windows, as (chrom, w_start, w_end)."""
    if windows.count() > MOST_WINDOWS:
        raise ValueError(f"over {MOST_WINDOWS} windows: draws hold all of them")
    w = windows.select("chrom", "w_start", "w_end").orderBy("chrom", "w_start", "w_end").toPandas()
    code = w["chrom"].astype("category").cat.codes.to_numpy().astype(np.int64)
    wide = int(w["w_end"].max()) + 1 if len(w) else 1
    a, b = w["w_start"].to_numpy() + code * wide, w["w_end"].to_numpy() + code * wide
    edge = np.unique(np.concatenate((a, b)))
    size, lo, hi = np.diff(edge), np.searchsorted(edge, a), np.searchsorted(edge, b)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        target, k = float(group["setting"].iloc[0]), int(group["repeat"].iloc[0])
        rng, best = np.random.default_rng([seed, int(target), k]), (0, [])
        for _ in range(attempts):
            seen, covered, taken = np.zeros(len(size), dtype=bool), 0, []
            for i in rng.permutation(len(a)).tolist():
                part = slice(lo[i], hi[i])
                more = int(size[part][~seen[part]].sum())
                if covered + more <= target:
                    seen[part], covered = True, covered + more
                    taken.append(i)
                    if covered >= target * (1 - tolerance):
                        break
            best = max(best, (covered, taken), key=lambda b: b[0])
            if best[0] >= target * (1 - tolerance):
                break
        chosen = list(zip(w["chrom"].to_numpy()[best[1]].tolist(), w["w_start"].to_numpy()[best[1]].tolist(), w["w_end"].to_numpy()[best[1]].tolist()))
        return pd.DataFrame({"setting": [target], "repeat": [k], "covered_bp": [best[0]], "windows": [len(best[1])], "matched": [best[0] >= target * (1 - tolerance)], "chosen": [chosen]})

    schema = "setting double, repeat int, covered_bp long, windows long, matched boolean, chosen array<struct<chrom: string, w_start: long, w_end: long>>"
    return repeats(spark, targets_bp, n).groupBy("setting", "repeat").applyInPandas(run, schema)


def region_matched(regions: DataFrame, sizes: DataFrame, n: int, seed: int, keep: list[str] = ()) -> DataFrame:
    """(repeat, region_id, chrom, r_start, r_end, and the columns `keep`): regions of the same lengths at starts that a hash of seed, repeat and region gives."""
    at = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), "region_id"), 256), 1, 15), 16, 10).cast("long")
    every = regions.join(sizes, "chrom").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.expr("size_bp - (r_end - r_start) + 1")
    return every.withColumn("_at", F.pmod(at, F.greatest(start, F.lit(1)))).select("repeat", "region_id", "chrom", *keep, F.col("_at").alias("r_start"), (F.col("_at") + F.col("r_end") - F.col("r_start")).alias("r_end"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, population std and the 2.5th and 97.5th percentiles by setting."""
    return df.groupBy("setting").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.expr(f"percentile({value}, 0.025)").alias("q025"), F.expr(f"percentile({value}, 0.975)").alias("q975"))
