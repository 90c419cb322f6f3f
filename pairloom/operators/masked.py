"""Statistics over a mask of a matrix from its stored cells: cells that are not stored are zeros, and count.

The mask's size is known for every key, so nothing is made dense: zeros enter moments through the size, ranks as one block of ties,
quantiles by their place among the stored values, and deviations from a median as so many copies of the median itself. A key's stored
cells (a window's) are bounded by its mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def at_place(values: Column, k: Column, copies: Column, filler: Column) -> Column:
    """The k-th (from 0) of an ascending array and so many copies of the filler, merged."""
    k, below = k.cast("int"), F.size(F.filter(values, lambda x: x < filler))
    return F.when(k < below, F.get(values, k)).when(k < below + copies, filler).otherwise(F.get(values, (k - copies).cast("int")))


def quantile(values: Column, share: float, copies: Column, filler: Column | None = None) -> Column:
    """The quantile, linear between neighbours, of an ascending array and the copies (of zero, if nothing else is said); null of nothing."""
    filler = F.lit(0.0) if filler is None else filler
    h = F.lit(float(share)) * (F.size(values) + copies - 1)
    low, high = (at_place(values, c, copies, filler) for c in (F.floor(h), F.ceil(h)))
    return F.when(F.size(values) + copies > 0, low + (high - low) * (h - F.floor(h)))


def gathered(cells: DataFrame, keys: list[str], size: Column, value: str, inside: Column) -> DataFrame:
    """(keys, v, zeros): the ascending values of the cells inside the mask, and how many of its cells are not stored."""
    own = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(inside, F.col(value)))).alias("v"), F.first(size).cast("long").alias("_m"))
    return own.select(*keys, "v", (F.col("_m") - F.size("v")).alias("zeros"))


def quantiles(cells: DataFrame, keys: list[str], size: Column, shares: dict[str, float], value: str = "value", inside: Column | None = None) -> DataFrame:
    """(keys, the named quantiles) over the mask."""
    return gathered(cells, keys, size, value, F.lit(True) if inside is None else inside).select(*keys, *[quantile(F.col("v"), q, F.col("zeros")).alias(n) for n, q in shares.items()])


def median_and_mad(cells: DataFrame, keys: list[str], size: Column, value: str, inside: Column) -> DataFrame:
    """(keys, med, mad) over the mask: the zeros deviate by the median's own size."""
    own = gathered(cells, keys, size, value, inside).withColumn("med", quantile(F.col("v"), 0.5, F.col("zeros")))
    off = F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("med"))))
    return own.withColumn("_off", off).select(*keys, "med", quantile(F.col("_off"), 0.5, F.col("zeros"), F.abs("med")).alias("mad"))


def ranks(value: str, keys: list[str], zeros: Column) -> tuple[Column, Column]:
    """The rank of a stored value among all cells of the mask, equal ones sharing the mean, and the rank that the cells have which are not stored."""
    w = W.partitionBy(*keys)
    v = F.col(value)
    own = F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0
    less, none = F.sum((v < 0).cast("long")).over(w), F.sum((v == 0).cast("long")).over(w)
    block = less + (zeros + none + 1) / 2.0
    return F.when(v < 0, own).when(v == 0, block).otherwise(own + zeros), block


def paired_moments(pairs: DataFrame, sizes: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, n, pearson, spearman, cosine, rmse, iqr, flat) for every row of sizes(keys, m).

    pairs has the cells that are stored on either side, the other side being 0; the m cells of the mask that no row has are 0 on both. iqr is that of
    both sides' values together. Correlations are null for fewer than two cells or a constant side (flat), the cosine where a side is 0 throughout.
    One shuffle by keys: sums, ranks and means share the partitioning.
    """
    w = W.partitionBy(*keys)
    x = pairs.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).join(sizes.select(*keys, F.col("m").cast("long").alias("_m")), keys)
    x = x.withColumn("_z", F.col("_m") - F.count("*").over(w))
    more = {}
    for s in ("a", "b"):
        more[f"_r{s}"], more[f"_z{s}"] = ranks(f"_{s}", keys, F.col("_z"))
        more[f"_u{s}"] = F.sum(f"_{s}").over(w) / F.col("_m")
    x, z = x.withColumns(more), F.first("_z")
    middle = (F.col("_m") + 1) / 2.0

    def covariance(p: str, q: str, at: str, up: Column, uq: Column) -> Column:
        return F.sum((F.col(p) - up) * (F.col(q) - uq)) + z * F.first((F.col(f"{at}{p[-1]}") - up) * (F.col(f"{at}{q[-1]}") - uq))

    zero = x.withColumns({"_0a": F.lit(0.0), "_0b": F.lit(0.0)})
    mean = {s: F.col(f"_u{s}") for s in "ab"}
    low = [F.when(z > 0, F.least(F.min(f"_{s}"), F.lit(0.0))).otherwise(F.min(f"_{s}")) for s in "ab"]
    high = [F.when(z > 0, F.greatest(F.max(f"_{s}"), F.lit(0.0))).otherwise(F.max(f"_{s}")) for s in "ab"]
    got = zero.groupBy(*keys).agg(
        *[covariance(f"_{p}", f"_{q}", "_0", mean[p], mean[q]).alias(f"c{p}{q}") for p, q in ("ab", "aa", "bb")],
        *[covariance(f"_r{p}", f"_r{q}", "_z", middle, middle).alias(f"r{p}{q}") for p, q in ("ab", "aa", "bb")],
        F.sum(F.col("_a") * F.col("_b")).alias("dot"), F.sum(F.col("_a") * F.col("_a")).alias("da"), F.sum(F.col("_b") * F.col("_b")).alias("db"), F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2.0))).alias("square"),
        ((low[0] == high[0]) | (low[1] == high[1])).alias("_flat"), F.sort_array(F.concat(F.collect_list("_a"), F.collect_list("_b"))).alias("_v"), (2 * z).alias("_none"),
    )
    out = sizes.join(got, keys, "left").withColumn("flat", F.coalesce("_flat", F.lit(True)))
    right = lambda c: F.when(~F.col("flat") & (F.col("m") > 1), F.try_divide(F.col(f"{c}ab"), F.nullif(F.sqrt(F.col(f"{c}aa")) * F.sqrt(F.col(f"{c}bb")), F.lit(0.0))))
    iqr = F.coalesce(quantile(F.col("_v"), 0.75, F.col("_none")) - quantile(F.col("_v"), 0.25, F.col("_none")), F.when(F.col("m") > 0, 0.0))
    cosine = F.try_divide(F.col("dot"), F.nullif(F.sqrt("da") * F.sqrt("db"), F.lit(0.0)))
    rmse = F.sqrt(F.try_divide(F.coalesce("square", F.lit(0.0)), F.col("m").cast("double")))
    return out.select(*sizes.columns, F.col("m").cast("long").alias("n"), right("c").alias("pearson"), right("r").alias("spearman"), cosine.alias("cosine"), rmse.alias("rmse"), iqr.alias("iqr"), "flat")


def measure_pairs(pairs: DataFrame, sizes: DataFrame, keys: list[str], least: int = 10, gap: int = 2, eps: float = 1e-12) -> DataFrame:
    """The reproducibility of two maps in every row of sizes(keys, m, m_full, total).

    pairs(keys, d, a, b): cells beyond the diagonal that are stored on either side and defined on both. m of the `total` cells beyond the gap are defined
    on both sides, and m_full of all beyond the diagonal. Correlations over both masks (null for under `least` cells or a constant side), cosine and
    NRMSE (by the pooled interquartile range), the defined share, and why a pair is not valid.
    """
    own = paired_moments(pairs.where(F.col("d") > gap), sizes, keys)
    full = paired_moments(pairs, sizes.select(*keys, F.col("m_full").alias("m")), keys).select(*keys, *[F.when(F.col("n") >= least, F.col(c)).alias(f"full_{c}") for c in ("pearson", "spearman")])
    enough = F.col("n") >= least
    out = own.withColumns({c: F.when(enough, F.col(c)) for c in ("pearson", "spearman")})
    reason = F.when(~enough, "too_few_valid_pixels").when(F.col("flat"), "zero_variance").when(F.col("pearson").isNull() | F.col("spearman").isNull(), "undefined_correlation").otherwise("valid")
    out = out.withColumns({"nrmse": F.when(F.col("n") > 0, F.col("rmse") / (F.col("iqr") + eps)), "finite_fraction": F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")), "reason": reason})
    return out.join(full, keys).drop("m", "m_full", "total", "flat")


def mask_correlations(pairs: DataFrame, sizes: DataFrame, keys: list[str], n: int, gap: int = 2) -> DataFrame:
    """(keys, mask, n, pearson, spearman) of raw counts on three masks: the upper triangle, without the diagonal, and without the band around it.

    pairs(keys, d, a, b) are the stored cells of the upper triangle, sizes(keys) the windows of n by n cells.
    """
    least = {"upper": 0, "offdiag": 1, f"exclude_band{gap}": gap + 1}
    masks = lambda d: F.explode(F.filter(F.array(*[F.when(d >= k, F.lit(m)) for m, k in least.items()]), lambda x: x.isNotNull())).alias("mask")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit((n - k) * (n - k + 1) // 2).alias("m")) for m, k in least.items()])).alias("z")
    every = sizes.select(*keys, each).select(*keys, "z.*")
    return paired_moments(pairs.select(*keys, "a", "b", masks(F.col("d"))), every, [*keys, "mask"]).select(*keys, "mask", "n", "pearson", "spearman")
