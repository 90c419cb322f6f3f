"""Contact maps: windows, cells, expectations, normalizations and masked features over sparse symmetric counts.

Zero cells are not stored; what is defined over a mask counts them through the mask's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import masked as M

BIN = 100
#: Name, window and step of a scale, in base pairs.
SCALES = (("small", 3200, 400), ("medium", 6400, 800), ("large", 12800, 1600))


def windows(sizes: DataFrame, scales=SCALES) -> DataFrame:
    """Complete windows of each scale on (chrom, size_bp): start <= size - window, no wrap."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(w).cast("long").alias("window_bp"), F.lit(st).cast("long").alias("step_bp")) for n, w, st in scales])).alias("s")
    each = sizes.select("chrom", "size_bp", s).select("chrom", "size_bp", "s.*").where("size_bp >= window_bp")
    return each.select("scale", "chrom", "window_bp", "step_bp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bp") - F.col("window_bp"), F.col("step_bp"))).alias("w_start")).select("scale", "chrom", "w_start", (F.col("w_start") + F.col("window_bp")).alias("w_end"), (F.col("w_start") + F.expr("window_bp div 2")).alias("center"), "window_bp", "step_bp")


def rebin(pixels: DataFrame, origin: Column, source_bp: int, target_bp: int, bins: int) -> DataFrame:
    """Cells (i, j, value) of a window: midpoints of source bins fall into target bins, counts add up, both triangles are given."""
    at = lambda c: F.floor((F.col(c) * source_bp + source_bp / 2 - origin) / target_bp)
    inside = pixels.select(*[c for c in pixels.columns if c not in ("bin1", "bin2", "cnt")], at("bin1").alias("i"), at("bin2").alias("j"), "cnt").where(F.col("i").between(0, bins - 1) & F.col("j").between(0, bins - 1))
    keys = [c for c in inside.columns if c != "cnt"]
    mirrored = inside.where("i <> j").select(*[F.col("j").alias("i") if c == "i" else F.col("i").alias("j") if c == "j" else F.col(c) for c in inside.columns])
    return inside.unionByName(mirrored).groupBy(*keys).agg(F.sum("cnt").alias("value"))


def window_cells(pixels: DataFrame, sizes: DataFrame, scales=SCALES, keep: tuple = ()) -> DataFrame:
    """Upper-triangle cells of every window that holds a pixel: (scale, chrom, w_start, replicate, i, j, d, value) and the kept columns.

    Starts of the windows around a pixel follow from its bins, so no join with windows is needed: a pixel is exploded to
    at most window / step rows and meets its chromosome's size by a small join.
    """
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(w).cast("long").alias("window_bp"), F.lit(st).cast("long").alias("step_bp")) for n, w, st in scales])).alias("s")
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"CAST(ceil(((bin2 + 1) * {BIN} - window_bp) / step_bp) AS BIGINT) * step_bp"))
    last = F.least(F.expr(f"((bin1 * {BIN}) div step_bp) * step_bp"), F.expr("((size_bp - window_bp) div step_bp) * step_bp"))
    each = pixels.join(sizes, "chrom").select("replicate", "chrom", "bin1", "bin2", "cnt", "size_bp", *keep, s).select("*", "s.*").where("size_bp >= window_bp").withColumns({"a": first, "b": last}).where("a <= b")
    out = each.select("scale", "chrom", "replicate", "bin1", "bin2", "cnt", "window_bp", *keep, F.explode(F.sequence("a", "b", "step_bp")).alias("w_start"))
    return out.select("scale", "chrom", "w_start", "window_bp", "replicate", F.expr(f"CAST(bin1 - w_start div {BIN} AS INT)").alias("i"), F.expr(f"CAST(bin2 - w_start div {BIN} AS INT)").alias("j"), F.expr("CAST(bin2 - bin1 AS INT)").alias("d"), F.col("cnt").alias("value"), *keep)


def expected(pixels: DataFrame, sizes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """E(d) for d < most by keys (with chrom): sum of counts at distance d over the number of bin pairs, 0 where none are stored."""
    sums = pixels.withColumn("d", F.abs(F.col("bin2") - F.col("bin1")).cast("int")).where(F.col("d") < most).groupBy(*keys, "d").agg(F.sum("cnt").alias("total"))
    grid = pixels.select(*keys).distinct().join(sizes, "chrom").select(*keys, F.expr(f"size_bp div {BIN}").alias("n_bins"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("d"))
    return grid.join(sums, [*keys, "d"], "left").select(*keys, "d", F.coalesce(F.try_divide("total", F.greatest(F.col("n_bins") - F.col("d"), F.lit(0)).cast("double")), F.lit(0.0)).alias("expected"))


def mask_size(n: Column, gap: int = 2) -> Column:
    """Cells with j - i > gap of an n by n matrix."""
    return ((n - gap - 1) * (n - gap) / 2).cast("double")


def genome_oe(value: Column, expect: Column) -> Column:
    """value / E(d), 0 where E(d) is not above 0."""
    return F.when(expect > 0, value / expect).otherwise(0.0)


def reproducibility_oe(value: Column, expect: Column) -> Column:
    """value / E(d), null where E(d) is not above 0 or not finite."""
    return F.when((expect > 0) & ~F.isnan(expect) & (expect < float("inf")), value / expect)


def local_expected(cells: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """E(d) of each window over both triangles and all cells: sum over n - d cells."""
    return cells.groupBy(*keys, "d").agg(F.try_divide(F.sum("value"), F.first(n).cast("double") - F.col("d")).alias("local_expected"))


def local_oe(cells: DataFrame, keys: list[str], n: Column, eps: float = 1e-8) -> DataFrame:
    """value / (E(d) + eps), with the window's own E(d)."""
    return cells.join(local_expected(cells, keys, n), [*keys, "d"]).withColumn("oe", F.col("value") / (F.col("local_expected") + eps))


def density_features(cells: DataFrame, keys: list[str], n: Column, value: str = "value", gap: int = 2) -> DataFrame:
    """Masked mean, population std, max, 95th percentile and total of the upper cells beyond the gap, counting zeros that are not stored.

    One shuffle on the keys; sums and squares close over the mask's size, the percentile takes its place among the zeros, so nothing is made dense.
    """
    m, v = mask_size(F.first(n), gap), F.when(F.col("d") > gap, F.col(value))
    total, square = F.coalesce(F.sum(v), F.lit(0.0)), F.coalesce(F.sum(v * v), F.lit(0.0))
    top = F.greatest(F.coalesce(F.max(v), F.lit(0.0)), F.when(F.count(v) < m, 0.0))
    own = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("_v"), m.cast("long").alias("_m"), (total / m).alias("density_mean"), F.sqrt(F.greatest(F.lit(0.0), square / m - F.pow(total / m, F.lit(2.0)))).alias("density_std"), top.alias("density_max"), total.alias("density_total"))
    return own.select(*keys, "density_mean", "density_std", "density_max", M.quantile(F.col("_v"), 0.95, F.col("_m") - F.size("_v")).alias("density_p95"), "density_total")


def masked_percentile(cells: DataFrame, keys: list[str], n: Column, q: float, value: str = "value", gap: int = 2) -> DataFrame:
    """Exact linear percentile over the mask with its zeros, from the stored cells alone."""
    return M.quantiles(cells, keys, mask_size(n, gap), {"percentile": q}, value, F.col("d") > gap)


def mirrored(cells: DataFrame) -> DataFrame:
    """Both triangles of upper cells, for what is defined over the whole matrix."""
    return cells.withColumn("_twice", F.explode(F.when(F.col("d") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_twice")


def intensity_features(cells: DataFrame, keys: list[str], n: Column, value: str = "value") -> DataFrame:
    """Mean, population std, max, total, median and 95th percentile of the whole matrix with its zeros, from the stored upper cells."""
    v = F.col(value)
    own = mirrored(cells).groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("_v"), (F.first(n) * F.first(n)).cast("long").alias("_m"), F.sum(v).alias("total"), F.sum(v * v).alias("_s"), F.max(v).alias("_top"))
    zeros, mean = F.col("_m") - F.size("_v"), F.col("total") / F.col("_m")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_s") / F.col("_m") - mean * mean))
    top = F.when(zeros > 0, F.greatest("_top", F.lit(0.0))).otherwise(F.col("_top"))
    return own.select(*keys, mean.alias("mean"), std.alias("std"), top.alias("max"), "total", M.quantile(F.col("_v"), 0.5, zeros).alias("median"), M.quantile(F.col("_v"), 0.95, zeros).alias("p95"))


def zero_axis(cells: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """Rows (equally columns) of the symmetric window without any count."""
    ends = cells.where(F.col("value") != 0).select(*keys, n.alias("n"), F.explode(F.array("i", "j")).alias("axis"))
    return ends.groupBy(*keys).agg((F.first("n") - F.count_distinct("axis")).cast("long").alias("zero_axes"))


def robust_shape(cells: DataFrame, keys: list[str], n: Column, clip: float, value: str = "oe", gap: int = 2, eps: float = 1e-8, limit: float = 10.0) -> DataFrame:
    """The upper cells with shape: clip, log1p, (x - median) / (1.4826 MAD + eps), limited; and zero_shape, what the cells have that are not stored.

    Median and MAD are over the cells beyond the gap, zeros among them; a MAD of at most eps scales by 1. Every cell is transformed.
    """
    x = cells.withColumn("_x", F.log1p(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(float(clip)))))
    fit = M.median_and_mad(x, keys, mask_size(n, gap), "_x", F.col("d") > gap)
    scale = F.when(F.col("mad") <= eps, F.lit(1.0)).otherwise(1.4826 * F.col("mad") + eps)
    shape = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), (c - F.col("med")) / scale))
    return x.join(fit, keys).withColumns({"shape": shape(F.col("_x")), "zero_shape": shape(F.lit(0.0))}).drop("_x", "med", "mad")


def percentile_clip(cells: DataFrame, keys: list[str], n: Column, q: float = 0.995, value: str = "value") -> DataFrame:
    """The upper cells with clipped: at most the percentile of the whole matrix, zeros and both triangles; and top, that percentile (zeros stay 0 unless it is below)."""
    top = M.quantiles(mirrored(cells), keys, (n * n).cast("long"), {"top": q}, value)
    return cells.join(top, keys).withColumn("clipped", F.least(F.col(value), F.col("top")))


def minmax(cells: DataFrame, keys: list[str], n: Column, value: str = "value") -> DataFrame:
    """The upper cells with scaled, to [0, 1] over the whole matrix, a constant to 0; and zero_scaled, what the cells have that are not stored.

    The least value is 0 unless it is negative or the matrix is full.
    """
    ends = mirrored(cells).groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), (F.count("*") < F.first(n) * F.first(n)).alias("_open"))
    low, high = F.when(F.col("_open"), F.least("_low", F.lit(0.0))).otherwise(F.col("_low")), F.when(F.col("_open"), F.greatest("_high", F.lit(0.0))).otherwise(F.col("_high"))
    to = lambda c: F.coalesce(F.try_divide(c - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
    return cells.join(ends, keys).withColumns({"scaled": to(F.col(value)), "zero_scaled": to(F.lit(0.0))}).drop("_low", "_high", "_open")


def defined_cells(expect: DataFrame, n: int, gap: int = 2) -> DataFrame:
    """(chrom, m, m_full, total): the cells of an n by n window at distances with an expectation above 0 in both replicates, beyond the gap and
    beyond the diagonal, and all cells beyond the gap."""
    e = F.col("expected")
    both = expect.groupBy("chrom", "d").agg((F.count_if((e > 0) & (e < float("inf"))) == 2).alias("ok"))
    cells = F.when(F.col("ok"), n - F.col("d")).otherwise(0)
    return both.groupBy("chrom").agg(F.sum(F.when(F.col("d") > gap, cells).otherwise(0)).alias("m"), F.sum(F.when(F.col("d") > 0, cells).otherwise(0)).alias("m_full"), F.lit((n - gap - 1) * (n - gap) // 2).alias("total"))


def distance_model(cells: DataFrame, per: list[str], windows: DataFrame, n: int, value: str = "oe") -> DataFrame:
    """(per, d, model): the mean of the value over all cells at a distance in all windows (per, windows), stored or not."""
    sums = cells.groupBy(*per, "d").agg(F.sum(value).alias("_sum"))
    return sums.join(windows, per).select(*per, "d", (F.col("_sum") / (F.col("windows") * (n - F.col("d")))).alias("model"))


def reconstruction_error(cells: DataFrame, keys: list[str], model: DataFrame, per: list[str], n: int, value: str = "oe", gap: int = 2) -> DataFrame:
    """(keys, error, all_error): the mean squared distance of the upper cells from model(per, d, model; 0 where it has no row), beyond the gap and in all of the
    upper triangle. Cells that are not stored are as far off as the model is from 0."""
    inside = F.col("d") > gap
    base = model.groupBy(*per).agg(*[F.sum(F.when(c, (n - F.col("d")) * F.col("model") * F.col("model")).otherwise(0.0)).alias(k) for k, c in (("_base", inside), ("_all", F.lit(True)))])
    v, m = F.col(value), F.coalesce("model", F.lit(0.0))
    more = v * v - 2 * v * m
    off = cells.join(model, [*per, "d"], "left").groupBy(*list(dict.fromkeys([*keys, *per]))).agg(F.sum(F.when(inside, more).otherwise(0.0)).alias("_off"), F.sum(more).alias("_off_all"))
    out = off.join(base, per, "left")
    sizes = (n - gap - 1) * (n - gap) / 2, n * (n + 1) / 2
    return out.select(*keys, *[((F.col(o) + F.coalesce(b, F.lit(0.0))) / m).alias(k) for k, o, b, m in (("error", "_off", "_base", sizes[0]), ("all_error", "_off_all", "_all", sizes[1]))])


def symmetry_error(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The largest difference of a cell and its mirror, a missing one being 0."""
    a = cells.select(*keys, "i", "j", F.col("value").alias("v"))
    b = cells.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("mirror"))
    return a.join(b, [*keys, "i", "j"], "full").groupBy(*keys).agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("mirror", F.lit(0.0)))).alias("symmetry_error"))


def attention_ratio(cells: DataFrame, keys: list[str], marked: Column, value: str = "value") -> DataFrame:
    """Share of the marked cells in the total, 0 where the total is not above 0."""
    total = F.sum(value)
    return cells.groupBy(*keys).agg(F.when(total > 0, F.sum(F.when(marked, F.col(value)).otherwise(0.0)) / total).otherwise(0.0).alias("ratio"))


def resolve_chromosome(names: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name) with the chrom it stands for: exact, else the only one that is equal but for case, else an alias; null if none."""
    exact = known.select(F.col("chrom").alias("exact"))
    folded = known.groupBy(F.lower("chrom").alias("low")).agg(F.when(F.count("*") == 1, F.first("chrom")).alias("folded"))
    alias = aliases.groupBy(F.lower("alias").alias("alias_low")).agg(F.min("chrom").alias("aliased"))
    return names.join(exact, names["name"] == F.col("exact"), "left").join(folded, F.lower("name") == F.col("low"), "left").join(alias, F.lower("name") == F.col("alias_low"), "left").select(*names.columns, F.coalesce("exact", "folded", "aliased").alias("chrom"))
