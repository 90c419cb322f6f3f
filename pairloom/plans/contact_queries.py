"""Queries of scans, windows, cells, expectations, normalizations, features and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import ids, tables
from pairloom.operators import contacts as K
from pairloom.plans import fixtures as X

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, fixtures: bool = True, dense: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: X.tidy(query(spark, sf_dir))
    if sql:
        ORACLES[name] = (X.DENSE if dense else X.SQL if fixtures else "") + sql


add("src03_pixel_scan", lambda s, d: X.pixels(s, d).groupBy("replicate", "chrom").agg(F.count("*").alias("pixels"), F.sum("cnt").alias("total")), "SELECT replicate, chrom, count(*) AS pixels, round(sum(cnt), 6) AS total FROM fx_pixels GROUP BY 1, 2")


def local_window(s, d):
    """One window around a center, 100 bp bins taken to 200 bp ones."""
    return K.rebin(X.pixels(s, d).where("chrom = 'A' AND bin1 BETWEEN 50 AND 113 AND bin2 BETWEEN 50 AND 113").drop("chrom"), F.lit(5000), 100, 200, 32)


add("src01_rebin_window", local_window, """, a AS (SELECT replicate, CAST(floor((bin1 * 100 + 50 - 5000) / 200.0) AS BIGINT) AS i, CAST(floor((bin2 * 100 + 50 - 5000) / 200.0) AS BIGINT) AS j, cnt
  FROM fx_pixels WHERE chrom = 'A' AND bin1 BETWEEN 50 AND 113 AND bin2 BETWEEN 50 AND 113)
SELECT replicate, i, j, round(sum(cnt), 6) AS value FROM (SELECT * FROM a UNION ALL SELECT replicate, j, i, cnt FROM a WHERE i <> j) WHERE i BETWEEN 0 AND 31 AND j BETWEEN 0 AND 31 GROUP BY 1, 2, 3""")


def aliases(s, d):
    known, names = X.sizes(s, d).select("chrom"), s.createDataFrame([("A",), ("a",), ("n",), ("strain-1",), ("nothing",)], "name string")
    return K.resolve_chromosome(names, known, s.createDataFrame([("Strain-1", "R")], "alias string, chrom string"))


add("src02_chromosome_alias", aliases, "SELECT * FROM (VALUES ('A', 'A'), ('a', 'A'), ('n', 'N'), ('strain-1', 'R'), ('nothing', NULL)) t(name, chrom)", False)
add("src04_window_cells", lambda s, d: X.cells(s, d).groupBy("replicate", "chrom").agg(F.count("*").alias("cells"), F.sum("value").alias("total"), F.count_distinct("w_start").alias("windows")), "SELECT replicate, chrom, count(*) AS cells, round(sum(value), 6) AS total, count(DISTINCT w_start) AS windows FROM fx_cells GROUP BY 1, 2")
add("src05_scale_scan", lambda s, d: K.window_cells(X.pixels(s, d), X.sizes(s, d)).groupBy("scale").agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.sum("value").alias("total")), """SELECT w.scale, count(*) AS cells, round(min(p.cnt), 6) AS least, round(sum(p.cnt), 6) AS total
FROM fx_pixels p JOIN fx_windows w ON p.chrom = w.chrom AND p.bin1 * 100 >= w.w_start AND (p.bin2 + 1) * 100 <= w.w_end GROUP BY 1""")


def dense(s, d):
    """Rows of the dense matrices of all windows, zeros in place, each row as a weighted sum."""
    m = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    rows = X.cells(s, d).groupBy("chrom", "w_start", "replicate", "i").agg(m.alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0)) * (j + 1))
    return rows.select("chrom", "w_start", "replicate", "i", F.aggregate(filled, F.lit(0.0), lambda a, x: a + x).alias("weighted"))


add("src12_dense_arrays", dense, "SELECT chrom, w_start, replicate, i, round(sum(value * (j + 1)), 6) AS weighted FROM fx_cells GROUP BY 1, 2, 3, 4")


def known_dataset(s, d):
    """Structures with the medium window whose center is the multiple of the step at their center, and its totals in both replicates."""
    t = X.structures(s, d).withColumn("w_start", F.expr("CAST(floor((s_center - 3200) / 800) AS BIGINT) * 800"))
    c = X.cells(s, d).groupBy("chrom", "w_start").pivot("replicate", ["rep1", "rep2"]).agg(F.sum("value"))
    return t.join(c, ["chrom", "w_start"], "left").select("structure", "type", "chrom", "w_start", "rep1", "rep2", (F.col("rep1").isNotNull() & F.col("rep2").isNotNull()).alias("available"))


add("src13_known_dataset", known_dataset, """SELECT structure, type, chrom, w_start, round(rep1, 6) AS rep1, round(rep2, 6) AS rep2, rep1 IS NOT NULL AND rep2 IS NOT NULL AS available FROM (
SELECT t.structure, t.type, t.chrom, t.w_start, sum(value) FILTER (replicate = 'rep1') AS rep1, sum(value) FILTER (replicate = 'rep2') AS rep2
FROM (SELECT *, CAST(floor((s_center - 3200) / 800) AS BIGINT) * 800 AS w_start FROM fx_structures) t LEFT JOIN fx_cells c ON c.chrom = t.chrom AND c.w_start = t.w_start GROUP BY 1, 2, 3, 4)""")
add("src14_paired_long", lambda s, d: X.scores(s, d).select("chrom", "w_start", F.expr("stack(2, 'rep1', rep1_density, 'rep2', rep2_density) AS (replicate, density)")).groupBy("replicate").agg(F.count("*").alias("n"), F.avg("density").alias("mean")), "SELECT replicate, count(*) AS n, round(avg(density), 6) AS mean FROM (SELECT 'rep1' AS replicate, rep1_density AS density FROM fx_scores UNION ALL SELECT 'rep2', rep2_density FROM fx_scores) GROUP BY 1")
add("ag01_expected", X.expected, "SELECT replicate, chrom, d, round(expected, 6) AS expected FROM fx_expected")
KEY = ["chrom", "w_start", "replicate"]
add("ag02_local_expected", lambda s, d: K.local_expected(X.cells(s, d), KEY, F.col("n")), "SELECT chrom, w_start, replicate, d, round(sum(value) / (64 - d), 6) AS local_expected FROM fx_cells GROUP BY 1, 2, 3, 4")
add("mx04_local_oe", lambda s, d: K.local_oe(X.cells(s, d), KEY, F.col("n")).groupBy("chrom", "replicate", "d").agg(F.sum("oe").alias("total"), F.max("oe").alias("top")), """, e AS (SELECT chrom, w_start, replicate, d, sum(value) / (64 - d) AS e FROM fx_cells GROUP BY 1, 2, 3, 4)
SELECT chrom, replicate, d, round(sum(value / (e + 1e-8)), 6) AS total, round(max(value / (e + 1e-8)), 6) AS top FROM fx_cells JOIN e USING (chrom, w_start, replicate, d) GROUP BY 1, 2, 3""")
add("mx05_genome_oe", lambda s, d: X.oe(s, d).groupBy("chrom", "replicate", "d").agg(F.avg("oe").alias("mean"), F.max("oe").alias("top")), "SELECT chrom, replicate, d, round(avg(oe), 6) AS mean, round(max(oe), 6) AS top FROM fx_oe GROUP BY 1, 2, 3")
add("mx06_reproducibility_oe", lambda s, d: X.oe(s, d).select("chrom", "replicate", K.reproducibility_oe(F.col("value"), F.when(F.col("d") % 7 == 0, 0.0).otherwise(F.col("expected"))).alias("v")).groupBy("chrom", "replicate").agg(F.count("v").alias("defined"), F.count("*").alias("n"), F.avg("v").alias("mean")), "SELECT chrom, replicate, count(*) FILTER (d % 7 <> 0 AND expected > 0) AS defined, count(*) AS n, round(avg(oe) FILTER (d % 7 <> 0 AND expected > 0), 6) AS mean FROM fx_oe GROUP BY 1, 2")
add("ag05_density_features", lambda s, d: K.density_features(X.oe(s, d), KEY, F.col("n"), "oe"), "SELECT chrom, w_start, replicate, round(avg(oe), 6) AS density_mean, round(stddev_pop(oe), 6) AS density_std, round(max(oe), 6) AS density_max, round(quantile_cont(oe, 0.95), 6) AS density_p95, round(sum(oe), 6) AS density_total FROM fx_dense JOIN fx_held USING (chrom, w_start, replicate) WHERE d > 2 GROUP BY 1, 2, 3", dense=True)
add("ag04_intensity_features", lambda s, d: K.intensity_features(X.cells(s, d), KEY, F.col("n")), "SELECT chrom, w_start, replicate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, sum(value) AS total, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM fx_both JOIN fx_held USING (chrom, w_start, replicate) GROUP BY 1, 2, 3", dense=True)
add("mx09_zero_axis", lambda s, d: K.zero_axis(X.cells(s, d), KEY, F.col("n")), "SELECT chrom, w_start, replicate, 64 - count(DISTINCT a) AS zero_axes FROM (SELECT chrom, w_start, replicate, unnest([i, j]) AS a FROM fx_cells WHERE value <> 0) GROUP BY 1, 2, 3")
add("mx01_log1p", lambda s, d: X.cells(s, d).groupBy(*KEY).agg(F.sum(F.log1p("value")).alias("total")), "SELECT chrom, w_start, replicate, round(sum(ln(1 + value)), 6) AS total FROM fx_cells GROUP BY 1, 2, 3")
add("mx02_percentile_clip", lambda s, d: K.percentile_clip(X.oe(s, d), KEY, F.col("n"), 0.995, "oe").groupBy(*KEY).agg(F.max("top").alias("top"), F.sum("clipped").alias("total")), """, q AS (SELECT chrom, w_start, replicate, quantile_cont(oe, 0.995) AS q FROM fx_both GROUP BY 1, 2, 3)
SELECT chrom, w_start, replicate, round(max(q), 6) AS top, round(sum(least(oe, q)), 6) AS total FROM fx_dense JOIN q USING (chrom, w_start, replicate) JOIN fx_held USING (chrom, w_start, replicate) GROUP BY 1, 2, 3""", dense=True)
WEIGHT = "(CASE WHEN d > 0 THEN 2 ELSE 1 END)"
add("mx03_minmax", lambda s, d: K.minmax(X.cells(s, d), KEY, F.col("n")).groupBy(*KEY).agg(F.expr(f"(sum(scaled * {WEIGHT}) + (4096 - sum({WEIGHT})) * first(zero_scaled)) / 4096").alias("mean"), F.min(F.least("scaled", "zero_scaled")).alias("low")), """, q AS (SELECT chrom, w_start, replicate, min(value) AS a, max(value) AS b FROM fx_both GROUP BY 1, 2, 3)
SELECT chrom, w_start, replicate, round(avg(CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END), 6) AS mean, round(min(CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END), 6) AS low FROM fx_both JOIN q USING (chrom, w_start, replicate) JOIN fx_held USING (chrom, w_start, replicate) GROUP BY 1, 2, 3""", dense=True)
add("mx07_robust_shape", lambda s, d: K.robust_shape(X.oe(s, d), KEY, F.col("n"), 5.0).groupBy(*KEY).agg(((F.sum("shape") + (2080 - F.count("*")) * F.first("zero_shape")) / 2080).alias("mean"), F.max(F.greatest("shape", "zero_shape")).alias("top"), F.first("zero_shape").alias("zero")), """, x AS (SELECT *, ln(1 + least(oe, 5)) AS x FROM fx_dense JOIN fx_held USING (chrom, w_start, replicate)), m AS (SELECT chrom, w_start, replicate, median(x) AS m FROM x WHERE d > 2 GROUP BY 1, 2, 3),
a AS (SELECT chrom, w_start, replicate, any_value(m) AS m, median(abs(x - m)) AS a FROM x JOIN m USING (chrom, w_start, replicate) WHERE d > 2 GROUP BY 1, 2, 3), z AS (SELECT chrom, w_start, replicate, x, greatest(-10, least(10, (x - m) / CASE WHEN a <= 1e-8 THEN 1 ELSE 1.4826 * a + 1e-8 END)) AS z FROM x JOIN a USING (chrom, w_start, replicate))
SELECT chrom, w_start, replicate, round(avg(z), 6) AS mean, round(max(z), 6) AS top, round(min(z) FILTER (x = 0), 6) AS zero FROM z GROUP BY 1, 2, 3""", dense=True)
add("mx08_triangle_masks", lambda s, d: X.cells(s, d).groupBy("chrom", "replicate").agg(F.count_if(F.col("d") >= 0).alias("upper"), F.count_if(F.col("d") > 0).alias("off_diagonal"), F.count_if(F.col("d") > 2).alias("beyond_band")), "SELECT chrom, replicate, count(*) FILTER (d >= 0) AS upper, count(*) FILTER (d > 0) AS off_diagonal, count(*) FILTER (d > 2) AS beyond_band FROM fx_cells GROUP BY 1, 2")


def paired_display(s, d):
    """Mean of both replicates' clipped O/E, log1p, and its 99.5th percentile by chromosome."""
    p = X.oe(s, d).groupBy("chrom", "w_start", "i", "j").agg((F.sum(F.least("oe", F.lit(5.0))) / 2).alias("v"))
    return p.groupBy("chrom").agg(F.expr("percentile(ln(1 + v), 0.995)").alias("vmax"), F.avg(F.log1p("v")).alias("mean"))


add("mx10_paired_display", paired_display, ", p AS (SELECT chrom, w_start, i, j, sum(least(oe, 5)) / 2 AS v FROM fx_oe GROUP BY 1, 2, 3, 4) SELECT chrom, round(quantile_cont(ln(1 + v), 0.995), 6) AS vmax, round(avg(ln(1 + v)), 6) AS mean FROM p GROUP BY 1")
add("mx11_input_transforms", lambda s, d: X.oe(s, d).select("chrom", "replicate", F.explode(F.array(F.struct(F.lit("raw").alias("input"), F.col("value").alias("v")), F.struct(F.lit("log1p").alias("input"), F.log1p("value").alias("v")), F.struct(F.lit("oe").alias("input"), F.col("oe").alias("v")))).alias("z")).groupBy("chrom", "replicate", F.col("z.input").alias("input")).agg(F.avg("z.v").alias("mean")), "SELECT chrom, replicate, input, round(avg(v), 6) AS mean FROM (SELECT chrom, replicate, 'raw' AS input, value AS v FROM fx_oe UNION ALL SELECT chrom, replicate, 'log1p', ln(1 + value) FROM fx_oe UNION ALL SELECT chrom, replicate, 'oe', oe FROM fx_oe) GROUP BY 1, 2, 3")
add("mx12_attention_ratio", lambda s, d: K.attention_ratio(X.oe(s, d), KEY, F.col("d") <= 2, "oe"), "SELECT chrom, w_start, replicate, round(CASE WHEN sum(oe) > 0 THEN coalesce(sum(oe) FILTER (d <= 2), 0) / sum(oe) ELSE 0 END, 6) AS ratio FROM fx_oe GROUP BY 1, 2, 3")
add("ag06_symmetry_error", lambda s, d: K.symmetry_error(X.cells(s, d), KEY), """, c AS (SELECT * FROM fx_cells)
SELECT chrom, w_start, replicate, round(max(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS symmetry_error FROM (
SELECT chrom, w_start, replicate, x.value AS a, y.value AS b FROM c x FULL JOIN (SELECT chrom, w_start, replicate, j AS i, i AS j, value FROM c) y USING (chrom, w_start, replicate, i, j)) GROUP BY 1, 2, 3""")


def qc(s, d):
    """Quality of the windows around structures: by type and over all."""
    c = X.cells(s, d).groupBy("chrom", "w_start").agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.count("*").alias("stored"))
    t = X.structures(s, d).withColumn("w_start", F.expr("CAST(floor((s_center - 3200) / 800) AS BIGINT) * 800")).join(c, ["chrom", "w_start"])
    g = t.groupingSets([["type"], []], "type").agg(F.grouping("type").alias("g"), F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.expr("percentile(top, 0.5)").alias("median_top"), F.avg(1 - F.col("stored") / 4160).alias("zero_fraction"), F.count_if(F.isnan("total")).alias("nan"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("type")).alias("type"), "n", "mean_total", "median_top", "zero_fraction", "nan")


add("ag06_qc_by_class", qc, """, c AS (SELECT chrom, w_start, sum(value) AS total, max(value) AS top, count(*) AS stored FROM fx_cells GROUP BY 1, 2),
t AS (SELECT t.type, c.* FROM (SELECT *, CAST(floor((s_center - 3200) / 800) AS BIGINT) * 800 AS w_start FROM fx_structures) t JOIN c ON c.chrom = t.chrom AND c.w_start = t.w_start)
SELECT coalesce(type, 'ALL') AS type, count(*) AS n, round(avg(total), 6) AS mean_total, round(quantile_cont(top, 0.5), 6) AS median_top, round(avg(1 - stored / 4160.0::DOUBLE), 6) AS zero_fraction, CAST(0 AS BIGINT) AS nan FROM t GROUP BY GROUPING SETS ((type), ())""")
add("iv01_windows", lambda s, d: X.windows(s, d).groupBy("scale", "chrom").agg(F.count("*").alias("n"), F.min("w_start").alias("first"), F.max("w_end").alias("last")), "SELECT scale, chrom, count(*) AS n, min(w_start) AS first, max(w_end) AS last FROM fx_windows GROUP BY 1, 2")
add(
    "sf03_window_ids",
    lambda s, d: X.windows(s, d).select("chrom", "scale", "w_start", ids.scale_window_id(F.col("scale"), F.col("chrom"), F.col("w_start"), F.col("w_end")).alias("id"), ids.window_id(F.concat(F.lit(" "), "chrom"), F.col("w_start"), F.col("w_end")).alias("plain_id")),
    "SELECT chrom, scale, w_start, 'WIN_' || scale || '_' || sha256(scale || '|' || chrom || '|' || w_start || '|' || w_end)[1:16] AS id, 'WIN_' || sha256(chrom || '|' || w_start || '|' || w_end)[1:16] AS plain_id FROM fx_windows",
)
add("sf01_structure_ids", lambda s, d: X.structures(s, d).select("structure", ids.structure_id(F.col("type"), F.col("chrom"), F.col("s_start"), F.col("s_end"), F.col("s_center")).alias("id")), "SELECT structure, type || '_' || sha256(type || '|' || chrom || '|' || s_start || '|' || s_end || '|' || regexp_replace(printf('%.6f', s_center), '\\.?0+$', ''))[1:16] AS id FROM fx_structures")
add("sf02_short_decimal", lambda s, d: X.table(s, d, "part").select("p_partkey", ids.short_decimal(F.col("p_retailprice") / 8).alias("text")), "SELECT p_partkey, regexp_replace(printf('%.6f', p_retailprice / 8), '\\.?0+$', '') AS text FROM part", False)


def region_names(s, d):
    """Identifiers of regions by all four schemes, each from its peak window's."""
    plain, scaled = ids.window_id(F.col("chrom"), F.col("w_start"), F.col("w_end")), ids.scale_window_id(F.lit("medium"), F.col("chrom"), F.col("w_start"), F.col("w_end"))
    kinds = {"single": plain, "multiscale": scaled, "equalized": scaled}
    return X.medium(s, d).select("chrom", "w_start", ids.region_id(F.col("chrom"), F.col("w_start"), F.col("w_end"), plain).alias("final"), *[ids.peak_region_id(k, c).alias(k) for k, c in kinds.items()])


add(
    "sf04_region_ids",
    region_names,
    """, w AS (SELECT *, sha256(chrom || '|' || w_start || '|' || w_end)[1:16] AS p, sha256('medium|' || chrom || '|' || w_start || '|' || w_end)[1:16] AS q FROM fx_medium)
SELECT chrom, w_start, 'FREG_' || sha256(chrom || '|' || w_start || '|' || w_end || '|WIN_' || p)[1:16] AS final, 'REG_' || p AS single, 'MSREG_medium_' || q AS multiscale, 'EQREG_medium_' || q AS equalized FROM w""",
)
add("sf05_safe_name", lambda s, d: X.table(s, d, "part").select("p_partkey", ids.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("name")), "SELECT p_partkey, regexp_replace(concat_ws('/', p_name, p_type), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM part", False)


def lateral_windows(s, d):
    """The windows of all scales through the table function, a lateral join of sizes and scales."""
    tables.register(s)
    scales = s.createDataFrame(list(K.SCALES), "scale string, window_bp long, step_bp long")
    return s.sql("SELECT c.scale, z.chrom, w.w_start, w.w_end FROM {sizes} z CROSS JOIN {scales} c, LATERAL sliding_windows(z.size_bp, c.window_bp, c.step_bp) w", sizes=X.sizes(s, d), scales=scales)  # scales are three rows


add("iv01_sliding_windows", lateral_windows, "SELECT scale, chrom, w_start, w_end FROM fx_windows")
