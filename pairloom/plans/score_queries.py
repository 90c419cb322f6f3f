"""Queries of scoring, calibration, statistics, splits, evaluation, gates, status and models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom import schema
from pairloom.functions import ids
from pairloom.functions import vectors as V
from pairloom.operators import baselines as B
from pairloom.operators import contacts as K
from pairloom.operators import intervals as I
from pairloom.operators import masked as M
from pairloom.operators import ml
from pairloom.operators import selection as S
from pairloom.operators import splits as P
from pairloom.operators import stats
from pairloom.operators import status as G
from pairloom.operators.ranges import quantiles, settled
from pairloom.plans import fixtures as X
from pairloom.plans.interval_queries import HIT
from pairloom.sources import annotations as A

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, fixtures: bool = True, dense: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: X.tidy(query(spark, sf_dir))
    if sql:
        ORACLES[name] = (X.DENSE if dense else X.SQL if fixtures else "") + sql


BRANCHES = [f"{r}_{b}" for r in ("rep1", "rep2") for b in ("density", "shape")]


def long_scores(s, d):
    """(chrom, w_start, known, split, branch, value) of all four branches."""
    return X.marked(s, d).select("chrom", "w_start", "known", "split", F.expr(f"stack(4, {', '.join(f'{b!r}, {b}' for b in BRANCHES)}) AS (branch, value)"))


LONG = ", l AS (" + " UNION ALL ".join(f"SELECT chrom, w_start, known, split, '{b}' AS branch, {b} AS value FROM fx_marked" for b in BRANCHES) + ")"
SCALE = LONG + """, m AS (SELECT branch, median(value) AS m FROM l WHERE split = 'train' GROUP BY 1),
f AS (SELECT branch, any_value(m) AS median, median(abs(value - m)) AS mad FROM l JOIN m USING (branch) WHERE split = 'train' GROUP BY 1)"""
fitted = lambda s, d: stats.robust_scale(long_scores(s, d).where("split = 'train'"), "value", ["branch"])
add("sc01_robust_scale", fitted, SCALE + " SELECT branch, round(median, 6) AS median, round(mad, 6) AS mad FROM f")
z_scores = lambda s, d: long_scores(s, d).join(fitted(s, d), "branch").withColumn("z", stats.robust_z(F.col("value"), F.col("median"), F.col("mad")))
Z = SCALE + ", z AS (SELECT l.*, (value - median) / (1.4826 * mad + 1e-8) AS z FROM l JOIN f USING (branch))"
add("sc02_robust_z", lambda s, d: z_scores(s, d).select("chrom", "w_start", "branch", "z"), Z + " SELECT chrom, w_start, branch, round(z, 6) AS z FROM z")
wide_z = lambda s, d: z_scores(s, d).groupBy("chrom", "w_start", "known").pivot("branch", BRANCHES).agg(F.first("z"))
WIDE = Z + ", v AS (SELECT chrom, w_start, known, " + ", ".join(f"max(z) FILTER (branch = '{b}') AS {b}" for b in BRANCHES) + " FROM z GROUP BY 1, 2, 3)"
add("sc03_weighted_fusion", lambda s, d: wide_z(s, d).select("chrom", "w_start", *[(0.6 * F.col(f"{r}_density") + 0.4 * F.col(f"{r}_shape")).alias(f"{r}_score") for r in ("rep1", "rep2")]), WIDE + " SELECT chrom, w_start, " + ", ".join(f"round(0.6::DOUBLE * {r}_density + 0.4::DOUBLE * {r}_shape, 6) AS {r}_score" for r in ("rep1", "rep2")) + " FROM v")


def fusions(c):
    a, b = F.col(f"{c}_density"), F.col(f"{c}_shape")
    return {"mean": (a + b) / 2, "or_max": F.greatest(a, b), "positive_sum": F.greatest(a, F.lit(0.0)) + F.greatest(b, F.lit(0.0))}


FUSED = "(({0}_density + {0}_shape) / 2)", "greatest({0}_density, {0}_shape)", "(greatest({0}_density, 0) + greatest({0}_shape, 0))"
add("sc04_fusions", lambda s, d: wide_z(s, d).select("chrom", "w_start", *[v.alias(f"{r}_{k}") for r in ("rep1", "rep2") for k, v in fusions(r).items()]), WIDE + " SELECT chrom, w_start, " + ", ".join(f"round({q.format(r)}, 6) AS {r}_{k}" for r in ("rep1", "rep2") for k, q in zip(("mean", "or_max", "positive_sum"), FUSED)) + " FROM v")


def window_scores(s, d):
    """Fused in each replicate, then averaged: maximum first, average second."""
    a, b = fusions("rep1")["or_max"], fusions("rep2")["or_max"]
    v = wide_z(s, d).select("chrom", "w_start", "known", F.round((a + b) / 2, 9).alias("score"), F.abs(a - b).alias("difference"), F.least(a, b).alias("least"))
    return S.ranked(v, [F.desc("score"), F.col("chrom"), F.col("w_start")], by=-F.col("score"))


SCORED = WIDE + ", s AS (SELECT chrom, w_start, known, round((greatest(rep1_density, rep1_shape) + greatest(rep2_density, rep2_shape)) / 2, 9) AS score, abs(greatest(rep1_density, rep1_shape) - greatest(rep2_density, rep2_shape)) AS difference, least(greatest(rep1_density, rep1_shape), greatest(rep2_density, rep2_shape)) AS least FROM v), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chrom, w_start) AS rank, count(*) OVER () AS n FROM s)"
add("sc05_window_scores", window_scores, SCORED + " SELECT chrom, w_start, known, round(score, 6) AS score, round(difference, 6) AS difference, round(least, 6) AS least, rank, round(1 - (rank - 1) / n, 6) AS percentile FROM t")
r9 = lambda df: df.withColumn("value", F.round("value", 9))
tails = lambda s, d: stats.tail_p_within(r9(long_scores(s, d)), "value", F.col("split") == "cal", ["branch"])
TAIL = LONG + ", k AS (SELECT chrom, w_start, known, split, branch, round(value, 9) AS value FROM l), p AS (SELECT k.*, (1 + (SELECT count(*) FROM k c WHERE c.split = 'cal' AND c.branch = k.branch AND c.value >= k.value)) / ((SELECT count(*) FROM k c WHERE c.split = 'cal' AND c.branch = k.branch) + 1.0::DOUBLE) AS p FROM k)"
add("sc06_tail_probability", lambda s, d: tails(s, d).select("chrom", "w_start", "branch", "p"), TAIL + " SELECT chrom, w_start, branch, round(p, 6) AS p FROM p")


def calibrated(s, d):
    """-log10 p averaged over replicates in each branch, then the larger branch: average first, maximum second."""
    p = tails(s, d).groupBy("chrom", "w_start", "known").pivot("branch", BRANCHES).agg(F.first("p"))
    a = lambda b: (-F.log10(f"rep1_{b}") - F.log10(f"rep2_{b}")) / 2
    return p.withColumns({"density_score": a("density"), "shape_score": a("shape")}).withColumn("or_score", F.greatest("density_score", "shape_score"))


CAL = TAIL + ", w AS (SELECT chrom, w_start, known, " + ", ".join(f"max(p) FILTER (branch = '{b}') AS {b}" for b in BRANCHES) + " FROM p GROUP BY 1, 2, 3), c AS (SELECT *, (-log10(rep1_density) - log10(rep2_density)) / 2 AS density_score, (-log10(rep1_shape) - log10(rep2_shape)) / 2 AS shape_score FROM w)"
add("sc07_calibrated_scores", lambda s, d: calibrated(s, d).select("chrom", "w_start", "density_score", "shape_score", "or_score"), CAL + " SELECT chrom, w_start, round(density_score, 6) + 0.0::DOUBLE AS density_score, round(shape_score, 6) + 0.0::DOUBLE AS shape_score, round(greatest(density_score, shape_score), 6) + 0.0::DOUBLE AS or_score FROM c")
FLOOR = "(SELECT 1.0::DOUBLE / (count(*) + 1) FROM fx_marked WHERE split = 'cal')"


def floored(s, d):
    floor = X.marked(s, d).where("split = 'cal'").agg((1 / (F.count("*") + 1)).alias("floor"))
    p = calibrated(s, d).crossJoin(F.broadcast(floor))  # one row
    a = lambda b: (-F.log10(F.greatest(f"rep1_{b}", "floor")) - F.log10(F.greatest(f"rep2_{b}", "floor"))) / 2
    return p.withColumn("equalized", F.greatest(a("density"), a("shape")))


add("sc08_common_floor", lambda s, d: floored(s, d).select("chrom", "w_start", "floor", "equalized"), CAL + f", e AS (SELECT *, {FLOOR} AS floor FROM c) SELECT chrom, w_start, round(floor, 6) AS floor, round(greatest((-log10(greatest(rep1_density, floor)) - log10(greatest(rep2_density, floor))) / 2, (-log10(greatest(rep1_shape, floor)) - log10(greatest(rep2_shape, floor))) / 2), 6) + 0.0::DOUBLE AS equalized FROM e")
add("sc09_paired_p", lambda s, d: calibrated(s, d).select("chrom", "w_start", F.sqrt(F.col("rep1_density") * F.col("rep2_density")).alias("pair_p"), (-F.log10(F.greatest("rep1_density", "rep2_density"))).alias("min_anomaly")), CAL + " SELECT chrom, w_start, round(sqrt(rep1_density * rep2_density), 6) AS pair_p, round(-log10(greatest(rep1_density, rep2_density)), 6) + 0.0::DOUBLE AS min_anomaly FROM c")


def background_clip(s, d):
    """The 99.5th percentile of O/E by replicate over the masks of all training windows, zeros that are not stored among them."""
    train = X.marked(s, d).where("split = 'train'").select("chrom", "w_start")
    own = settled(X.oe(s, d).where(F.col("d") > X.GAP).join(train, ["chrom", "w_start"]).select("replicate", "oe"))
    stored = own.groupBy("replicate").agg(F.count("*").alias("stored"))
    every = train.agg((F.count("*") * 1891).alias("cells"))
    zeros = s.createDataFrame([("rep1",), ("rep2",)], "replicate string").join(F.broadcast(every)).join(stored, "replicate", "left").select("replicate", (F.col("cells") - F.coalesce("stored", F.lit(0))).alias("zeros"))
    return quantiles(own, "oe", {"clip": 0.995}, ["replicate"], zeros)


add("sc10_background_clip", background_clip, "SELECT replicate, round(quantile_cont(oe, 0.995), 6) AS clip FROM fx_dense JOIN (SELECT chrom, w_start FROM fx_marked WHERE split = 'train') USING (chrom, w_start) WHERE d > 2 GROUP BY 1", dense=True)


def reconstruction(s, d):
    """Windows against the mean map of their replicate and chromosome."""
    c, n = settled(X.oe(s, d)), X.medium(s, d).groupBy("chrom").agg(F.count("*").alias("windows"))
    reps = n.withColumn("replicate", F.explode(F.array(F.lit("rep1"), F.lit("rep2"))))
    return K.reconstruction_error(c, ["chrom", "w_start", "replicate"], K.distance_model(c, ["chrom", "replicate"], reps, X.N), ["chrom", "replicate"], X.N)


add("sc11_reconstruction_error", reconstruction, ", m AS (SELECT chrom, replicate, d, avg(oe) AS m FROM fx_dense GROUP BY 1, 2, 3) SELECT chrom, w_start, replicate, round(avg((oe - m) * (oe - m)) FILTER (d > 2), 6) AS error, round(avg((oe - m) * (oe - m)), 6) AS all_error FROM fx_dense JOIN m USING (chrom, replicate, d) JOIN fx_held USING (chrom, w_start, replicate) GROUP BY 1, 2, 3", dense=True)
# proposals of six channels, three scales by two branches: peaks among windows under the tail threshold, and the regions they make
SCALE_NAMES = tuple(n for n, _, _ in K.SCALES)


def tail_scores(scaled):
    """scale_scores with rep{1,2}_{branch}_p: tails among the calibration windows of the scale."""
    own = ["scale", "chrom", "w_start"]
    each = scaled.select(*own, "split", F.expr(f"stack(4, {', '.join(f'{b!r}, round({b}, 9)' for b in BRANCHES)}) AS (branch, value)"))
    p = stats.tail_p_within(each, "value", F.col("split") == "cal", ["scale", "branch"]).groupBy(*own).pivot("branch", BRANCHES).agg(F.first("p"))
    return scaled.join(p.withColumnsRenamed({b: f"{b}_p" for b in BRANCHES}), own)


def proposals(s, d):
    return S.channel_proposals(tail_scores(settled(X.scale_scores(s, d))))


def candidate_regions(s, d):
    """Proposals of all channels, merged where they overlap, with their provenance and an identifier."""
    return S.merged_proposals(proposals(s, d), SCALE_NAMES)


FLAGS = ", ".join(f"bool_or(channel = '{s}_{b}') AS from_{s}_{b}" for s in SCALE_NAMES for b in ("density", "shape"))
PROPOSED = X.SCALED + """, tl AS (""" + " UNION ALL ".join(f"SELECT scale, chrom, w_start, split, '{b}' AS branch, round({b}, 9) AS value FROM fx_scaled" for b in BRANCHES) + """),
tc AS (SELECT scale, branch, list_sort(list(value)) AS v FROM tl WHERE split = 'cal' GROUP BY 1, 2),
tn AS (SELECT scale, branch, value, count(*) FILTER (split = 'cal') AS own FROM tl GROUP BY 1, 2, 3),
tu AS (SELECT *, sum(own) OVER (PARTITION BY scale, branch ORDER BY value DESC) AS up, sum(own) OVER (PARTITION BY scale, branch) AS total FROM tn),
tp AS (SELECT tl.scale, tl.chrom, tl.w_start, """ + ", ".join(f"max((1 + up) / (total + 1.0::DOUBLE)) FILTER (branch = '{b}') AS {b}_p" for b in BRANCHES) + """ FROM tl JOIN tu USING (scale, branch, value) GROUP BY 1, 2, 3),
ch AS (SELECT x.*, y.* EXCLUDE (scale, chrom, w_start) FROM fx_scaled x JOIN tp y ON x.scale = y.scale AND x.chrom = y.chrom AND x.w_start = y.w_start),
q AS (""" + " UNION ALL ".join(f"SELECT scale, '{b}' AS branch, scale || '_{b}' AS channel, window_id, window_bp, chrom, w_start, w_end, center, rep1_zero_axis OR rep2_zero_axis AS zero_axis, sqrt(rep1_{b}_p * rep2_{b}_p) AS pair_p, greatest(rep1_{b}_p, rep2_{b}_p) AS worst_p, rep1_{b}_p <= 0.05 AS s1, rep2_{b}_p <= 0.05 AS s2 FROM ch" for b in ("density", "shape")) + """),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom, channel ORDER BY pair_p, worst_p, w_start, w_end, window_id) AS k FROM q WHERE pair_p <= 0.05),
walk AS (SELECT DISTINCT chrom, channel, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL
  SELECT w.chrom, w.channel, o.k, CASE WHEN len(list_filter(w.kept, lambda c: abs(c - o.center) < o.window_bp / 2)) > 0 THEN w.kept ELSE list_append(w.kept, o.center) END FROM walk w JOIN o ON o.chrom = w.chrom AND o.channel = w.channel AND o.k = w.k + 1),
peaks AS (SELECT o.* FROM (SELECT chrom, channel, unnest(kept) AS center FROM (SELECT chrom, channel, arg_max(kept, k) AS kept FROM walk GROUP BY 1, 2)) a JOIN o ON o.chrom = a.chrom AND o.channel = a.channel AND o.center = a.center),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR w_start >= m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY w_start, w_end, window_id, channel ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(w_end) OVER (PARTITION BY chrom ORDER BY w_start, w_end, window_id, channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM peaks)),
rq AS (SELECT chrom, min(w_start) AS r_start, max(w_end) AS r_end, arg_min(struct_pack(window_id, center, pair_p, scale, branch), (pair_p, worst_p, w_start, w_end, window_id, channel)) AS b, count(DISTINCT channel) AS support_channels, count(*) AS members, """ + FLAGS + """,
  count(*) FILTER (s1) AS rep1_support, count(*) FILTER (s2) AS rep2_support, bool_or(zero_axis) AS zero_axis FROM i GROUP BY chrom, island),
regions AS (SELECT chrom, r_start, r_end, b.window_id AS window_id, b.center AS center, round(b.pair_p, 6) AS best_p, b.scale AS best_scale, b.branch AS best_branch, rq.* EXCLUDE (chrom, r_start, r_end, b), 'FREG_' || sha256(chrom || '|' || r_start || '|' || r_end || '|' || b.window_id)[1:16] AS region_id FROM rq)"""
add("tk08_channel_proposals", lambda s, d: proposals(s, d).select("channel", "window_id", "chrom", "w_start", "w_end", "center", "pair_p", "rep1_supported", "rep2_supported", "zero_axis"))
add("iv04_candidate_regions", candidate_regions)
REC = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1).replace(f"range({X.N})) AS d) x", "range(128)) AS d) x") + ", "
ORACLES["tk08_channel_proposals"] = REC + PROPOSED + " SELECT channel, window_id, chrom, w_start, w_end, center, round(pair_p, 6) AS pair_p, s1 AS rep1_supported, s2 AS rep2_supported, zero_axis FROM peaks"
ORACLES["iv04_candidate_regions"] = REC + PROPOSED + " SELECT * FROM regions"


def annotated(regions, structures):
    """Regions with the classes and the number of the structures that they overlap."""
    hit = I.range_join(regions, structures, X.BUCKET, ("r_start", "r_end")).groupBy("region_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("type"))).alias("types"), F.count("*").alias("known"))
    return regions.join(hit, "region_id", "left").select("region_id", "chrom", "r_start", "r_end", "members", "support_channels", F.coalesce("types", F.lit("")).alias("types"), F.coalesce("known", F.lit(0)).alias("known"))


def flagship(s, d):
    """Pixels to annotated candidate regions."""
    return annotated(settled(candidate_regions(s, d)), X.structures(s, d))


add("flagship_candidate_regions", flagship)
ORACLES["flagship_candidate_regions"] = REC + PROPOSED + " SELECT w.region_id, w.chrom, w.r_start, w.r_end, w.members, w.support_channels, coalesce(string_agg(DISTINCT t.type, ';' ORDER BY t.type), '') AS types, count(t.structure) AS known FROM regions w LEFT JOIN fx_structures t ON w.chrom = t.chrom AND w.r_start < t.s_end AND w.r_end > t.s_start GROUP BY ALL"


def recalled(regions, t):
    """Recall of the structures by class and over all: their centers in a region, and any overlap."""
    over = I.range_join(regions, t, X.BUCKET, ("r_start", "r_end")).select("structure", F.lit(True).alias("o")).distinct()
    center = I.center_join(regions.drop("center"), t, X.BUCKET, "s_center", ("r_start", "r_end")).select("structure", F.lit(True).alias("c")).distinct()
    g = t.join(over, "structure", "left").join(center, "structure", "left").groupingSets([["type"], []], "type").agg(F.grouping("type").alias("g"), F.count("*").alias("n"), F.avg(F.coalesce("c", F.lit(False)).cast("double")).alias("center_recall"), F.avg(F.coalesce("o", F.lit(False)).cast("double")).alias("interval_recall"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("type")).alias("type"), "n", "center_recall", "interval_recall")


def recall(s, d):
    return recalled(settled(candidate_regions(s, d)), X.structures(s, d))


add("ag13_recall_by_class", recall)
ORACLES["ag13_recall_by_class"] = REC + PROPOSED + ", h AS (SELECT t.*, EXISTS (SELECT 1 FROM regions r WHERE r.chrom = t.chrom AND r.r_start <= t.s_center AND t.s_center < r.r_end) AS c, EXISTS (SELECT 1 FROM regions r WHERE r.chrom = t.chrom AND r.r_start < t.s_end AND r.r_end > t.s_start) AS o FROM fx_structures t) SELECT coalesce(type, 'ALL') AS type, count(*) AS n, round(avg(c::INT), 6) AS center_recall, round(avg(o::INT), 6) AS interval_recall FROM h GROUP BY GROUPING SETS ((type), ())"
add("ag17_tail_audit", lambda s, d: calibrated(s, d).join(X.marked(s, d).where("split = 'cal'").select("chrom", "w_start"), ["chrom", "w_start"]).select(F.expr("stack(2, 'density', sqrt(rep1_density * rep2_density), 'shape', sqrt(rep1_shape * rep2_shape)) AS (channel, pair_p)")).groupBy("channel").agg(F.count("*").alias("n"), F.avg((F.col("pair_p") <= 0.05).cast("double")).alias("tail")), CAL + ", a AS (SELECT c.* FROM c JOIN fx_marked m USING (chrom, w_start) WHERE m.split = 'cal') SELECT channel, count(*) AS n, round(avg((pair_p <= 0.05)::INT), 6) AS tail FROM (SELECT 'density' AS channel, sqrt(rep1_density * rep2_density) AS pair_p FROM a UNION ALL SELECT 'shape', sqrt(rep1_shape * rep2_shape) FROM a) GROUP BY 1")
# statistics of replicates


def corr_sql(keys: str, a: str, b: str, frm: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    own = f"PARTITION BY {k}" + "{}"
    return f"SELECT {k}count(*) AS n, round(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 6) AS pearson, round(CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END, 6) AS spearman FROM (SELECT *, rank() OVER ({part} ORDER BY {a}) + (count(*) OVER ({own.format(a)}) - 1) / 2.0::DOUBLE AS ra, rank() OVER ({part} ORDER BY {b}) + (count(*) OVER ({own.format(b)}) - 1) / 2.0::DOUBLE AS rb FROM ({frm})) " + (f"GROUP BY {keys}" if keys else "")


def sides(cells, value):
    """Cells stored in either replicate with both values, a and b; the side that is not stored is 0."""
    c = cells.groupBy("chrom", "w_start", "i", "j", "d")
    return c.agg(*[F.coalesce(F.sum(F.when(F.col("replicate") == r, F.col(value))), F.lit(0.0)).alias(n) for r, n in (("rep1", "a"), ("rep2", "b"))])


MASKS = ", w AS (SELECT chrom, w_start, i, j, d, max(value) FILTER (replicate = 'rep1') AS a, max(value) FILTER (replicate = 'rep2') AS b, max(oe) FILTER (replicate = 'rep1') AS x, max(oe) FILTER (replicate = 'rep2') AS y FROM fx_dense GROUP BY 1, 2, 3, 4, 5)"
add("st01_pixel_correlations", lambda s, d: M.mask_correlations(sides(X.cells(s, d), "value"), X.medium(s, d).select("chrom", "w_start"), ["chrom", "w_start"], X.N), MASKS + " " + corr_sql("chrom, w_start, mask", "a", "b", "SELECT 'upper' AS mask, * FROM w UNION ALL SELECT 'offdiag', * FROM w WHERE d > 0 UNION ALL SELECT 'exclude_band2', * FROM w WHERE d > 2"), dense=True)


def subsets(s, d):
    """Density against shape, each the mean of both replicates' robust z, in four subsets of the windows."""
    v = wide_z(s, d)
    pair = lambda b: F.round((F.col(f"rep1_{b}") + F.col(f"rep2_{b}")) / 2, 9)
    v = v.select("chrom", "w_start", "known", pair("density").alias("a"), pair("shape").alias("b")).withColumn("score", F.greatest("a", "b"))
    background = X.marked(s, d).where("split IN ('train', 'val', 'cal')").select("chrom", "w_start").withColumn("background", F.lit(True))
    v = settled(v.join(background, ["chrom", "w_start"], "left"))
    top = S.top_fraction(v, [F.desc("score"), F.col("chrom"), F.col("w_start")], 0.1, by=-F.col("score")).select(F.lit("top_candidates").alias("subset"), "a", "b")
    each = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("background"), "background"), F.when(F.col("known"), "known_overlap")), lambda x: x.isNotNull()))
    return stats.correlations(v.select(each.alias("subset"), "a", "b").unionByName(top), "a", "b", ["subset"], wide=True)


add(
    "st02_branch_correlations",
    subsets,
    WIDE + """, u AS (SELECT v.known, m.split, v.chrom, v.w_start, round((rep1_density + rep2_density) / 2, 9) AS a, round((rep1_shape + rep2_shape) / 2, 9) AS b FROM v JOIN (SELECT chrom, w_start, split FROM fx_marked) m USING (chrom, w_start)),
o AS (SELECT *, row_number() OVER (ORDER BY greatest(a, b) DESC, chrom, w_start) AS k, count(*) OVER () AS total FROM u) """ + corr_sql("subset", "a", "b", "SELECT 'all' AS subset, a, b FROM o UNION ALL SELECT 'background', a, b FROM o WHERE split <> 'known' UNION ALL SELECT 'known_overlap', a, b FROM o WHERE known UNION ALL SELECT 'top_candidates', a, b FROM o WHERE k <= greatest(1, ceil(round(total * 0.1, 9)))"),
)
add("st03_undefined_correlation", lambda s, d: stats.correlations(X.table(s, d, "part").select("p_brand", F.lit(1.0).alias("a"), "p_retailprice"), "a", "p_retailprice", ["p_brand"]), "SELECT p_brand, count(*) AS n, CAST(NULL AS DOUBLE) AS pearson, CAST(NULL AS DOUBLE) AS spearman FROM part GROUP BY 1", False)


def measured(s, d):
    """O/E of both replicates in every medium window over the cells at distances that have an expectation in both, with what may spoil it."""
    key = ["chrom", "w_start"]
    ok = X.expected(s, d).groupBy("chrom", "d").agg((F.count_if(F.col("expected") > 0) == 2).alias("ok")).where("ok").select("chrom", "d")
    c = settled(X.oe(s, d))
    pairs = sides(c.where("d > 0").join(F.broadcast(ok), ["chrom", "d"]), "oe")  # at most N rows a chromosome
    sizes = X.medium(s, d).select(*key).join(F.broadcast(K.defined_cells(X.expected(s, d), X.N, X.GAP)), "chrom").select(*key, "m", "m_full", "total")
    held = K.zero_axis(c, [*key, "replicate"], F.col("n")).groupBy(*key).pivot("replicate", ["rep1", "rep2"]).agg(F.max("zero_axes"))
    flags = [F.coalesce(F.col(r) > 0, F.lit(True)).alias(f"{r}_zero_axis") for r in ("rep1", "rep2")]
    out = M.measure_pairs(pairs, sizes, key, gap=X.GAP).join(held, key, "left").select(*key, "n", "pearson", "spearman", "cosine", "rmse", "iqr", "nrmse", "full_pearson", "full_spearman", "finite_fraction", "reason", *flags)
    return out.withColumn("artifact_warning", F.col("rep1_zero_axis") | F.col("rep2_zero_axis") | (F.col("finite_fraction") < 1))


MEASURED = MASKS + ", ok AS (SELECT chrom, d FROM fx_expected GROUP BY 1, 2 HAVING count(*) FILTER (expected > 0) = 2), pf AS (SELECT * FROM w JOIN ok USING (chrom, d) WHERE d > 0), p AS (SELECT * FROM pf WHERE d > 2), k AS (" + corr_sql("chrom, w_start", "x", "y", "SELECT * FROM p") + "), kf AS (SELECT chrom, w_start, n AS nf, pearson AS full_pearson, spearman AS full_spearman FROM (" + corr_sql("chrom, w_start", "x", "y", "SELECT * FROM pf") + """)),
e AS (SELECT chrom, w_start, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS cosine, sqrt(avg((x - y) * (x - y))) AS rmse, min(x) = max(x) OR min(y) = max(y) AS flat FROM p GROUP BY 1, 2),
q AS (SELECT chrom, w_start, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT chrom, w_start, unnest([x, y]) AS v FROM p) GROUP BY 1, 2),
zx AS (SELECT chrom, w_start, max(t) FILTER (replicate = 'rep1') = 0 AS z1, max(t) FILTER (replicate = 'rep2') = 0 AS z2 FROM (SELECT chrom, w_start, replicate, min(t) AS t FROM (SELECT chrom, w_start, replicate, ax, sum(value) AS t FROM (SELECT chrom, w_start, replicate, i AS ax, value FROM fx_dense UNION ALL SELECT chrom, w_start, replicate, j, value FROM fx_dense) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT k.chrom, k.w_start, k.n, CASE WHEN n >= 10 THEN pearson END AS pearson, CASE WHEN n >= 10 THEN spearman END AS spearman, cosine, rmse, iqr, CASE WHEN nf >= 10 THEN full_pearson END AS full_pearson, CASE WHEN nf >= 10 THEN full_spearman END AS full_spearman, n / 1891.0::DOUBLE AS finite_fraction,
  CASE WHEN n < 10 THEN 'too_few_valid_pixels' WHEN flat THEN 'zero_variance' WHEN pearson IS NULL OR spearman IS NULL THEN 'undefined_correlation' ELSE 'valid' END AS reason, z1 AS rep1_zero_axis, z2 AS rep2_zero_axis, z1 OR z2 OR n < 1891 AS artifact_warning
  FROM k JOIN kf USING (chrom, w_start) JOIN e USING (chrom, w_start) JOIN q USING (chrom, w_start) JOIN zx USING (chrom, w_start))"""
#: NRMSE over an interquartile range of 0 is a number without digits to compare; its parts are there.
add("st04_pair_measurement", lambda s, d: measured(s, d).withColumn("nrmse", F.when(F.round("iqr", 6) > 0, F.col("nrmse"))), MEASURED + " SELECT chrom, w_start, n, pearson, spearman, round(cosine, 6) AS cosine, round(rmse, 6) AS rmse, round(iqr, 6) AS iqr, CASE WHEN round(iqr, 6) > 0 THEN round(rmse / (iqr + 1e-12), 6) END AS nrmse, full_pearson, full_spearman, round(finite_fraction, 6) AS finite_fraction, reason, rep1_zero_axis, rep2_zero_axis, artifact_warning FROM g", dense=True)


def intensity(s, d):
    """Counts against O/E over the whole upper triangle of every window of each replicate that holds a cell."""
    c, key = X.oe(s, d).select("chrom", "w_start", "replicate", F.round("value", 9).alias("a"), F.round("oe", 9).alias("b")), ["chrom", "w_start", "replicate"]
    return M.paired_moments(c, c.select(*key).distinct().withColumn("m", F.lit(2080)), key).select(*key, "n", "pearson", "spearman")


add("st05_intensity_correlation", intensity, corr_sql("chrom, w_start, replicate", "a", "b", "SELECT chrom, w_start, replicate, round(value, 9) AS a, round(oe, 9) AS b FROM fx_dense JOIN fx_held USING (chrom, w_start, replicate)"), dense=True)
known_measured = lambda s, d: measured(s, d).join(X.marked(s, d).select("chrom", "w_start", "known"), ["chrom", "w_start"]).withColumns({"pearson": F.round("pearson", 6), "spearman": F.round("spearman", 6)})
KNOWN = MEASURED + ", gk AS (SELECT g.*, m.known FROM g JOIN fx_marked m USING (chrom, w_start))"
add("st06_known_floor", lambda s, d: stats.known_floor(known_measured(s, d).where("known"), "pearson", "spearman"), KNOWN + ", fl AS (SELECT quantile_cont(pearson, 0.05) AS a, quantile_cont(spearman, 0.05) AS b FROM gk WHERE known) SELECT round(a, 6) AS pearson_floor, round(b, 6) AS spearman_floor, coalesce(a >= 0 AND b >= 0, false) AS valid FROM fl", dense=True)
add("ag08_consistency_summary", lambda s, d: stats.quartile_summary(known_measured(s, d), "pearson", "chrom"), KNOWN + " SELECT coalesce(chrom, 'ALL') AS chrom, count(pearson) AS n, round(avg(pearson), 6) AS mean, round(median(pearson), 6) AS median, round(stddev_samp(pearson), 6) AS std, round(quantile_cont(pearson, 0.25), 6) AS q1, round(quantile_cont(pearson, 0.75), 6) AS q3 FROM gk GROUP BY GROUPING SETS ((chrom), ())", dense=True)
QS = {f"p{int(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}


def known_distribution(s, d):
    """Quantiles of the known windows' Spearman by chromosome and over all."""
    k = settled(known_measured(s, d).where("known").select("chrom", "spearman"))
    both = k.unionByName(k.withColumn("chrom", F.lit("ALL")))
    return quantiles(both, "spearman", QS, ["chrom"]).withColumn("iqr", F.col("p75") - F.col("p25"))


add("ag20_known_distribution", known_distribution, KNOWN + " SELECT coalesce(chrom, 'ALL') AS chrom, " + ", ".join(f"round(quantile_cont(spearman, {q}), 6) AS {n}" for n, q in QS.items()) + ", round(quantile_cont(spearman, 0.75) - quantile_cont(spearman, 0.25), 6) AS iqr FROM gk WHERE known GROUP BY GROUPING SETS ((chrom), ())", dense=True)
# classification: quality against length


def predictions(s, d):
    return X.table(s, d, "labels").join(X.table(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").cast("int").alias("t"), (F.col("n_chars") > 1000).cast("int").alias("p"), (F.col("n_chars") % 997).cast("double").alias("score"))


PRED = "WITH pr AS (SELECT doc_id, lang, CAST(quality AS BIGINT) AS t, CAST(n_chars > 1000 AS BIGINT) AS p, CAST(n_chars % 997 AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"
add("ag11_confusion", lambda s, d: stats.confusion(predictions(s, d), "t", "p"), PRED + ", c AS (SELECT DISTINCT unnest([t, p]) AS c FROM pr), g AS (SELECT a.c AS t, b.c AS p, count(pr.t) AS n FROM c a CROSS JOIN c b LEFT JOIN pr ON pr.t = a.c AND pr.p = b.c GROUP BY 1, 2) SELECT t, p, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY t), 0), 0), 6) AS share FROM g", False)
CLASS = PRED + ", c AS (SELECT DISTINCT unnest([t, p]) AS c FROM pr), m AS (SELECT c.c AS class, count(*) FILTER (t = c.c) AS support, coalesce(count(*) FILTER (t = c.c AND p = c.c) / nullif(count(*) FILTER (p = c.c), 0), 0) AS prec, coalesce(count(*) FILTER (t = c.c AND p = c.c) / nullif(count(*) FILTER (t = c.c), 0), 0) AS rec FROM c CROSS JOIN pr GROUP BY 1), f AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM m)"
add("ag11_class_metrics", lambda s, d: stats.class_metrics(predictions(s, d), "t", "p"), CLASS + " SELECT class, support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM f", False)
add("ag11_summary_metrics", lambda s, d: stats.summary_metrics(predictions(s, d), "t", "p"), CLASS + " SELECT round(sum(rec * support) / sum(support), 6) AS accuracy, round(avg(rec) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f", False)
add("st08_auc", lambda s, d: stats.auc(predictions(s, d), "t", "score"), PRED + ", g AS (SELECT score, sum(t) AS pos, sum(1 - t) AS neg FROM pr GROUP BY 1), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6) AS average_precision FROM r", False)
add("st07_adjusted_rand", lambda s, d: stats.adjusted_rand(predictions(s, d), "t", "lang"), PRED + ", c AS (SELECT t, lang, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS al FROM c), b AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY t)), e AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY lang)) SELECT round((ij - i * j / (al * (al - 1) / 2)) / ((i + j) / 2 - i * j / (al * (al - 1) / 2)), 6) AS ari FROM a, b, e", False)
add("ag03_aggregate_logits", lambda s, d: predictions(s, d).groupBy(F.expr("doc_id div 3").alias("unit")).agg(F.avg("score").alias("logit"), F.count_distinct("t").alias("labels")), PRED + " SELECT doc_id // 3 AS unit, round(avg(score), 6) AS logit, count(DISTINCT t) AS labels FROM pr GROUP BY 1", False)
add("ag10_group_summary", lambda s, d: predictions(s, d).groupBy("t", (F.col("t") == F.col("p")).alias("correct")).agg(F.count_distinct("doc_id").alias("units"), F.count("*").alias("n"), F.avg("score").alias("mean")), PRED + " SELECT t, t = p AS correct, count(DISTINCT doc_id) AS units, count(*) AS n, round(avg(score), 6) AS mean FROM pr GROUP BY 1, 2", False)
add("ag21_class_weights", lambda s, d: P.class_weights(X.structures(s, d), "structure", "type"), "SELECT type, count(*) AS n, round((SELECT count(*) FROM fx_structures) / ((SELECT count(DISTINCT type) FROM fx_structures) * count(*))::DOUBLE, 6) AS weight FROM fx_structures GROUP BY 1")
add("ag22_participation", lambda s, d: X.pixels(s, d).groupBy("replicate").agg(F.count_distinct("bin1").alias("bins"), F.count_distinct("chrom").alias("chroms")), "SELECT replicate, count(DISTINCT bin1) AS bins, count(DISTINCT chrom) AS chroms FROM fx_pixels GROUP BY 1")
add("ag09_split_counts", lambda s, d: X.marked(s, d).groupBy("split").pivot("chrom", ["A", "N", "R"]).count().na.fill(0), "SELECT split, count(*) FILTER (chrom = 'A') AS \"A\", count(*) FILTER (chrom = 'N') AS \"N\", count(*) FILTER (chrom = 'R') AS \"R\" FROM fx_marked GROUP BY 1")
REPEATS = ", b AS (SELECT chrom, w_start // 6400 AS setting, rep1_density AS v FROM fx_scores)"
add("ag07_repeat_summary", lambda s, d: B.summary(X.scores(s, d).select(F.expr("w_start div 6400").alias("setting"), "rep1_density"), "rep1_density"), REPEATS + " SELECT setting, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.975), 6) AS q975 FROM b GROUP BY 1")
add("ag23_enrichment", lambda s, d: window_scores(s, d).agg(F.avg(F.when(F.col("percentile") > 0.8, F.col("known").cast("double"))).alias("selected"), F.avg(F.col("known").cast("double")).alias("overall")).select("selected", "overall", F.when(F.col("overall") > 0, F.col("selected") / F.col("overall")).when(F.col("selected") > 0, float("inf")).otherwise(0.0).alias("enrichment")), SCORED + ", e AS (SELECT avg(known::INT) FILTER (1 - (rank - 1) / n > 0.8) AS a, avg(known::INT) AS b FROM t) SELECT round(a, 6) AS selected, round(b, 6) AS overall, round(a / b, 6) AS enrichment FROM e")
FR = (0.01, 0.02, 0.05, 0.1, 0.2)


def recall_at(s, d):
    top = window_scores(s, d).join(X.medium(s, d).select("chrom", "w_start", "w_end"), ["chrom", "w_start"])
    best = I.best_overlap(X.structures(s, d), top, ["structure"], F.col("rank"), X.BUCKET)
    n = X.medium(s, d).agg(F.count("*").alias("n"))
    return X.structures(s, d).join(best, "structure", "left").crossJoin(F.broadcast(n)).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FR]))).groupBy("fraction").agg(F.avg(F.coalesce(F.col("best_rank") <= F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.col("fraction"), 9))), F.lit(False)).cast("double")).alias("recall"))


BEST = SCORED + f", br AS (SELECT s2.structure, s2.type, min(w.rank) AS best FROM fx_structures s2 LEFT JOIN (SELECT t.*, w_start + 6400 AS w_end FROM t) w ON w.chrom = s2.chrom AND w.w_start < s2.s_end AND w.w_end > s2.s_start GROUP BY 1, 2)"
add("ev01_recall_at_fractions", recall_at, BEST + ", fr AS (SELECT CAST(unnest([0.01, 0.02, 0.05, 0.1, 0.2]) AS DOUBLE) AS fraction) SELECT fraction, round(avg(coalesce(best <= greatest(1, ceil(round((SELECT count(*) FROM fx_medium) * fraction, 9))), false)::INT), 6) AS recall FROM br CROSS JOIN fr GROUP BY 1")
add("ev03_score_ablation", lambda s, d: S.ranked(z_scores(s, d), [F.desc(F.round("z", 9)), F.col("chrom"), F.col("w_start")], ["branch"], by=-F.round("z", 9)).where("rank <= 100").groupBy("branch").agg(F.count_if("known").alias("known"), F.min("z").alias("least")), Z + " SELECT branch, count(*) FILTER (known) AS known, round(min(z), 6) AS least FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY round(z, 9) DESC, chrom, w_start) AS rank FROM z) WHERE rank <= 100 GROUP BY 1")
add("ag14_missed_structures", lambda s, d: X.structures(s, d).join(I.best_overlap(X.structures(s, d), window_scores(s, d).join(X.medium(s, d).select("chrom", "w_start", "w_end"), ["chrom", "w_start"]), ["structure"], F.col("rank"), X.BUCKET), "structure", "left").where("best_rank > 100 OR best_rank IS NULL").groupBy("type").agg(F.count("*").alias("missed"), F.median("best_rank").alias("median_rank")), BEST + " SELECT type, count(*) AS missed, round(median(best), 6) AS median_rank FROM br WHERE best > 100 OR best IS NULL GROUP BY 1")
add("ag16_rescue_categories", lambda s, d: X.structures(s, d).join(I.range_join(X.windows(s, d), X.structures(s, d), X.BUCKET).groupBy("structure").agg(F.collect_set("scale").alias("scales")), "structure", "left").groupBy(F.when(F.col("scales").isNull(), "none").when(F.size("scales") > 1, "several").otherwise(F.col("scales")[0]).alias("category")).agg(F.count("*").alias("n")), f", a AS (SELECT t.structure, list(DISTINCT w.scale) FILTER (w.scale IS NOT NULL) AS s FROM fx_structures t LEFT JOIN fx_windows w ON {HIT} GROUP BY 1) SELECT CASE WHEN s IS NULL THEN 'none' WHEN len(s) > 1 THEN 'several' ELSE s[1] END AS category, count(*) AS n FROM a GROUP BY 1")


def scale_contribution(s, d):
    """How many of the best windows, in an order by hash, each scale has."""
    key = ids.tie_key(1, F.concat_ws("|", "scale", "chrom", "w_start"))
    r = S.ranked(X.windows(s, d).withColumn("key", key), [F.col("key")], by=F.conv(F.substring("key", 1, 12), 16, 10).cast("double"))
    return r.groupBy("scale").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 20).alias("top20"), F.count_if(F.col("rank") <= 100).alias("top100"))


add("ag15_scale_contribution", scale_contribution, "SELECT scale, count(*) AS n, count(*) FILTER (rank <= 20) AS top20, count(*) FILTER (rank <= 100) AS top100 FROM (SELECT *, row_number() OVER (ORDER BY sha256('1|' || scale || '|' || chrom || '|' || w_start)) AS rank FROM fx_windows) GROUP BY 1")
# splits, gates, status, sets
HASHED = ", bl AS (SELECT DISTINCT chrom || ':' || block AS block_id FROM fx_marked), hs AS (SELECT block_id, row_number() OVER (ORDER BY sha256('20260920|' || block_id), block_id) AS r, count(*) OVER () AS n FROM bl)"
block_ids = lambda s, d: X.marked(s, d).select(F.concat("chrom", F.lit(":"), F.col("block").cast("string")).alias("block_id")).distinct()
add("sp03_block_split", lambda s, d: P.hash_block_split(block_ids(s, d), "block_id", 20260920), HASHED + " SELECT block_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM hs")
add("sp02_two_way_split", lambda s, d: P.hash_block_split(block_ids(s, d), "block_id", 20260920, (0.8, 0.2)), HASHED + " SELECT block_id, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM hs")
add("sf10_block_names", lambda s, d: X.structures(s, d).select("structure", P.block_name(F.col("chrom"), F.col("s_center")).alias("block")), "SELECT structure, chrom || ':' || CAST(floor(s_center / 128000) AS BIGINT) AS block FROM fx_structures")
grouped_structures = lambda s, d: I.islands(X.structures(s, d), "s_start", "s_end", ["structure"], ["chrom"]).withColumn("grp", F.concat_ws(":", "chrom", "island"))
add("sp01_group_split", lambda s, d: P.group_split(grouped_structures(s, d), "grp", "type", ["CHIN", "OPCID", "CHID"]).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups")))


def split_faults(s, d):
    """Groups in two splits: none as split, and those of which one member in seven is moved to another."""
    rows = settled(P.group_split(grouped_structures(s, d), "grp", "type", ["CHIN", "OPCID", "CHID"]).select("grp", "structure", "split"))
    moved = rows.withColumn("split", F.when(F.col("structure") % 7 == 0, "moved").otherwise(F.col("split")))
    bad = lambda x, n: P.groups_in_two_splits(x, "grp", "split").agg(F.count("*").alias("bad")).select(F.lit(n).alias("table"), "bad")
    return bad(rows, "as split").unionByName(bad(moved, "moved"))


add("val04_groups_in_two_splits", split_faults, """, i AS (SELECT *, sum(CASE WHEN m IS NULL OR s_start >= m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure) AS island FROM (SELECT *, max(s_end) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_structures)),
g AS (SELECT chrom, island, bool_or(structure % 7 = 0) AND bool_or(structure % 7 <> 0) AS mixed FROM i GROUP BY 1, 2)
SELECT 'as split' AS "table", CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'moved', count(*) FILTER (mixed) FROM g""")
add("sp04_group_folds", lambda s, d: P.group_folds(X.marked(s, d).groupBy("chrom", "block").count().withColumn("g", F.concat_ws(":", "chrom", "block")), "g", "count", 5).groupBy("fold").agg(F.sum("count").alias("n")))
ORACLES["sp04_group_folds"] = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1) + """, g AS (SELECT chrom || ':' || block AS g, count(*) AS n FROM fx_marked GROUP BY 1), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS k FROM g),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load UNION ALL
  SELECT o.k, list_transform(range(1, 6), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN o.n ELSE 0 END) FROM walk JOIN o ON o.k = walk.k + 1)
SELECT CAST(fold - 1 AS BIGINT) AS fold, n FROM (SELECT unnest(range(1, 6)) AS fold, unnest(load) AS n FROM (SELECT arg_max(load, k) AS load FROM walk)) WHERE n > 0"""
add("gt01_readiness_gate", lambda s, d: recall_at(s, d).agg(F.max(F.when(F.col("fraction") == 0.2, F.col("recall"))).alias("top"), F.min("recall").alias("low"), F.count("*").alias("n")).select(*G.gate({"enough_recall": F.col("top") >= 0.2, "monotone": F.col("low") <= F.col("top"), "all_fractions": F.col("n") == 5})), None)
ORACLES["gt01_readiness_gate"] = "WITH r AS (" + ORACLES["ev01_recall_at_fractions"] + "), g AS (SELECT max(recall) FILTER (fraction = 0.2) >= 0.2 AS a, min(recall) <= max(recall) FILTER (fraction = 0.2) AS b, count(*) = 5 AS c FROM r) SELECT a AS enough_recall, b AS monotone, c AS all_fractions, a AND b AND c AS ready FROM g"


def candidates(s, d):
    """Windows as candidates: noise and clusters by place, cluster 3 without annotated windows; a window passes from the 5th percentiles of the known ones on.

    Every eleventh one outside cluster 3 is made to fail and every 97th to be undefined, so that all statuses are met.
    """
    w = F.expr("w_start div 800")
    c = settled(known_measured(s, d)).withColumn("cluster_id", F.when(w % 5 == 0, -1).when(F.col("known"), w % 3).otherwise(w % 4))
    floor = stats.known_floor(c.where("known"), "pearson", "spearman")
    kind = F.when(F.col("cluster_id") == 1, "CHIN-like").when(F.col("cluster_id") == 3, "unannotated").otherwise("mixed-known")
    passes = (F.col("pearson") >= F.col("pearson_floor")) & (F.col("spearman") >= F.col("spearman_floor")) & ((w % 11 != 0) | (F.col("cluster_id") == 3))
    out = c.crossJoin(F.broadcast(floor.drop("valid")))  # one row
    return out.withColumns({"cluster_annotation": kind, "novel_like": F.col("cluster_id") == 3, "correlation_valid": (F.col("reason") == "valid") & (w % 97 != 0), "passes": passes})


def statuses(s, d, calibrated=True):
    c = settled(candidates(s, d))
    clusters = c.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("candidate_count"), F.bool_and("novel_like").alias("novel_like"))
    clusters = clusters.withColumn("known_count", F.when(F.col("cluster_id") == 3, 0).otherwise(4))
    return G.with_status(c, clusters, calibrated)


CANDIDATES = KNOWN + """, fl AS (SELECT quantile_cont(pearson, 0.05) AS pf, quantile_cont(spearman, 0.05) AS sf FROM gk WHERE known),
ca AS (SELECT *, w_start // 800 AS w, CASE WHEN w_start // 800 % 5 = 0 THEN -1 WHEN known THEN w_start // 800 % 3 ELSE w_start // 800 % 4 END AS cluster_id FROM gk, fl),
cb AS (SELECT *, reason = 'valid' AND w % 97 <> 0 AS ok, CASE WHEN reason = 'valid' AND w % 97 <> 0 THEN coalesce(pearson >= pf AND spearman >= sf AND (w % 11 <> 0 OR cluster_id = 3), false) END AS pass FROM ca),
cl AS (SELECT cluster_id, count(*) >= 5 AND NOT bool_or(known) AND avg(pass::INT) >= 0.8 AS fit FROM cb WHERE cluster_id = 3 GROUP BY 1),
cs AS (SELECT cb.*, coalesce(fit, false) AND coalesce(pass, false) AS strict,
  CASE WHEN known THEN 'KNOWN_OVERLAP' WHEN cb.cluster_id = 3 THEN 'STRICT_NOVEL_CLUSTER' WHEN cb.cluster_id = -1 THEN 'UNANNOTATED_NOISE' ELSE 'UNANNOTATED_CLUSTERED' END AS pool FROM cb LEFT JOIN cl ON cl.cluster_id = cb.cluster_id),
ct AS (SELECT *, CASE WHEN NOT ok THEN 'INSUFFICIENT_QUALITY' WHEN known THEN 'KNOWN_OVERLAP' WHEN strict THEN 'STRICT_NOVEL_CLUSTER_MEMBER'
  ELSE CASE WHEN cluster_id = -1 THEN 'UNANNOTATED_NOISE' WHEN cluster_id = 1 THEN 'KNOWN_LIKE_CLUSTER' ELSE 'UNANNOTATED_CLUSTERED' END || CASE WHEN pass THEN '_REPRODUCIBLE' ELSE '_LOW_REPRODUCIBILITY' END END AS status FROM cs)"""
add("cs01_status_cascade", lambda s, d: statuses(s, d).select("chrom", "w_start", F.col("candidate_pool").alias("pool"), F.col("final_status").alias("status"), "reproducible", "strict_novel_candidate"), CANDIDATES + " SELECT chrom, w_start, pool, status, pass AS reproducible, strict AS strict_novel_candidate FROM ct", dense=True)
add(
    "cs01_without_calibration",
    lambda s, d: statuses(s, d, False).groupBy("final_status").agg(F.count("*").alias("n"), F.count("reproducible").alias("decided"), F.first("evidence_note").alias("note")),
    CANDIDATES + """, u AS (SELECT CASE WHEN ok THEN 'CONTROL_CALIBRATION_FAILURE' ELSE 'INSUFFICIENT_QUALITY' END AS final_status FROM ct)
SELECT final_status, count(*) AS n, CAST(0 AS BIGINT) AS decided, CASE WHEN final_status LIKE 'CONTROL%' THEN 'Known-control floor invalid; binary candidate filtering stopped.' ELSE 'Primary correlation undefined; retain continuous diagnostics.' END AS note FROM u GROUP BY 1""",
    dense=True,
)


def cluster_reproducibility(s, d):
    """Valid windows, median and interquartile range of Spearman, and the share that passes, by cluster."""
    k = settled(known_measured(s, d).select(F.expr("w_start div 800 % 4").alias("cluster"), "reason", "spearman"))
    own = k.groupBy("cluster").agg(F.count_if(F.col("reason") == "valid").alias("valid"), F.avg((F.col("spearman") >= 0.02).cast("double")).alias("passing"))
    q = quantiles(k, "spearman", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["cluster"])
    return own.join(q, "cluster", "left").select("cluster", "valid", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "passing")


add("ag19_cluster_reproducibility", cluster_reproducibility, KNOWN + " SELECT w_start // 800 % 4 AS cluster, count(*) FILTER (reason = 'valid') AS valid, round(median(spearman), 6) AS median, round(quantile_cont(spearman, 0.75) - quantile_cont(spearman, 0.25), 6) AS iqr, round(avg((spearman >= 0.02)::INT), 6) AS passing FROM gk GROUP BY 1", dense=True)


def follow_up(s, d):
    """The strict table and the follow-up table, ranked by reproducibility."""
    strict, more = G.final_tables(statuses(s, d))
    order = [F.desc_nulls_last("spearman"), F.desc_nulls_last("pearson"), F.col("chrom"), F.col("w_start")]
    rows = strict.withColumn("final_table", F.lit("strict")).unionByName(more.withColumn("final_table", F.lit("follow_up")))
    return S.ranked(rows, order, ["final_table"], by=-F.coalesce("spearman", F.lit(-2.0))).select("final_table", "rank", "chrom", "w_start", "final_status")


add(
    "cs03_follow_up",
    follow_up,
    CANDIDATES + """, ft AS (SELECT *, CASE WHEN strict AND NOT known THEN 'strict' ELSE 'follow_up' END AS final_table FROM ct WHERE NOT known AND pass AND (strict OR status IN ('UNANNOTATED_CLUSTERED_REPRODUCIBLE', 'UNANNOTATED_NOISE_REPRODUCIBLE', 'KNOWN_LIKE_CLUSTER_REPRODUCIBLE')))
SELECT final_table, row_number() OVER (PARTITION BY final_table ORDER BY spearman DESC NULLS LAST, pearson DESC NULLS LAST, chrom, w_start) AS rank, chrom, w_start, status AS final_status FROM ft""",
    dense=True,
)


def cluster_table(s, d):
    """Clusters of vectors: known members (labels 0 to 2, as classes), candidates (the others), and candidates that overlap an annotation."""
    e = X.table(s, d, "embeddings").withColumns({"cluster": F.col("vec_id") % 40, "known": F.col("label") <= 2})
    e = e.withColumn("known", F.col("known") & (F.col("cluster") % 4 != 0)).withColumn("overlaps", ~F.col("known") & (F.col("vec_id") % 120 == 8))
    c = e.groupBy("cluster", "known", "label").agg(F.count("*").alias("n"), F.count_if("overlaps").alias("o"))
    own = F.when(F.col("known"), F.struct("n", (-F.col("label")).alias("l")))
    top = c.groupBy("cluster").agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known_count"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("candidate_count"), F.sum("o").alias("overlap_count"), F.max(own).alias("top")
    )
    top = top.withColumns({"dominant": -F.col("top.l"), "purity": F.try_divide(F.col("top.n").cast("double"), F.col("known_count").cast("double"))})
    top = top.withColumn("annotation", G.annotation(F.col("purity"), F.concat(F.lit("T"), F.col("dominant").cast("string")), F.col("known_count")))
    top = top.withColumn("novel_like", G.novel_like(F.col("candidate_count"), F.col("known_count"), F.col("overlap_count")))
    return top.withColumn("priority", G.priority(F.col("novel_like"), F.col("candidate_count"), F.col("known_count"), F.col("annotation"))).drop("top")


CLUSTERS = """WITH e AS (SELECT *, vec_id % 40 AS cluster, label <= 2 AND vec_id % 40 % 4 <> 0 AS known FROM embeddings), f AS (SELECT *, NOT known AND vec_id % 120 = 8 AS ov FROM e),
c AS (SELECT cluster, known, label, count(*) AS n, count(*) FILTER (ov) AS o FROM f GROUP BY 1, 2, 3),
t AS (SELECT cluster, CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS known_count, CAST(coalesce(sum(n) FILTER (NOT known), 0) AS BIGINT) AS candidate_count, CAST(sum(o) AS BIGINT) AS overlap_count,
  arg_max(label, (n, -label)) FILTER (known) AS dominant, max(n) FILTER (known) AS top FROM c GROUP BY 1),
u AS (SELECT *, top / known_count::DOUBLE AS purity, candidate_count >= 5 AND known_count = 0 AND overlap_count = 0 AS novel_like FROM t),
v AS (SELECT *, CASE WHEN known_count = 0 THEN 'unannotated' WHEN purity >= 0.5 THEN 'T' || dominant || '-like' ELSE 'mixed-known' END AS annotation FROM u)
SELECT cluster, known_count, candidate_count, overlap_count, CAST(dominant AS BIGINT) AS dominant, round(purity, 6) AS purity, annotation, novel_like,
CASE WHEN novel_like THEN 'High' WHEN known_count > 0 AND (annotation <> 'mixed-known' OR candidate_count = 0) THEN 'Low' ELSE 'Medium' END AS priority FROM v"""
add("ag18_cluster_summary", cluster_table, CLUSTERS, False)
add("cs02_annotation", lambda s, d: cluster_table(s, d).groupBy("annotation", "novel_like", "priority").agg(F.count("*").alias("n")), "SELECT annotation, novel_like, priority, count(*) AS n FROM (" + CLUSTERS + ") GROUP BY 1, 2, 3", False)
add("st_u1_union", lambda s, d: X.windows(s, d).where("scale = 'small'").unionByName(X.windows(s, d).where("scale = 'large'")).groupBy("scale").count().withColumnRenamed("count", "n"), "SELECT scale, count(*) AS n FROM fx_windows WHERE scale <> 'medium' GROUP BY 1")
add("st_u2_first_of_key", lambda s, d: X.table(s, d, "orders").withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r = 1").select("o_custkey", "o_orderkey"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", False)
add("st_i1_set_operations", lambda s, d: X.table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(X.table(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")).exceptAll(X.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))), "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0", False)
FILES = "SELECT CAST({} AS VARCHAR) AS path, sha256(p_name || CASE WHEN p_partkey % {} = 0 THEN 'x' ELSE '' END) AS sha256 FROM part WHERE p_partkey % {} <> 0"
hashes = lambda s, d, change, drop: X.table(s, d, "part").where(F.col("p_partkey") % drop != 0).select(F.col("p_partkey").cast("string").alias("path"), F.sha2(F.concat("p_name", F.when(F.col("p_partkey") % change == 0, "x").otherwise("")), 256).alias("sha256"))
add("st_e1_changed_files", lambda s, d: G.compare_files(hashes(s, d, 10**9, 13), hashes(s, d, 17, 11)), f"WITH a AS ({FILES.format('p_partkey', 10**9, 13)}), b AS ({FILES.format('p_partkey', 17, 11)}) SELECT path, CASE WHEN a.sha256 IS NULL THEN 'added' WHEN b.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.sha256 IS NULL OR b.sha256 IS NULL OR a.sha256 <> b.sha256", False)
add("gt04_hash_verification", lambda s, d: hashes(s, d, 10**9, 13).join(hashes(s, d, 17, 11), ["path", "sha256"], "left_anti").agg(F.count("*").alias("bad")), f"WITH a AS ({FILES.format('p_partkey', 10**9, 13)}), b AS ({FILES.format('p_partkey', 17, 11)}) SELECT count(*) AS bad FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND b.sha256 = a.sha256)", False)
add("snk03_table_checksum", lambda s, d: G.table_checksum(X.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")), "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws(chr(1), coalesce(CAST(o_custkey AS VARCHAR), chr(0)), coalesce(CAST(o_orderkey AS VARCHAR), chr(0)), coalesce(o_orderstatus, chr(0)))), 1, 12) AS BIGINT)) AS VARCHAR) AS checksum FROM orders", False)
add("val02_alignment", lambda s, d: X.cells(s, d).where("replicate = 'rep1'").select("chrom", "w_start").distinct().join(X.cells(s, d).where("replicate = 'rep2'").select("chrom", "w_start").distinct().withColumn("b", F.lit(1)), ["chrom", "w_start"], "full").agg(F.count("*").alias("windows"), F.count_if(F.col("b").isNull()).alias("only_rep1")), "SELECT count(*) AS windows, count(*) FILTER (b.chrom IS NULL) AS only_rep1 FROM (SELECT DISTINCT chrom, w_start FROM fx_cells WHERE replicate = 'rep1') a FULL JOIN (SELECT DISTINCT chrom, w_start FROM fx_cells WHERE replicate = 'rep2') b USING (chrom, w_start)")


def pool_validation(s, d):
    """The score table with planted faults: every ninth row twice, every 13th with a wrong maximum, every 17th with an impossible p."""
    c = settled(calibrated(s, d))
    w = F.expr("w_start div 800")
    c = c.unionByName(c.where(w % 9 == 0)).withColumns({"or_score": F.when(w % 13 == 0, F.col("or_score") + 1).otherwise(F.col("or_score")), "rep1_density": F.when(w % 17 == 0, 1.5).otherwise(F.col("rep1_density"))})
    return c.agg(schema.unique(c, ["chrom", "w_start"]).alias("unique_ids"), F.count_if(F.col("or_score") != F.greatest("density_score", "shape_score")).alias("wrong_or"), F.count_if(~F.col("rep1_density").between(1e-12, 1)).alias("bad_p"))


add("val03_pool_validation", pool_validation, ", k AS (SELECT w_start // 800 AS w FROM fx_marked), t AS (SELECT w FROM k UNION ALL SELECT w FROM k WHERE w % 9 = 0) SELECT count(*) FILTER (w % 9 = 0) = 0 AS unique_ids, count(*) FILTER (w % 13 = 0) AS wrong_or, count(*) FILTER (w % 17 = 0) AS bad_p FROM t")
add("val07_key_alignment", lambda s, d: X.table(s, d, "labels").join(X.table(s, d, "documents"), "doc_id", "left_anti").agg(F.count("*").alias("missing")), "SELECT count(*) AS missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", False)


def overlap_faults(s, d):
    """Overlaps of background windows with structures: none, and those of the windows that are moved half a window on."""
    free = settled(I.without_overlap(X.medium(s, d), X.structures(s, d), ["chrom", "w_start"], X.BUCKET).select("chrom", "w_start", "w_end"))
    moved = free.select("chrom", (F.col("w_start") + 3200).alias("w_start"), (F.col("w_end") + 3200).alias("w_end"))
    count = lambda x, n: I.range_join(x, X.structures(s, d), X.BUCKET).agg(F.count("*").alias("overlaps")).select(F.lit(n).alias("table"), "overlaps")
    return count(free, "background").unionByName(count(moved, "moved"))


add("val08_zero_overlap", overlap_faults, f""", b AS (SELECT * FROM fx_medium w WHERE NOT EXISTS (SELECT 1 FROM fx_structures t WHERE {HIT}))
SELECT 'background' AS "table", count(*) AS overlaps FROM b w JOIN fx_structures t ON {HIT} UNION ALL SELECT 'moved', count(*) FROM (SELECT chrom, w_start + 3200 AS w_start, w_end + 3200 AS w_end FROM b) w JOIN fx_structures t ON {HIT}""")
add("pf01_record_selection", lambda s, d: X.marked(s, d).where("split = 'train' AND rep1_density > 0 AND rep2_density > 0").select("chrom", "w_start"), "SELECT chrom, w_start FROM fx_marked WHERE split = 'train' AND rep1_density > 0 AND rep2_density > 0")
add("pf03_signed_log", lambda s, d: z_scores(s, d).select("chrom", "w_start", "branch", (F.signum("z") * F.log1p(F.abs("z"))).alias("v")), Z + " SELECT chrom, w_start, branch, round(sign(z) * ln(1 + abs(z)), 6) AS v FROM z")
add("sf06_booleans", lambda s, d: X.table(s, d, "orders").select("o_orderkey", schema.lenient_boolean(F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit(" yes "), F.lit("no"), F.lit("")), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("lenient"), schema.three_state_boolean(F.element_at(F.array(F.lit("true"), F.lit("0"), F.lit("nan")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("three_state"), schema.strict_boolean(F.element_at(F.array(F.lit("True"), F.lit("false")), (F.col("o_orderkey") % 2 + 1).cast("int"))).alias("strict")), "SELECT o_orderkey, o_orderkey % 5 <= 2 AS lenient, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS three_state, o_orderkey % 2 = 0 AS strict FROM orders", False)
add("sf11_dominant_branch", lambda s, d: calibrated(s, d).groupBy(ids.dominant_branch(F.col("density_score"), F.col("shape_score")).alias("branch")).agg(F.count("*").alias("n")), CAL + " SELECT CASE WHEN density_score >= 1.3010299956639813 AND shape_score >= 1.3010299956639813 THEN 'mixed' WHEN density_score >= shape_score THEN 'density' ELSE 'shape' END AS branch, count(*) AS n FROM c GROUP BY 1")
add("sf12_scale_lookup", lambda s, d: X.windows(s, d).select("scale").distinct().select("scale", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, w, _ in K.SCALES for x in (n, w)]), F.col("scale")), F.raise_error(F.lit("unknown scale")).cast("int")).alias("window_bp")), "SELECT DISTINCT scale, window_bp FROM fx_windows")
add("sf13_name_classification", lambda s, d: X.table(s, d, "part").select("p_partkey", A.classify(F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (".cool", ".BED", ".tar.gz", ".fa", ".txt")]), (F.col("p_partkey") % 5 + 1).cast("int")))).alias("kind")), "SELECT p_partkey, (['contact_map', 'table', 'archive', 'reference', 'other'])[p_partkey % 5 + 1] AS kind FROM part", False)
add("sf14_flag_list", lambda s, d: X.marked(s, d).select("chrom", "w_start", F.concat_ws(";", F.when(F.col("known"), "known"), F.when(F.col("rep1_density") > 1, "dense1"), F.when(F.col("rep2_density") > 1, "dense2")).alias("flags")), "SELECT chrom, w_start, concat_ws(';', CASE WHEN known THEN 'known' END, CASE WHEN rep1_density > 1 THEN 'dense1' END, CASE WHEN rep2_density > 1 THEN 'dense2' END) AS flags FROM fx_marked")
add("src08_header_names", lambda s, d: X.table(s, d, "part").select("p_partkey", schema.normalized_name(F.concat_ws(" ", "p_brand", F.lit("(Start)"), "p_name")).alias("name")), "SELECT p_partkey, regexp_replace(lower(concat_ws(' ', p_brand, '(Start)', p_name)), '[^\\p{L}\\p{N}_]', '', 'g') AS name FROM part", False)
#: A given center is a mismatch wherever it is: the SQL counts every one that is 7 bp off, which numpy.isclose's share of the position passes from 700,000 bp on.
WHOLE = (1e-8, 0.0)
add("src09_standardize", lambda s, d: A.standardize(X.structures(s, d).select(F.col("chrom").alias("Chrom"), F.col("s_start").cast("string").alias("chromStart"), F.col("s_end").cast("string").alias("Stop"), (F.col("s_center") + F.when(F.col("structure") % 2 == 0, 7).otherwise(0)).cast("string").alias("Midpoint")), F.lit("X"), WHOLE).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("length_bp").alias("bp"), F.count_if("center_mismatch").alias("mismatches"), F.sum("center").alias("centers")), "SELECT chrom, count(*) AS n, CAST(sum(s_end - s_start) AS BIGINT) AS bp, count(*) FILTER (structure % 2 = 0) AS mismatches, round(sum((s_start + s_end) / 2), 6) AS centers FROM fx_structures GROUP BY 1")
# vectors and models
emb = lambda s, d: X.table(s, d, "embeddings")
vec_pairs = lambda s, d: emb(s, d).where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("pair"), F.col("embedding").alias("a")).join(emb(s, d).where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), F.col("embedding").alias("b")), "pair")
VP = "WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.pair, a.e AS a, b.e AS b FROM v a JOIN v b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)"
add("vx01_cosine", lambda s, d: vec_pairs(s, d).select("pair", V.cosine(F.col("a"), F.col("b")).alias("cosine")), VP + " SELECT pair, round(list_cosine_similarity(a, b), 6) AS cosine FROM p", False)
add("vx02_euclidean", lambda s, d: vec_pairs(s, d).select("pair", V.euclidean(F.col("a"), F.col("b")).alias("distance")), VP + " SELECT pair, round(list_distance(a, b), 6) AS distance FROM p", False)
add("vx03_average_and_fuse", lambda s, d: vec_pairs(s, d).select("pair", V.fuse(V.average(F.col("a"), F.col("b")), V.two_dimensions(F.col("b"))).alias("f")).select("pair", F.size("f").alias("n"), F.aggregate("f", F.lit(0.0), lambda x, y: x + y).alias("total")), VP + " SELECT pair, CAST(len(a) + 2 AS BIGINT) AS n, round((list_sum(a) + list_sum(b)) / 2 + b[1] + b[2], 6) AS total FROM p", False)
add("vx04_two_dimensions", lambda s, d: emb(s, d).select("vec_id", V.two_dimensions(F.slice("embedding", 1, 1)).alias("v")).select("vec_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, 0.0::DOUBLE AS y FROM embeddings", False)
E1 = "WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
add("ml06_scaler", lambda s, d: ml.scaler(emb(s, d), "embedding"), E1 + " SELECT k, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS std FROM e GROUP BY 1", False)
CENT = E1 + ", c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.label, e.vec_id, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM e JOIN c USING (label, k) GROUP BY 1, 2)"
add("ml10_medoids", lambda s, d: ml.medoids(emb(s, d), "embedding", "vec_id", "label"), CENT + " SELECT CAST(label AS BIGINT) AS label, arg_min(vec_id, (d, vec_id)) AS medoid, round(min(d), 6) AS distance FROM d GROUP BY 1", False)
add("ml10_centroids", lambda s, d: ml.centroids(emb(s, d), "embedding", "label").select("label", F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x).alias("square")), E1 + " SELECT CAST(label AS BIGINT) AS label, round(sum(m * m), 6) AS square FROM (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1", False)
add("jn13_nearest_known", lambda s, d: ml.nearest_known(emb(s, d).where("label >= 6").select("vec_id", "embedding"), emb(s, d).where("label <= 2").select("vec_id", "embedding", F.col("label").alias("class")), "vec_id", "embedding"), "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id AS candidate, b.vec_id AS n, b.label AS c, round(list_distance(a.e, b.e), 9) AS d FROM v a CROSS JOIN v b WHERE a.label >= 6 AND b.label <= 2) SELECT candidate, arg_min(n, (d, n)) AS nearest, CAST(arg_min(c, (d, n)) AS BIGINT) AS nearest_class, round(min(d), 6) AS distance FROM d GROUP BY 1", False)
add("wf10_cumulative_variance", lambda s, d: ml.scaler(emb(s, d), "embedding").select("k", F.pow("std", F.lit(2.0)).alias("v")).withColumn("share", F.sum("v").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) / F.sum("v").over(W.partitionBy())).select("k", "share"), E1 + " SELECT k, round(sum(v) OVER (ORDER BY k) / sum(v) OVER (), 6) AS share FROM (SELECT k, var_pop(x) AS v FROM e GROUP BY 1)", False)
add("ml08_pca95", lambda s, d: ml.pca95(emb(s, d), "embedding")[0].select("vec_id", F.size("pca").alias("components")))
add("ml04_reconstruction_error", lambda s, d: ml.linear_reconstruction_error(emb(s, d).where("label BETWEEN 3 AND 5"), emb(s, d), "embedding", 0.8).select("vec_id", "error"))
add("ml07_probe", lambda s, d: ml.probe(*[emb(s, d).where(f"vec_id % 5 {op} 0").select("vec_id", "embedding", F.when(F.col("label") <= 2, 1).otherwise(0).alias("y")) for op in ("<>", "=")], "embedding", "y").select("vec_id", "y", "probability"))


def random_recall(s, d):
    """Share of structures that windows drawn by hash overlap: mean and percentiles over the repeats, by fraction."""
    draws, t = B.random_windows(X.medium(s, d), [0.05, 0.1, 0.2], 20, 20260920), X.structures(s, d)
    hit = I.range_join(draws, t, X.BUCKET).groupBy("setting", "repeat").agg(F.count_distinct("structure").alias("hits"))
    every = draws.select("setting", "repeat").distinct().join(hit, ["setting", "repeat"], "left").crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))  # one row
    return B.summary(every.select("setting", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall")), "recall")


add(
    "rn01_random_windows",
    random_recall,
    f""", dr AS (SELECT f AS setting, r AS repeat, chrom, w_start, w_end, row_number() OVER (PARTITION BY f, r ORDER BY sha256('20260920|' || printf('%.4f', f) || '|' || r || '|' || chrom || '|' || w_start), chrom, w_start) AS k, count(*) OVER (PARTITION BY f, r) AS n
  FROM fx_medium, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2]) AS f), (SELECT unnest(range(20)) AS r)),
se AS (SELECT * FROM dr WHERE k <= greatest(1, ceil(round(n * setting, 9)))),
hi AS (SELECT w.setting, w.repeat, count(DISTINCT t.structure) / (SELECT count(*) FROM fx_structures)::DOUBLE AS recall FROM se w LEFT JOIN fx_structures t ON {HIT} GROUP BY 1, 2)
SELECT setting, round(avg(recall), 6) AS mean, round(stddev_pop(recall), 6) AS std, round(quantile_cont(recall, 0.025), 6) AS q025, round(quantile_cont(recall, 0.975), 6) AS q975 FROM hi GROUP BY 1""",
)
add("rn02_coverage_matched", lambda s, d: B.coverage_matched(s, X.medium(s, d), [40000.0, 80000.0], 10, 20260920).drop("chosen"))
add("rn03_region_matched", lambda s, d: B.region_matched(X.structures(s, d).select(F.col("structure").cast("string").alias("region_id"), "chrom", F.col("s_start").alias("r_start"), F.col("s_end").alias("r_end")), X.sizes(s, d), 5, 7), """, g AS (SELECT r.r AS repeat, CAST(structure AS VARCHAR) AS region_id, chrom, s_end - s_start AS n, size_bp - (s_end - s_start) + 1 AS room, CAST('0x' || substr(sha256('7|' || r.r || '|' || structure), 1, 15) AS BIGINT) AS h FROM fx_structures JOIN fx_sizes USING (chrom), (SELECT unnest(range(5)) AS r) r)
SELECT repeat, region_id, chrom, h % greatest(room, 1) AS r_start, h % greatest(room, 1) + n AS r_end FROM g""")
add("rn05_seeded_subset", lambda s, d: X.medium(s, d).orderBy(ids.tie_key(5, F.concat_ws("|", "chrom", "w_start"))).limit(25).select("chrom", "w_start"), "SELECT chrom, w_start FROM fx_medium ORDER BY sha256('5|' || chrom || '|' || w_start) LIMIT 25")


def map_table(s, d):
    """Points of a map: known references, background references and candidates, by label."""
    kind = F.when(F.col("label") <= 2, "known").when(F.col("label") <= 5, "background").otherwise("candidate")
    return emb(s, d).select(kind.alias("kind"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


add(
    "ag24_map_diagnostics",
    lambda s, d: stats.map_diagnostics(map_table(s, d)),
    """WITH p AS (SELECT CASE WHEN label <= 2 THEN 'known' WHEN label <= 5 THEN 'background' ELSE 'candidate' END AS kind, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT kind, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), o AS (SELECT avg(x) AS ox, avg(y) AS oy FROM p),
s AS (SELECT kind, any_value(cx) AS cx, any_value(cy) AS cy, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS spread FROM p JOIN c USING (kind) GROUP BY 1)
SELECT round(sqrt((k.cx - b.cx) ** 2 + (k.cy - b.cy) ** 2) / greatest((k.spread + b.spread) / 2, 1e-12), 6) AS separation_over_spread, (SELECT count(DISTINCT (x >= ox, y >= oy)) FROM p, o WHERE kind = 'candidate') AS occupied_quadrants, (SELECT count(*) FROM p WHERE kind = 'candidate') AS candidates FROM s k, s b WHERE k.kind = 'known' AND b.kind = 'background'""",
    False,
)