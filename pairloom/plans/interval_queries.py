"""Queries of interval algebra, joins, ordered analytics, ranking and selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions import ids
from pairloom.operators import intervals as I
from pairloom.operators import selection as S
from pairloom.operators import splits as P
from pairloom.operators import stats
from pairloom.plans import fixtures as X

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, fixtures: bool = True, dense: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: X.tidy(query(spark, sf_dir))
    if sql:
        ORACLES[name] = (X.DENSE if dense else X.SQL if fixtures else "") + sql


HIT = "w.chrom = t.chrom AND w.w_start < t.s_end AND w.w_end > t.s_start"
overlaps = lambda s, d: I.range_join(X.windows(s, d), X.structures(s, d), X.BUCKET)
WIN = ["scale", "chrom", "w_start"]
add("jn07_overlap_join", lambda s, d: overlaps(s, d).select(*WIN, "structure"), f"SELECT w.scale, w.chrom, w.w_start, t.structure FROM fx_windows w JOIN fx_structures t ON {HIT}")
add("jn06_center_join", lambda s, d: I.center_join(X.windows(s, d).drop("center"), X.structures(s, d), X.BUCKET, "s_center").select(*WIN, "structure"), "SELECT w.scale, w.chrom, w.w_start, t.structure FROM fx_windows w JOIN fx_structures t ON w.chrom = t.chrom AND w.w_start <= t.s_center AND t.s_center < w.w_end")
add("jn08_background_windows", lambda s, d: I.without_overlap(X.windows(s, d), X.structures(s, d), WIN, X.BUCKET).select(*WIN), f"SELECT scale, chrom, w_start FROM fx_windows w WHERE NOT EXISTS (SELECT 1 FROM fx_structures t WHERE {HIT})")
add("jn09_semi_join", lambda s, d: I.with_overlap(X.windows(s, d), X.structures(s, d), WIN, X.BUCKET).groupBy("scale").agg(F.count("*").alias("n")), f"SELECT scale, count(*) AS n FROM fx_windows w WHERE EXISTS (SELECT 1 FROM fx_structures t WHERE {HIT}) GROUP BY 1")
EXCLUDED = "greatest(0, CAST(floor(s_center - 6400) AS BIGINT)) AS s_start, CAST(ceil(s_center + 6400) AS BIGINT) AS s_end"


def exclusion(s, d):
    """Intervals around centers, half a window and a margin wide, from 0 on."""
    return X.structures(s, d).select("structure", "chrom", F.greatest(F.lit(0).cast("long"), F.floor(F.col("s_center") - 6400)).alias("s_start"), F.ceil(F.col("s_center") + 6400).alias("s_end"))


add("sf09_exclusion_bounds", exclusion, f"SELECT structure, chrom, {EXCLUDED} FROM fx_structures")
add("jn08_strict_background", lambda s, d: I.without_overlap(X.medium(s, d), exclusion(s, d), ["chrom", "w_start"], X.BUCKET).select("chrom", "w_start"), f", e AS (SELECT chrom, {EXCLUDED} FROM fx_structures) SELECT chrom, w_start FROM fx_medium w WHERE NOT EXISTS (SELECT 1 FROM e t WHERE {HIT})")
add("jn05_block_join", lambda s, d: P.in_block(X.medium(s, d), X.BLOCK).groupBy("chrom", "block").agg(F.count("*").alias("n")), "SELECT chrom, w_start // 12800 AS block, count(*) AS n FROM fx_medium WHERE w_end <= (w_start // 12800 + 1) * 12800 GROUP BY 1, 2")
add("pf04_inside_block", lambda s, d: P.in_block(X.marked(s, d).where("NOT known").drop("block"), X.BLOCK).select("chrom", "w_start"), "SELECT chrom, w_start FROM fx_marked WHERE NOT known AND w_end <= (block + 1) * 12800")
LEFT = "SELECT {} FROM fx_structures t LEFT JOIN fx_scores s ON s.chrom = t.chrom AND s.w_start = CAST(floor(t.s_center / 800) AS BIGINT) * 800"
at_structure = lambda s, d: X.structures(s, d).withColumn("w_start", F.expr("CAST(floor(s_center / 800) AS BIGINT) * 800")).join(X.scores(s, d), ["chrom", "w_start"], "left")
add("jn01_many_to_one", lambda s, d: at_structure(s, d).select("structure", "w_end", "rep1_density"), LEFT.format("t.structure, s.w_end, round(s.rep1_density, 6) AS rep1_density"))


def one_to_one(s, d):
    from pairloom.operators import contacts as K

    a = X.oe(s, d).groupBy("chrom", "w_start", "replicate").agg(F.sum("oe").alias("total"))
    b = K.zero_axis(X.cells(s, d), ["chrom", "w_start", "replicate"], F.col("n"))
    return a.join(b, ["chrom", "w_start", "replicate"], "left").groupBy("replicate").agg(F.count("*").alias("n"), F.count_if(F.col("zero_axes").isNull()).alias("missing"), F.sum("zero_axes").alias("zero_axes"), F.sum("total").alias("total"))


add("jn02_one_to_one", one_to_one, """, a AS (SELECT chrom, w_start, replicate, sum(oe) AS total FROM fx_oe GROUP BY 1, 2, 3),
b AS (SELECT chrom, w_start, replicate, 64 - count(DISTINCT x) AS z FROM (SELECT chrom, w_start, replicate, unnest([i, j]) AS x FROM fx_cells) GROUP BY 1, 2, 3)
SELECT replicate, count(*) AS n, count(*) FILTER (z IS NULL) AS missing, CAST(sum(z) AS BIGINT) AS zero_axes, round(sum(total), 6) AS total FROM a LEFT JOIN b USING (chrom, w_start, replicate) GROUP BY 1""")
add("jn03_inner_split", lambda s, d: X.marked(s, d).join(s.createDataFrame([("train", 1), ("cal", 2)], "split string, part int"), "split").groupBy("split", "part").agg(F.count("*").alias("n"), F.avg("rep1_density").alias("mean")), "SELECT split, CASE split WHEN 'train' THEN 1 ELSE 2 END AS part, count(*) AS n, round(avg(rep1_density), 6) AS mean FROM fx_marked WHERE split IN ('train', 'cal') GROUP BY 1, 2")
add("jn10_map_lookup", lambda s, d: X.medium(s, d).select("w_start", "chrom", F.coalesce(F.element_at(F.create_map(F.lit("A"), F.lit(1), F.lit("N"), F.lit(2)), F.col("chrom")), F.lit(0)).alias("code")), "SELECT w_start, chrom, CAST(CASE chrom WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS BIGINT) AS code FROM fx_medium")
best_first = lambda: [F.desc("score"), F.col("chrom"), F.col("w_start")]
falling = lambda: -F.col("score")
scored = lambda s, d: X.scores(s, d).select("chrom", "w_start", "w_end", "center", F.round((F.col("rep1_density") + F.col("rep2_density")) / 2, 9).alias("score"))
RANKED = ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chrom, w_start) AS rank, count(*) OVER () AS n FROM (SELECT chrom, w_start, w_end, center, round((rep1_density + rep2_density) / 2, 9) AS score FROM fx_scores))"
add("wf01_rank_percentile", lambda s, d: S.ranked(scored(s, d), best_first(), by=falling()).select("chrom", "w_start", "rank", "percentile"), RANKED + " SELECT chrom, w_start, rank, round(1 - (rank - 1) / n, 6) AS percentile FROM r")
add("tk01_multi_key_sort", lambda s, d: S.ranked(scored(s, d), [F.desc("score"), F.asc("w_end"), F.desc("chrom")], by=falling()).where("rank <= 50").select("chrom", "w_start", "rank"), "SELECT chrom, w_start, rank FROM (SELECT *, row_number() OVER (ORDER BY round((rep1_density + rep2_density) / 2, 9) DESC, w_end, chrom DESC) AS rank FROM fx_scores) WHERE rank <= 50")
add("tk02_hash_tie_break", lambda s, d: S.ranked(X.medium(s, d).withColumn("block", F.expr("w_start div 12800")), [F.col("block"), ids.tie_key(20260920, F.concat_ws("|", "chrom", "w_start"))], ["chrom"]).select("chrom", "w_start", "rank"), "SELECT chrom, w_start, row_number() OVER (PARTITION BY chrom ORDER BY w_start // 12800, sha256('20260920|' || chrom || '|' || w_start)) AS rank FROM fx_medium")
add("tk03_top_fraction", lambda s, d: S.top_fraction(scored(s, d), best_first(), 0.1, by=falling()).select("chrom", "w_start"), RANKED + " SELECT chrom, w_start FROM r WHERE rank <= greatest(1, ceil(round(n * 0.1, 9)))")
add("tk04_nlargest", lambda s, d: scored(s, d).orderBy(*best_first()).limit(20).select("chrom", "w_start", "score"), RANKED + " SELECT chrom, w_start, round(score, 6) AS score FROM r WHERE rank <= 20")
add("wf02_islands", lambda s, d: I.islands(X.structures(s, d), "s_start", "s_end", ["structure"], ["chrom"]).select("structure", "chrom", "island"), """, a AS (SELECT *, max(s_end) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_structures)
SELECT structure, chrom, CAST(sum(CASE WHEN m IS NULL OR s_start >= m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM a""")
GAPS = """, a AS (SELECT *, center - lag(center) OVER (PARTITION BY chrom ORDER BY center, w_start) AS gap FROM (SELECT * FROM r WHERE rank <= greatest(1, ceil(round(n * 0.1, 9))))),
g AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 3200 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY center, w_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM a)"""


def merged(s, d):
    """Top windows joined into regions by gaps of centers; the peak is the best ranked member."""
    top = S.top_fraction(scored(s, d), best_first(), 0.1, by=falling(), rank="rank")
    g = I.gap_islands(top, "center", 3200, ["w_start"], ["chrom"]).groupBy("chrom", "island")
    return g.agg(F.min("w_start").alias("r_start"), F.max("w_end").alias("r_end"), F.rint(F.avg("center")).cast("long").alias("center"), F.count("*").alias("members"), F.min_by("w_start", "rank").alias("peak"), F.min("rank").alias("peak_rank"))


add("wf03_gap_islands", lambda s, d: I.gap_islands(S.top_fraction(scored(s, d), best_first(), 0.1, by=falling()), "center", 3200, ["w_start"], ["chrom"]).select("chrom", "w_start", "island"), RANKED + GAPS + " SELECT chrom, w_start, island FROM g")
add("iv05_center_gap_regions", merged, RANKED + GAPS + " SELECT chrom, island, min(w_start) AS r_start, max(w_end) AS r_end, CAST(round_even(avg(center), 0) AS BIGINT) AS center, count(*) AS members, arg_min(w_start, rank) AS peak, min(rank) AS peak_rank FROM g GROUP BY 1, 2")
ISLAND = """, i AS (SELECT chrom, min(s_start) AS a, max(s_end) AS b, count(*) AS n, string_agg(DISTINCT type, ';' ORDER BY type) AS types, bool_or(type = 'CHIN') AS has_chin, arg_min(structure, (s_start, structure)) AS first FROM (
SELECT *, sum(CASE WHEN m IS NULL OR s_start >= m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, max(s_end) OVER (PARTITION BY chrom ORDER BY s_start, s_end, structure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_structures)) GROUP BY chrom, island)"""
grouped = lambda s, d: I.islands(X.structures(s, d), "s_start", "s_end", ["structure"], ["chrom"]).groupBy("chrom", "island")
add("iv04_merge_overlaps", lambda s, d: grouped(s, d).agg(F.min("s_start").alias("r_start"), F.max("s_end").alias("r_end"), F.count("*").alias("members"), F.concat_ws(";", F.array_sort(F.collect_set("type"))).alias("types"), F.bool_or(F.col("type") == "CHIN").alias("has_chin"), F.min_by("structure", F.struct("s_start", "structure")).alias("representative")).drop("island"), ISLAND + " SELECT chrom, a AS r_start, b AS r_end, n AS members, types, has_chin, first AS representative FROM i")
add("iv06_union_coverage", lambda s, d: I.union_bp(X.structures(s, d), "s_start", "s_end", ["chrom"]), ISLAND + " SELECT chrom, CAST(sum(b - a) AS BIGINT) AS union_bp FROM i GROUP BY 1")
ranked_structures = lambda s, d: X.structures(s, d).withColumn("rank", F.row_number().over(W.partitionBy("chrom").orderBy(F.desc(F.col("s_end") - F.col("s_start")), "structure")))
add("iv07_cumulative_union", lambda s, d: I.cumulative_union(ranked_structures(s, d), "s_start", "s_end", "rank", ["chrom"], X.BUCKET), """, q AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s_end - s_start DESC, structure) AS rank FROM fx_structures),
p AS (SELECT chrom, edge, lead(edge) OVER (PARTITION BY chrom ORDER BY edge) AS b FROM (SELECT chrom, s_start AS edge FROM q UNION SELECT chrom, s_end FROM q)),
m AS (SELECT p.chrom, p.edge, p.b, min(rank) AS rank FROM p JOIN q ON q.chrom = p.chrom AND q.s_start < p.b AND q.s_end > p.edge GROUP BY 1, 2, 3)
SELECT q.chrom, q.rank, CAST(coalesce((SELECT sum(b - edge) FROM m WHERE m.chrom = q.chrom AND m.rank <= q.rank), 0) AS BIGINT) AS cumulative_bp FROM q""")
add(
    "wf05_running_coverage",
    lambda s, d: I.cumulative_union(S.ranked(scored(s, d), best_first(), ["chrom"], by=falling()), "w_start", "w_end", "rank", ["chrom"], X.BUCKET, wide=True).drop("before_bp"),
    """, q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY round((rep1_density + rep2_density) / 2, 9) DESC, w_start) AS rank FROM fx_scores),
p AS (SELECT chrom, edge, lead(edge) OVER (PARTITION BY chrom ORDER BY edge) AS b FROM (SELECT chrom, w_start AS edge FROM q UNION SELECT chrom, w_end FROM q)),
m AS (SELECT p.chrom, p.edge, p.b, min(rank) AS rank FROM p JOIN q ON q.chrom = p.chrom AND q.w_start < p.b AND q.w_end > p.edge GROUP BY 1, 2, 3),
a AS (SELECT chrom, rank, sum(b - edge) AS added FROM m GROUP BY 1, 2)
SELECT q.chrom, q.rank, CAST(coalesce(sum(added) OVER (PARTITION BY q.chrom ORDER BY q.rank), 0) AS BIGINT) AS cumulative_bp FROM q LEFT JOIN a ON a.chrom = q.chrom AND a.rank = q.rank""",
)
add("iv09_pair_counts", lambda s, d: I.overlap_pairs(X.medium(s, d), X.structures(s, d), ("w_start", "w_end"), ("s_start", "s_end")), f"SELECT chrom, coalesce(n, 0) AS pairs FROM (SELECT DISTINCT chrom FROM (SELECT chrom FROM fx_medium UNION SELECT chrom FROM fx_structures)) LEFT JOIN (SELECT w.chrom, count(*) AS n FROM fx_medium w JOIN fx_structures t ON {HIT} GROUP BY 1) USING (chrom)")
add("iv08_any_overlap", lambda s, d: I.islands(X.structures(s, d), "s_start", "s_end", [], ["chrom"]).groupBy("chrom").agg((F.count("*") > F.max("island")).alias("any_overlap")), ISLAND + " SELECT chrom, sum(n) > count(*) AS any_overlap FROM i GROUP BY 1")


def annotated(s, d):
    """Windows with flags and sorted classes of the structures they overlap or hold the center of."""
    pair = overlaps(s, d).where("scale = 'medium'").withColumn("inside", (F.col("w_start") <= F.col("s_center")) & (F.col("s_center") < F.col("w_end")))
    hit = pair.groupBy("chrom", "w_start").agg(F.concat_ws(";", F.array_sort(F.collect_set("type"))).alias("types"), F.concat_ws(";", F.array_sort(F.collect_set(F.when(F.col("inside"), F.col("structure"))))).alias("center_ids"), F.bool_or("inside").alias("center_overlap"))
    return X.medium(s, d).select("chrom", "w_start").join(hit, ["chrom", "w_start"], "left").select("chrom", "w_start", F.coalesce("types", F.lit("")).alias("types"), F.coalesce("center_ids", F.lit("")).alias("center_ids"), F.col("types").isNotNull().alias("interval_overlap"), F.coalesce("center_overlap", F.lit(False)).alias("center_overlap"))


ANNOTATED = f"""SELECT w.chrom, w.w_start, coalesce(string_agg(DISTINCT t.type, ';' ORDER BY t.type), '') AS types,
coalesce(array_to_string(list_sort(list(DISTINCT t.structure) FILTER (w.w_start <= t.s_center AND t.s_center < w.w_end)), ';'), '') AS center_ids, count(t.structure) > 0 AS interval_overlap, coalesce(bool_or(w.w_start <= t.s_center AND t.s_center < w.w_end), false) AS center_overlap
FROM fx_medium w LEFT JOIN fx_structures t ON {HIT} GROUP BY 1, 2"""
add("iv03_overlap_annotation", annotated, ANNOTATED)
add("iv02_center_annotation", lambda s, d: annotated(s, d).where("center_overlap").groupBy("chrom").agg(F.count("*").alias("n")), f"SELECT chrom, count(*) AS n FROM ({ORACLES['iv03_overlap_annotation']}) WHERE center_overlap GROUP BY 1", False)
add("ag12_sorted_distinct", lambda s, d: overlaps(s, d).groupBy("structure").agg(F.concat_ws(";", F.array_sort(F.collect_set("scale"))).alias("scales")), f"SELECT t.structure, string_agg(DISTINCT w.scale, ';' ORDER BY w.scale) AS scales FROM fx_windows w JOIN fx_structures t ON {HIT} GROUP BY 1")
add("jn11_best_overlap", lambda s, d: I.best_overlap(X.structures(s, d), S.ranked(scored(s, d), best_first(), by=falling()), ["structure"], F.col("rank"), X.BUCKET, keep=["w_start"]), RANKED + f" SELECT t.structure, min(w.rank) AS best_rank, arg_min(w.w_start, w.rank) AS w_start FROM fx_structures t JOIN r w ON {HIT} GROUP BY 1")
add("jn12_nearest_center", lambda s, d: I.nearest(X.structures(s, d), X.medium(s, d), "s_center", "center").select("structure", "nearest_center", "center_distance"), "SELECT t.structure, CAST(arg_min(w.center, (abs(w.center - t.s_center), w.center)) AS DOUBLE) AS nearest_center, min(abs(w.center - t.s_center)) AS center_distance FROM fx_structures t JOIN fx_medium w ON w.chrom = t.chrom GROUP BY 1")
split_rows = lambda s, d: X.marked(s, d).where("split IN ('train', 'val', 'cal')")
LEAK = "SELECT a.split AS left_split, b.split AS right_split, count(*) AS pairs FROM fx_marked a JOIN fx_marked b ON a.chrom = b.chrom AND a.split < b.split AND a.w_start < b.w_end AND a.w_end > b.w_start WHERE {} GROUP BY 1, 2"
add("jn15_split_leakage", lambda s, d: P.leakage(split_rows(s, d), X.BUCKET), LEAK.format("a.split <> 'known' AND b.split <> 'known'"))
add("jn15_whole_blocks_do_not_leak", lambda s, d: P.leakage(P.in_block(split_rows(s, d).drop("block"), X.BLOCK), X.BUCKET).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")), "SELECT CAST(count(*) AS BIGINT) AS pairs FROM fx_marked a JOIN fx_marked b ON a.chrom = b.chrom AND a.split < b.split AND a.w_start < b.w_end AND a.w_end > b.w_start WHERE a.split <> 'known' AND b.split <> 'known' AND a.w_end <= (a.block + 1) * 12800 AND b.w_end <= (b.block + 1) * 12800")
add("jn16_known_overlap_audit", lambda s, d: I.range_join(X.marked(s, d), X.structures(s, d), X.BUCKET).groupBy("split").agg(F.count("*").alias("overlaps")), f"SELECT split, count(*) AS overlaps FROM fx_marked w JOIN fx_structures t ON {HIT} GROUP BY 1")
add("jn17_boundary_purge", lambda s, d: P.purge(split_rows(s, d).where("split = 'train'"), split_rows(s, d).where("split = 'val'"), ["chrom", "w_start"], X.BUCKET).select("chrom", "w_start"), "SELECT chrom, w_start FROM fx_marked a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM fx_marked b WHERE b.split = 'val' AND a.chrom = b.chrom AND a.w_start < b.w_end AND a.w_end > b.w_start)")


def replicate_pairs(s, d):
    """Cells of both replicates at the same place; zeros of one side stay."""
    c = X.cells(s, d).where("d > 2")
    a, b = (c.where(F.col("replicate") == r).select("chrom", "w_start", "i", "j", F.col("value").alias(v)) for r, v in (("rep1", "a"), ("rep2", "b")))
    return a.join(b, ["chrom", "w_start", "i", "j"], "full").na.fill(0.0, ["a", "b"])


PAIRS = ", p AS (SELECT chrom, w_start, i, j, coalesce(x.value, 0) AS a, coalesce(y.value, 0) AS b FROM (SELECT * FROM fx_cells WHERE replicate = 'rep1' AND d > 2) x FULL JOIN (SELECT * FROM fx_cells WHERE replicate = 'rep2' AND d > 2) y USING (chrom, w_start, i, j))"
add("jn18_replicate_pairs", lambda s, d: replicate_pairs(s, d).groupBy("chrom", "w_start").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("dot")), PAIRS + " SELECT chrom, w_start, count(*) AS n, round(sum(a * b), 6) AS dot FROM p GROUP BY 1, 2")
add("wf06_step_check", lambda s, d: X.windows(s, d).withColumn("gap", F.lead("w_start").over(W.partitionBy("scale", "chrom").orderBy("w_start")) - F.col("w_start")).groupBy("scale").agg(F.count_if(F.col("gap") != F.col("step_bp")).alias("bad"), F.count("gap").alias("n")), "SELECT scale, count(*) FILTER (gap <> step_bp) AS bad, count(gap) AS n FROM (SELECT *, lead(w_start) OVER (PARTITION BY scale, chrom ORDER BY w_start) - w_start AS gap FROM fx_windows) GROUP BY 1")
add("wf07_neighbour_audit", lambda s, d: X.structures(s, d).withColumns({"before": F.lag("s_end").over(W.partitionBy("chrom").orderBy("s_start", "structure")), "gap": F.col("s_center") - F.lag("s_center").over(W.partitionBy("chrom").orderBy("s_center", "structure"))}).groupBy("chrom").agg(F.count_if(F.col("before") > F.col("s_start")).alias("overlaps"), F.min("gap").alias("min_gap")), "SELECT chrom, count(*) FILTER (before > s_start) AS overlaps, round(min(gap), 6) AS min_gap FROM (SELECT *, lag(s_end) OVER (PARTITION BY chrom ORDER BY s_start, structure) AS before, s_center - lag(s_center) OVER (PARTITION BY chrom ORDER BY s_center, structure) AS gap FROM fx_structures) GROUP BY 1")
add("wf08_first_appearance", lambda s, d: X.structures(s, d).groupBy("type").agg(F.min("structure").alias("first")).withColumn("place", F.row_number().over(W.orderBy("first"))), "SELECT type, first, row_number() OVER (ORDER BY first) AS place FROM (SELECT type, min(structure) AS first FROM fx_structures GROUP BY 1)")
add("wf09_representative", lambda s, d: X.structures(s, d).groupBy("chrom", "type").agg(F.min_by("structure", F.struct((F.col("s_start") - F.col("s_end")).alias("x"), "structure")).alias("representative")), "SELECT chrom, type, arg_min(structure, (s_start - s_end, structure)) AS representative FROM fx_structures GROUP BY 1, 2")
add("wf11_average_ranks", lambda s, d: stats.average_ranks(X.table(s, d, "part").select("p_partkey", "p_size", "p_brand"), ["p_size"], ["p_brand"]).select("p_partkey", "rank_p_size"), "SELECT p_partkey, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE, 6) AS rank_p_size FROM part", False)
medium_peaks = lambda s, d: S.greedy(S.ranked(scored(s, d), best_first(), by=falling()).withColumn("radius", F.lit(3200.0)).withColumn("rank", F.col("rank").cast("long")), ["chrom"], "rank", "center", "radius")
RECURSIVE = RANKED + """, o AS (SELECT chrom, w_start, center, rank, row_number() OVER (PARTITION BY chrom ORDER BY rank) AS k FROM r),
walk AS (SELECT chrom, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT chrom FROM o) UNION ALL
  SELECT w.chrom, o.k, CASE WHEN len(list_filter(w.kept, lambda c: abs(c - o.center) < 3200)) > 0 THEN w.kept ELSE list_append(w.kept, o.center) END FROM walk w JOIN o ON o.chrom = w.chrom AND o.k = w.k + 1),
kept AS (SELECT chrom, unnest(kept) AS center FROM (SELECT chrom, arg_max(kept, k) AS kept FROM walk GROUP BY 1))
SELECT chrom, count(*) AS peaks, CAST(sum(center) AS BIGINT) AS centers FROM kept GROUP BY 1"""
add("tk06_nms_fixed_radius", lambda s, d: medium_peaks(s, d).where("is_peak").groupBy("chrom").agg(F.count("*").alias("peaks"), F.sum("center").alias("centers")), None)
ORACLES["tk06_nms_fixed_radius"] = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1) + RECURSIVE
add("tk06_regions", lambda s, d: S.regions(medium_peaks(s, d), ["chrom"], "rank", "w_start", "w_end", 800))
#: From o(chrom, w_start, w_end, center, radius, rank) to kept(chrom, center, radius, rank), the greedy peaks, and ow, all rows with the best peak near them.
WALK = """, ok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY rank) AS k FROM o),
walk AS (SELECT chrom, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(center BIGINT, radius DOUBLE, rank BIGINT)[]) AS kept FROM (SELECT DISTINCT chrom FROM ok) UNION ALL
  SELECT w.chrom, o.k, CASE WHEN len(list_filter(w.kept, lambda c: abs(c.center - o.center) < greatest(c.radius, o.radius))) > 0 THEN w.kept ELSE list_append(w.kept, {'center': o.center, 'radius': o.radius, 'rank': o.rank}) END
  FROM walk w JOIN ok o ON o.chrom = w.chrom AND o.k = w.k + 1),
kept AS MATERIALIZED (SELECT chrom, unnest(kept, recursive := true) FROM (SELECT chrom, arg_max(kept, k) AS kept FROM walk GROUP BY 1)),
ow AS MATERIALIZED (SELECT ok.*, (SELECT min(p.rank) FROM kept p WHERE p.chrom = ok.chrom AND abs(p.center - ok.center) < greatest(p.radius, ok.radius)) AS owner FROM ok)"""
RECURSIVE_SQL = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1)
ORACLES["tk06_regions"] = RECURSIVE_SQL + RANKED + ", o AS (SELECT chrom, w_start, w_end, center, 3200.0::DOUBLE AS radius, rank FROM r)" + WALK + """,
pt AS (SELECT *, sum(jump) OVER (PARTITION BY chrom, owner ORDER BY w_start ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, coalesce((w_start - lag(w_start) OVER (PARTITION BY chrom, owner ORDER BY w_start) > 800)::INT, 0) AS jump FROM ow)),
own AS (SELECT chrom, owner, part FROM pt WHERE rank = owner)
SELECT pt.chrom, pt.owner AS peak_rank, min(w_start) AS r_start, max(w_end) AS r_end, count(*) AS members FROM pt JOIN own ON own.chrom = pt.chrom AND own.owner = pt.owner AND own.part = pt.part GROUP BY 1, 2"""


def cross(s, d):
    """Peaks among the windows of all scales, by a score from a hash; the radius of a pair is half the larger window."""
    score = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("x"), "scale", "chrom", "w_start"), 256), 1, 3), 16, 10).cast("long")
    r = S.ranked(X.windows(s, d).withColumn("score", score), [F.desc("score"), F.col("scale"), F.col("chrom"), F.col("w_start")], by=falling())
    return S.greedy(r.withColumns({"rank": F.col("rank").cast("long"), "radius": F.col("window_bp") / 2}), ["chrom"], "rank", "center", "radius")


add("tk07_cross_scale_nms", lambda s, d: cross(s, d).groupBy("chrom", "owner").agg(F.count_if("is_peak").alias("peaks"), F.count("*").alias("members"), F.count_if(F.col("scale") == "small").alias("small"), F.count_if(F.col("scale") == "medium").alias("medium"), F.count_if(F.col("scale") == "large").alias("large")))
ORACLES["tk07_cross_scale_nms"] = RECURSIVE_SQL + """, sc AS (SELECT *, CAST('0x' || substr(sha256('x|' || scale || '|' || chrom || '|' || w_start), 1, 3) AS BIGINT) AS score FROM fx_windows),
o AS (SELECT chrom, scale, w_start, w_end, center, window_bp / 2.0::DOUBLE AS radius, row_number() OVER (ORDER BY score DESC, scale, chrom, w_start) AS rank FROM sc)""" + WALK + """
SELECT chrom, owner, count(*) FILTER (rank = owner) AS peaks, count(*) AS members, count(*) FILTER (scale = 'small') AS small, count(*) FILTER (scale = 'medium') AS medium, count(*) FILTER (scale = 'large') AS large FROM ow GROUP BY 1, 2"""
add("tk09_coverage_budget", lambda s, d: S.within_budget(I.cumulative_union(ranked_structures(s, d), "s_start", "s_end", "rank", ["chrom"], X.BUCKET), F.lit(12000), "rank", ["chrom"]).groupBy("chrom").agg(F.max("cumulative_bp").alias("covered_bp"), F.count("*").alias("regions")), "SELECT chrom, max(cumulative_bp) AS covered_bp, count(*) AS regions FROM (SELECT *, coalesce(lag(cumulative_bp) OVER (PARTITION BY chrom ORDER BY rank), 0) AS before FROM (" + ORACLES["iv07_cumulative_union"] + ")) WHERE before < 12000 GROUP BY 1", False)
add("tk11_min_gap", lambda s, d: S.min_gap(X.marked(s, d).where("NOT known").select("chrom", "w_start", "center"), ["chrom"], "center", ["w_start"], 4800.0).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("center").alias("centers")), None)
ORACLES["tk11_min_gap"] = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1) + """, o AS MATERIALIZED (SELECT chrom, center FROM fx_marked WHERE NOT known),
walk AS (SELECT chrom, min(center) AS center FROM o GROUP BY 1 UNION ALL SELECT w.chrom, (SELECT min(o.center) FROM o WHERE o.chrom = w.chrom AND o.center >= w.center + 4800) AS center FROM walk w WHERE w.center IS NOT NULL)
SELECT chrom, count(center) AS n, CAST(sum(center) AS BIGINT) AS centers FROM walk GROUP BY 1"""
add("tk12_disjoint", lambda s, d: S.disjoint(X.structures(s, d).select("chrom", "s_start", "s_end"), ["chrom"], "s_start", "s_end").groupBy("chrom").agg(F.count("*").alias("n")), None)
ORACLES["tk12_disjoint"] = X.SQL.replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1) + """, walk AS (SELECT chrom, min(s_end) AS edge FROM fx_structures GROUP BY 1 UNION ALL SELECT w.chrom, (SELECT min(o.s_end) FROM fx_structures o WHERE o.chrom = w.chrom AND o.s_start >= w.edge) FROM walk w WHERE w.edge IS NOT NULL)
SELECT chrom, count(edge) AS n FROM walk GROUP BY 1"""
add("tk13_examples", lambda s, d: S.ranked(X.table(s, d, "labels").select("doc_id", "quality", "toxic"), [F.col("doc_id")], ["quality", "toxic"]).where("rank <= 3").select("doc_id", "quality", "toxic"), "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) <= 3", False)
add("tk11_thinning", lambda s, d: S.thin(X.structures(s, d).withColumn("name", F.col("structure").cast("string")), 10, "s_center", 7, "name").select("structure"), "SELECT structure FROM (SELECT *, least(coalesce(s_center - lag(s_center) OVER w, 'infinity'::DOUBLE), coalesce(lead(s_center) OVER w - s_center, 'infinity'::DOUBLE)) AS near FROM fx_structures WINDOW w AS (PARTITION BY chrom ORDER BY s_center, CAST(structure AS VARCHAR))) ORDER BY near DESC, sha256('7|' || structure) LIMIT 10")
