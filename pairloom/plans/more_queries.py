"""Queries of validators, evaluations, text and the remaining joins."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import baselines as B
from pairloom.operators import evaluation as E
from pairloom.operators import intervals as I
from pairloom.operators import ml, nets
from pairloom.operators import selection as S
from pairloom.operators import splits as P
from pairloom.operators import stats
from pairloom.operators import status as G
from pairloom.operators.ranges import numbered, settled
from pairloom.plans import fixtures as X
from pairloom.plans import interval_queries as IQ
from pairloom.plans import score_queries as SQ
from pairloom.sources import annotations as A

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, fixtures: bool = True, dense: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: X.tidy(query(spark, sf_dir))
    if sql:
        ORACLES[name] = (X.DENSE if dense else X.SQL if fixtures else "") + sql


def front(df, *names):
    """The named columns first, then the others."""
    return df.select(*names, *[c for c in df.columns if c not in names])


add("pf02_feature_frame", lambda s, d: X.marked(s, d).join(s.createDataFrame([("train",), ("val",)], "split string"), "split").where("rep1_density > 0").select("split", "chrom", "w_start", "rep1_density", "rep1_shape"), "SELECT split, chrom, w_start, round(rep1_density, 6) AS rep1_density, round(rep1_shape, 6) AS rep1_shape FROM fx_marked WHERE split IN ('train', 'val') AND rep1_density > 0")
add("pf05_front_columns", lambda s, d: front(X.structures(s, d), "type", "structure"), "SELECT type, structure, chrom, s_start, s_end, round(s_center, 6) AS s_center FROM fx_structures")
add("pf06_coordinate_table", lambda s, d: SQ.emb(s, d).where("label <= 2").select("vec_id", F.lit("known").alias("source"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")).unionByName(SQ.emb(s, d).where("label >= 6").select("vec_id", F.lit("candidate").alias("source"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))), "SELECT vec_id, CASE WHEN label <= 2 THEN 'known' ELSE 'candidate' END AS source, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings WHERE label <= 2 OR label >= 6", False)
add("val05_structure_validation", lambda s, d: X.structures(s, d).agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("structure")).alias("unique_ids"), F.count_if(F.col("s_end") <= F.col("s_start")).alias("empty_intervals"), F.count_if(~F.col("s_center").between(F.col("s_start"), F.col("s_end"))).alias("centers_outside"), F.count_distinct("type").alias("classes")), "SELECT count(*) AS n, count(*) = count(DISTINCT structure) AS unique_ids, count(*) FILTER (s_end <= s_start) AS empty_intervals, count(*) FILTER (NOT s_center BETWEEN s_start AND s_end) AS centers_outside, count(DISTINCT type) AS classes FROM fx_structures")
add("val06_scan_geometry", lambda s, d: X.windows(s, d).groupBy("scale", "chrom").agg((F.min("w_start") == 0).alias("from_zero"), (F.min(F.col("w_end") - F.col("w_start")) == F.max("window_bp")).alias("width"), (F.count("*") == F.max(F.expr("w_start div step_bp")) + 1).alias("no_gap")), "SELECT scale, chrom, min(w_start) = 0 AS from_zero, min(w_end - w_start) = max(window_bp) AS width, count(*) = max(w_start // step_bp) + 1 AS no_gap FROM fx_windows GROUP BY 1, 2")


def budget_join(s, d):
    """Recall of the detector beside that of random windows, joined on the fraction as a decimal."""
    key = lambda c: F.col(c).cast("decimal(6,4)")
    random = SQ.random_recall(s, d).select(key("setting").alias("k"), F.round("mean", 6).alias("random"), F.round("q975", 6).alias("high"))
    own = SQ.recall_at(s, d).select("fraction", F.round("recall", 6).alias("recall"), key("fraction").alias("k"))
    return own.join(random, "k").select("fraction", "recall", "random", "high", (F.col("recall") > F.col("high")).alias("above"))


add("jn04_budget_join", budget_join)
ORACLES["jn04_budget_join"] = (
    "WITH r AS (" + SQ.ORACLES["ev01_recall_at_fractions"] + "), b AS (" + SQ.ORACLES["rn01_random_windows"] + ") "
    "SELECT fraction, recall, mean AS random, q975 AS high, recall > q975 AS above FROM r JOIN b ON CAST(fraction AS DECIMAL(6, 4)) = CAST(setting AS DECIMAL(6, 4))"
)
add("ev05_legacy_lookup", lambda s, d: SQ.recall_at(s, d).where(F.col("fraction") == 0.2), "SELECT * FROM (" + SQ.ORACLES["ev01_recall_at_fractions"] + ") WHERE fraction = 0.2", False)
add("jn14_reindex", lambda s, d: X.table(s, d, "documents").select("doc_id").join(X.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").agg(F.count("*").alias("n"), F.count("quality").alias("found"), F.count_if(F.col("quality").isNull()).alias("missing")), "SELECT count(*) AS n, count(quality) AS found, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id)", False)


def peak_component(s, d):
    """The island of each chromosome that holds its best window."""
    top = S.top_fraction(IQ.scored(s, d), IQ.best_first(), 0.1, by=IQ.falling(), rank="rank")
    g = I.gap_islands(top, "center", 3200, ["w_start"], ["chrom"])
    best = g.groupBy("chrom").agg(F.min_by("island", "rank").alias("island"))
    return g.join(best, ["chrom", "island"]).select("chrom", "w_start")


add("wf04_peak_component", peak_component, IQ.RANKED + IQ.GAPS + " SELECT g.chrom, g.w_start FROM g JOIN (SELECT chrom, arg_min(island, rank) AS island FROM g GROUP BY 1) b ON b.chrom = g.chrom AND b.island = g.island")


def best_row(s, d):
    """The class with the best accuracy; near ties go to the smaller loss, then to the name."""
    r = SQ.predictions(s, d).groupBy("lang").agg(F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 12).alias("f1"), F.round(F.avg("score"), 9).alias("loss"))
    return S.ranked(r, [F.desc("f1"), F.col("loss"), F.col("lang")]).where("rank = 1").select("lang", "f1")


add("tk05_best_row", best_row, SQ.PRED + " SELECT lang, round(f1, 6) AS f1 FROM (SELECT lang, round(avg((t = p)::INT), 12) AS f1, round(avg(score), 9) AS loss FROM pr GROUP BY 1) ORDER BY f1 DESC, loss, lang LIMIT 1", False)


def ranked_genome(s, d):
    """All structures of the genome in one order, longest first."""
    size = F.col("s_end") - F.col("s_start")
    return S.ranked(X.structures(s, d), [F.desc(size), F.col("structure")], by=-size)


genome = lambda s, d: X.sizes(s, d).agg(F.sum("size_bp").alias("total_bp"))


def coverage_curve(s, d):
    """What the regions ranked over the genome cover within 0 to 40 percent of it."""
    cum = I.cumulative_union(ranked_genome(s, d), "s_start", "s_end", "rank", [], X.BUCKET, wide=True)
    each = cum.crossJoin(F.broadcast(genome(s, d))).withColumn("percent", F.explode(F.sequence(F.lit(0), F.lit(40))))  # one row
    taken = F.col("before_bp") < F.col("percent") * F.col("total_bp") / 100
    return each.groupBy("percent").agg(F.coalesce(F.max(F.when(taken, F.col("cumulative_bp"))), F.lit(0)).alias("covered_bp"), F.count_if(taken).alias("regions"))


#: Intervals q(chrom, a, b, rank) to cu(rank, cumulative_bp, before_bp) over the genome.
CUMULATIVE = """, p AS (SELECT chrom, edge, lead(edge) OVER (PARTITION BY chrom ORDER BY edge) AS b FROM (SELECT chrom, a AS edge FROM q UNION SELECT chrom, b FROM q)),
m AS (SELECT p.chrom, p.edge, p.b, min(rank) AS rank FROM p JOIN q ON q.chrom = p.chrom AND q.a < p.b AND q.b > p.edge GROUP BY 1, 2, 3),
ad AS (SELECT q.rank, coalesce(sum(m.b - m.edge), 0) AS added FROM (SELECT DISTINCT rank FROM q) q LEFT JOIN m ON m.rank = q.rank GROUP BY 1),
cu AS (SELECT rank, CAST(sum(added) OVER (ORDER BY rank) AS BIGINT) AS cumulative_bp, CAST(sum(added) OVER (ORDER BY rank) - added AS BIGINT) AS before_bp FROM ad)"""
add(
    "tk10_coverage_curve",
    coverage_curve,
    ", q AS MATERIALIZED (SELECT chrom, s_start AS a, s_end AS b, row_number() OVER (ORDER BY s_end - s_start DESC, structure) AS rank FROM fx_structures)" + CUMULATIVE + """, z AS (SELECT sum(size_bp) AS total_bp FROM fx_sizes), u AS (SELECT unnest(range(41)) AS percent)
SELECT percent, coalesce(max(cumulative_bp) FILTER (before_bp < percent * total_bp / 100), 0) AS covered_bp, count(*) FILTER (before_bp < percent * total_bp / 100) AS regions FROM u, cu, z GROUP BY 1""",
)
add("tk14_follow_up_rank", lambda s, d: S.ranked(SQ.known_measured(s, d).withColumn("ok", F.coalesce(F.col("spearman") >= 0.02, F.lit(False))), [F.desc("ok"), F.desc_nulls_last("spearman"), F.desc_nulls_last("pearson"), F.col("chrom"), F.col("w_start")], by=-(F.col("ok").cast("int") * 10 + F.coalesce("spearman", F.lit(-2.0)))).select("chrom", "w_start", "rank"), SQ.KNOWN + " SELECT chrom, w_start, rank FROM (SELECT *, row_number() OVER (ORDER BY coalesce(spearman >= 0.02, false) DESC, spearman DESC NULLS LAST, pearson DESC NULLS LAST, chrom, w_start) AS rank FROM gk)", dense=True)
add("st_e2_unexpected_rows", lambda s, d: X.table(s, d, "orders").select("o_custkey").join(X.table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").groupBy().agg(F.count("*").alias("unexpected")), "SELECT count(*) AS unexpected FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)", False)
add(
    "sf15_markdown_cells",
    lambda s, d: X.table(s, d, "part").select("p_partkey", F.concat_ws(" | ", G.markdown_cell(F.replace("p_name", F.lit(" "), F.lit("|")), "string"), G.markdown_cell(F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice") / 3), "double")).alias("cells")),
    "SELECT p_partkey, replace(p_name, ' ', '/') || ' | ' || CASE WHEN p_partkey % 7 = 0 THEN 'NA' ELSE printf('%.6f', p_retailprice / 3) END AS cells FROM part",
    False,
)


def regions(s, d):
    """Regions of the best tenth of windows, ranked by their peaks."""
    return IQ.merged(s, d).select("chrom", "r_start", "r_end", F.col("peak_rank").alias("rank"))


BUDGETS = (0.05, 0.1, 0.2, 0.3)


def selected_regions(s, d):
    """(budget, chrom, r_start, r_end, rank): regions within each budget."""
    r = regions(s, d)
    return r.join(E.budgets(I.cumulative_union(r, "r_start", "r_end", "rank", [], X.BUCKET, wide=True), genome(s, d), BUDGETS).select("rank", "budget"), "rank")


def region_baseline(s, d):
    """Recall of the regions of each budget, and of as many regions of the same lengths at starts drawn by hash."""
    t, own = X.structures(s, d), selected_regions(s, d)
    name = F.concat_ws("|", F.format_string("%.2f", "budget"), F.col("rank").cast("string"))
    draws = B.region_matched(own.withColumn("region_id", name), X.sizes(s, d), 20, 7, ["budget"])
    random = E.comparison(draws, t, ["budget", "repeat"], X.BUCKET, ("r_start", "r_end"))
    summary = B.summary(random.withColumn("setting", F.col("budget")), "recall").withColumnRenamed("setting", "budget")
    bp = random.groupBy("budget").agg(F.avg("union_bp").alias("random_bp"), F.avg("CHIN_recall").alias("CHIN_mean"), F.avg("OPCID_recall").alias("OPCID_mean"), F.avg("CHID_recall").alias("CHID_mean"))
    return E.comparison(own, t, ["budget"], X.BUCKET, ("r_start", "r_end")).select("budget", "n", "union_bp", "recall").join(summary, "budget").join(bp, "budget")


def comparison_sql(sel: str, keys: str, a: str = "w_start", b: str = "w_end") -> str:
    """CTEs that end in cmp(keys, n, union_bp, recalls) of the intervals in `sel`."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    names = [("", "true"), *[(f"{k}_", f"type = '{k}'") for k in E.CLASSES]]
    share = lambda n, w, m: f"coalesce(round(count(*) FILTER ({w}{' AND center' if m == 'recall' else ''}) / nullif((SELECT count(*) FROM fx_structures WHERE {w}), 0)::DOUBLE, 6), 0) AS {n}{m}"
    recalls = ", ".join(share(n, w, m) for m in ("recall", "overlap_recall") for n, w in names)
    return f"""ci AS (SELECT *, max({b}) OVER (PARTITION BY {keys}, chrom ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM {sel}),
cj AS (SELECT *, sum(CASE WHEN mx IS NULL OR {a} >= mx THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, chrom ORDER BY {a}, {b} ROWS UNBOUNDED PRECEDING) AS isl FROM ci),
cu2 AS (SELECT {keys}, CAST(sum(bp) AS BIGINT) AS union_bp FROM (SELECT {keys}, chrom, isl, max({b}) - min({a}) AS bp FROM cj GROUP BY ALL) GROUP BY {keys}),
cn AS (SELECT {keys}, count(*) AS n FROM {sel} GROUP BY {keys}),
ch AS (SELECT {keys}, structure, type, bool_or({a} <= s_center AND s_center < {b}) AS center FROM {sel} w JOIN fx_structures t ON w.chrom = t.chrom AND w.{a} < t.s_end AND w.{b} > t.s_start GROUP BY ALL),
cr AS (SELECT {keys}, {recalls} FROM ch GROUP BY {keys}),
cmp AS (SELECT x.*, y.union_bp, {', '.join(f'coalesce(z.{n}{m}, 0) AS {n}{m}' for m in ('recall', 'overlap_recall') for n, _ in names)} FROM cn x JOIN cu2 y ON {on} LEFT JOIN cr z ON {on.replace('y.', 'z.')})"""


REGIONS = IQ.RANKED + IQ.GAPS + ", q AS MATERIALIZED (SELECT chrom, min(w_start) AS a, max(w_end) AS b, min(rank) AS rank FROM g GROUP BY chrom, island)" + CUMULATIVE + """, z AS (SELECT sum(size_bp) AS total_bp FROM fx_sizes),
sr AS MATERIALIZED (SELECT bu.budget, q.chrom, q.a AS r_start, q.b AS r_end, q.rank FROM q JOIN cu ON cu.rank = q.rank, z, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3]) AS budget) bu WHERE before_bp < round(budget * total_bp, 6))"""
RANDOM_REGIONS = """, rg AS (SELECT budget, r AS repeat, sr.chrom, r_end - r_start AS n, size_bp - (r_end - r_start) + 1 AS room, CAST('0x' || substr(sha256('7|' || r || '|' || printf('%.2f', budget) || '|' || rank), 1, 15) AS BIGINT) AS h FROM sr JOIN fx_sizes USING (chrom), (SELECT unnest(range(20)) AS r)),
rr AS MATERIALIZED (SELECT budget, repeat, chrom, h % greatest(room, 1) AS r_start, h % greatest(room, 1) + n AS r_end FROM rg)"""
own_sql, random_sql = (comparison_sql(*x, "r_start", "r_end") for x in (("sr", "budget"), ("rr", "budget, repeat")))
for k in ("ci", "cj", "cu2", "cn", "ch", "cr", "cmp"):
    random_sql = re.sub(rf"\b{k}\b", f"{k}_r", random_sql)
add(
    "rn04_baseline_comparison",
    region_baseline,
    REGIONS + RANDOM_REGIONS + ", " + own_sql + ", " + random_sql + """
SELECT a.budget, a.n, a.union_bp, a.recall, round(avg(b.recall), 6) AS mean, round(stddev_pop(b.recall), 6) AS std, round(quantile_cont(b.recall, 0.025), 6) AS q025, round(quantile_cont(b.recall, 0.975), 6) AS q975,
round(avg(b.union_bp), 6) AS random_bp, round(avg(b."CHIN_recall"), 6) AS "CHIN_mean", round(avg(b."OPCID_recall"), 6) AS "OPCID_mean", round(avg(b."CHID_recall"), 6) AS "CHID_mean" FROM cmp a JOIN cmp_r b ON a.budget = b.budget GROUP BY 1, 2, 3, 4""",
)


def coverage_baseline(s, d):
    """Recall of windows drawn until they cover what the regions of each budget cover: by budget, over the repeats."""
    t = X.structures(s, d)
    target = {float(r["union_bp"]): r["budget"] for r in E.comparison(selected_regions(s, d), t, ["budget"], X.BUCKET, ("r_start", "r_end")).collect()}
    draws = B.coverage_matched(s, X.medium(s, d), sorted(target), 20, 20260920)
    names = s.createDataFrame([(k, v) for k, v in target.items()], "setting double, budget double")
    rows = draws.select("setting", "repeat", F.explode("chosen").alias("w")).select("setting", "repeat", "w.*")
    each = draws.select("setting", "repeat", "covered_bp", "matched").join(E.comparison(rows, t, ["setting", "repeat"], X.BUCKET).drop("n", "union_bp"), ["setting", "repeat"])
    more = each.groupBy("setting").agg(F.avg("covered_bp").alias("covered_bp"), F.avg(F.col("matched").cast("double")).alias("match_rate"))
    return B.summary(each, "recall").join(more, "setting").join(F.broadcast(names), "setting").drop("setting")


add("rn04_coverage_baseline", coverage_baseline)
#: The detectors: how the four z scores make one, as SQL, which Spark reads too.
METHODS = {
    "density_only": "(rep1_density + rep2_density) / 2",
    "shape_only": "(rep1_shape + rep2_shape) / 2",
    "legacy_mean": "((rep1_density + rep1_shape) / 2 + (rep2_density + rep2_shape) / 2) / 2",
    "or_max": "(greatest(rep1_density, rep1_shape) + greatest(rep2_density, rep2_shape)) / 2",
    "positive_sum": "(greatest(rep1_density, 0) + greatest(rep1_shape, 0) + greatest(rep2_density, 0) + greatest(rep2_shape, 0)) / 2",
}


def method_scores(s, d, calibrated: bool = False):
    """(method, chrom, w_start, w_end, center, score) of every window and detector."""
    v = SQ.wide_z(s, d).select("chrom", "w_start", *[F.expr(e).alias(m) for m, e in METHODS.items()])
    names = list(METHODS)
    if calibrated:
        c = SQ.calibrated(s, d).select("chrom", "w_start", F.col("density_score").alias("calibrated_density"), F.col("shape_score").alias("calibrated_shape"), F.col("or_score").alias("calibrated_or"))
        v, names = v.join(c, ["chrom", "w_start"]), [*names, "calibrated_density", "calibrated_shape", "calibrated_or"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("score")) for m in names])).alias("z")
    return v.join(X.medium(s, d).select("chrom", "w_start", "w_end", "center"), ["chrom", "w_start"]).select("chrom", "w_start", "w_end", "center", each).select("z.*", "chrom", "w_start", "w_end", "center")


def detectors(s, d, calibrated: bool = False):
    """Windows, union and recalls of the best fractions of windows by each detector."""
    r = numbered(method_scores(s, d, calibrated), [F.desc("score"), F.col("chrom"), F.col("w_start")], -F.col("score"), ["method"])
    top = r.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in SQ.FR]))).where(F.col("rank") <= S.fraction_count(F.col("_n"), F.col("fraction")))
    return E.comparison(top, X.structures(s, d), ["method", "fraction"], X.BUCKET)


def detectors_sql(extra: str = "") -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, chrom, w_start, round({e}, 9) AS score FROM v" for m, e in METHODS.items())
    return SQ.WIDE + (SQ.CAL.replace(SQ.LONG, "", 1) if extra else "") + f""", dm AS ({rows}{extra}),
dr AS (SELECT *, w_start + 6400 AS w_end, row_number() OVER (PARTITION BY method ORDER BY score DESC, chrom, w_start) AS k, count(*) OVER (PARTITION BY method) AS rows FROM dm),
ds AS MATERIALIZED (SELECT * FROM dr, (SELECT unnest([0.01::DOUBLE, 0.02, 0.05, 0.1, 0.2]) AS fraction) WHERE k <= least(rows, greatest(1, ceil(round(rows * fraction, 9))))), """ + comparison_sql("ds", "method, fraction") + " SELECT * FROM cmp"


add("ev01_detector_comparison", detectors, detectors_sql())
CALIBRATED = "".join(f" UNION ALL SELECT '{m}', chrom, w_start, round({e}, 9) FROM c" for m, e in {"calibrated_density": "density_score", "calibrated_shape": "shape_score", "calibrated_or": "greatest(density_score, shape_score)"}.items())
add("ev02_detector_comparison", lambda s, d: detectors(s, d, True), detectors_sql(CALIBRATED))


def region_coverage(s, d):
    """Regions around the peaks of each detector, within budgets of the genome: union and recalls."""
    r = numbered(method_scores(s, d, True), [F.desc("score"), F.col("chrom"), F.col("w_start")], -F.col("score"), ["method"]).drop("_n")
    peaks = S.greedy(r.withColumn("radius", F.lit(3200.0)), ["method", "chrom"], "rank", "center", "radius")
    found = S.regions(peaks, ["method", "chrom"], "rank", "w_start", "w_end", 800).withColumnRenamed("peak_rank", "rank")
    within = E.budgets(I.cumulative_union(found, "r_start", "r_end", "rank", ["method"], X.BUCKET, wide=True), genome(s, d), BUDGETS)
    return E.comparison(found.join(within.select("method", "rank", "budget"), ["method", "rank"]), X.structures(s, d), ["method", "budget"], X.BUCKET, ("r_start", "r_end"))


add("ev02_region_coverage", region_coverage)
add("ev04_scale_coverage", lambda s, d: I.union_bp(I.with_overlap(X.windows(s, d), X.structures(s, d), IQ.WIN, X.BUCKET), "w_start", "w_end", ["scale"]), f""", kw AS (SELECT DISTINCT w.scale, w.chrom, w.w_start, w.w_end FROM fx_windows w JOIN fx_structures t ON {IQ.HIT})
SELECT scale, CAST(sum(b - a) AS BIGINT) AS union_bp FROM (SELECT scale, chrom, isl, min(w_start) AS a, max(w_end) AS b FROM (SELECT *, sum(CASE WHEN mx IS NULL OR w_start >= mx THEN 1 ELSE 0 END) OVER (PARTITION BY scale, chrom ORDER BY w_start) AS isl FROM (SELECT *, max(w_end) OVER (PARTITION BY scale, chrom ORDER BY w_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM kw)) GROUP BY 1, 2, 3) GROUP BY 1""")
add("gt02_completion", lambda s, d: X.marked(s, d).groupBy("split").agg(F.bool_and((F.col("rep1_density") >= 0) & (F.col("rep2_density") >= 0)).alias("non_negative"), F.bool_and(~F.isnan("rep1_shape")).alias("finite")), "SELECT split, bool_and(rep1_density >= 0 AND rep2_density >= 0) AS non_negative, bool_and(NOT isnan(rep1_shape)) AS finite FROM fx_marked GROUP BY 1")


def rescue(s, d):
    """Structures that the best fifth of windows of each scale, in an order by hash, overlap."""
    key = F.sha2(F.concat_ws("|", F.lit("3"), "scale", "chrom", "w_start"), 256)
    windows = X.windows(s, d).withColumn("key", key)
    top = S.top_fraction(windows, [F.col("key")], 0.2, ["scale"], by=F.conv(F.substring("key", 1, 12), 16, 10).cast("double"))
    hit = I.range_join(top, X.structures(s, d), X.BUCKET).groupBy("structure").agg(F.collect_set("scale").alias("scales"))
    return X.structures(s, d).select("structure", "type").join(hit, "structure", "left").withColumn("scales", F.coalesce("scales", F.array().cast("array<string>")))


def diagnosed(s, d):
    only = lambda scale, kind: F.count_if((F.array_join("scales", ",") == scale) & (F.col("type") == kind))
    one = rescue(s, d).agg(
        only("small", "CHIN").alias("small"), only("large", "CHID").alias("large"), F.avg((F.size("scales") > 0).cast("double")).alias("multi"),
        F.avg(F.array_contains("scales", "medium").cast("double")).alias("medium"), F.count_if(F.size("scales") == 0).alias("missed"), F.count("*").alias("total"),
    )
    cases = F.explode(F.array(F.struct(F.lit("ready").alias("name"), F.lit(True).alias("ready"), F.lit(1).alias("keep")), F.struct(F.lit("found").alias("name"), F.lit(False).alias("ready"), F.lit(1).alias("keep")), F.struct(F.lit("without rescue").alias("name"), F.lit(False).alias("ready"), F.lit(0).alias("keep"))))
    text = G.diagnosis(F.col("c.ready"), F.col("small") * F.col("c.keep"), F.col("large") * F.col("c.keep"), F.col("multi"), F.col("medium"), F.col("missed"), F.col("total"))
    return one.withColumn("c", cases).select(F.col("c.name").alias("name"), text.alias("diagnosis"))


RESCUE = f""", rk AS (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY sha256('3|' || scale || '|' || chrom || '|' || w_start)) AS k, count(*) OVER (PARTITION BY scale) AS n FROM fx_windows),
tp AS (SELECT * FROM rk WHERE k <= greatest(1, ceil(round(n * 0.2, 9)))),
rs AS (SELECT t.structure, t.type, coalesce(list(DISTINCT w.scale) FILTER (w.scale IS NOT NULL), []) AS scales FROM fx_structures t LEFT JOIN tp w ON {IQ.HIT} GROUP BY 1, 2),
ro AS (SELECT count(*) FILTER (scales = ['small'] AND type = 'CHIN') AS small, count(*) FILTER (scales = ['large'] AND type = 'CHID') AS large, avg((len(scales) > 0)::INT) AS multi, avg(list_contains(scales, 'medium')::INT) AS medium, count(*) FILTER (len(scales) = 0) AS missed, count(*) AS total FROM rs)"""
add(
    "gt05_diagnosis",
    diagnosed,
    RESCUE + """, cs AS (SELECT * FROM (VALUES ('ready', true, 1), ('found', false, 1), ('without rescue', false, 0)) t(name, ready, keep))
SELECT name, CASE WHEN ready THEN 'Task2A multi-scale detector passed the pre-registered readiness gate. Stop; next suggested phase is Task2B Structure Representation.'
WHEN (small + large) * keep > 0 THEN 'At 20% coverage, Small uniquely rescues ' || small || ' CHIN and Large uniquely rescues ' || large || ' CHID; MultiScale Overall=' || printf('%.4f', multi) || ' versus Medium=' || printf('%.4f', medium) || ', while ' || missed || '/' || total || ' remain missed by all scales. Scale contributes distinct rescues, but failed gates indicate scale alone is insufficient; representation/anomaly strength remains a bottleneck.'
ELSE 'At 20% coverage no unique Small-CHIN or Large-CHID rescue was observed; MultiScale Overall=' || printf('%.4f', multi) || ' versus Medium=' || printf('%.4f', medium) || ', and ' || missed || '/' || total || ' remain missed by all scales. Evidence does not support window scale as the main fix; the representation or the assumption that known structures are strong background anomalies requires re-examination.' END AS diagnosis FROM ro, cs""",
)


def evaluation_levels(s, d):
    """Cross-entropy and accuracy of three logits: of the mean of both replicates (a structure), and of each replicate."""
    e = SQ.emb(s, d).select(F.expr("vec_id div 2").alias("structure"), (F.col("vec_id") % 2).alias("replicate"), F.col("label"), *[F.col("embedding")[k].cast("double").alias(f"z{k}") for k in range(3)])
    true = e.groupBy("structure").agg((F.min_by("label", "replicate") % 3).alias("y"))
    mean = e.groupBy("structure").agg(*[F.avg(f"z{k}").alias(f"z{k}") for k in range(3)]).withColumn("level", F.lit("structure"))
    each = e.select("structure", "z0", "z1", "z2", F.concat(F.lit("rep"), (F.col("replicate") + 1).cast("string")).alias("level"))
    rows = mean.unionByName(each).join(true, "structure")
    own = F.element_at(F.array("z0", "z1", "z2"), F.col("y").cast("int") + 1)
    loss = F.log(F.exp("z0") + F.exp("z1") + F.exp("z2")) - own
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.avg(loss).alias("cross_entropy"), F.avg((own == F.greatest("z0", "z1", "z2")).cast("double")).alias("accuracy"))


add(
    "ml03_cross_entropy",
    evaluation_levels,
    """WITH e AS (SELECT vec_id // 2 AS structure, vec_id % 2 AS replicate, label, CAST(embedding[1] AS DOUBLE) AS z0, CAST(embedding[2] AS DOUBLE) AS z1, CAST(embedding[3] AS DOUBLE) AS z2 FROM embeddings),
y AS (SELECT structure, arg_min(label, replicate) % 3 AS y FROM e GROUP BY 1),
r AS (SELECT structure, 'structure' AS level, avg(z0) AS z0, avg(z1) AS z1, avg(z2) AS z2 FROM e GROUP BY 1 UNION ALL SELECT structure, 'rep' || replicate + 1, z0, z1, z2 FROM e),
o AS (SELECT *, [z0, z1, z2][y + 1] AS own FROM r JOIN y USING (structure))
SELECT level, count(*) AS n, round(avg(ln(exp(z0) + exp(z1) + exp(z2)) - own), 6) AS cross_entropy, round(avg((own = greatest(z0, z1, z2))::INT), 6) AS accuracy FROM o GROUP BY 1""",
    False,
)


def clusters(s, d):
    """Density clusters of candidate vectors on 95 % of their variance: the primary setting and both sensitivity settings, each against the primary."""
    return ml.density_runs(SQ.emb(s, d).where("label >= 6"), "vec_id", "embedding")


add("ml09_density_clusters", clusters)
#: The networks' queries train small ones for few epochs; the defaults of `nets` are the full sizes.
IMAGE, SHAPE, EPOCHS = 16, {"widths": (4, 8, 8), "hidden": 16}, 6


def window_images(s, d):
    """Log counts of medium windows around structures, both replicates, in IMAGE x IMAGE bins, with class and structure."""
    t = X.structures(s, d).withColumn("w_start", F.expr("CAST(floor((s_center - 3200) / 800) AS BIGINT) * 800"))
    fold = 64 // IMAGE
    c = X.cells(s, d).join(t.select("chrom", "w_start", "structure", "type"), ["chrom", "w_start"])
    c = c.groupBy("structure", "type", "replicate", F.expr(f"CAST(i div {fold} AS INT)").alias("i"), F.expr(f"CAST(j div {fold} AS INT)").alias("j")).agg(F.log1p(F.sum("value")).alias("value"))
    return nets.images(c, ["structure", "type", "replicate"], IMAGE)


def background_images(s, d):
    """The same of the background windows of both replicates, by the splits of their blocks."""
    fold = 64 // IMAGE
    c = X.cells(s, d).join(X.marked(s, d).where("NOT known").select("chrom", "w_start", "split"), ["chrom", "w_start"])
    c = c.groupBy("chrom", "w_start", "replicate", "split", F.expr(f"CAST(i div {fold} AS INT)").alias("i"), F.expr(f"CAST(j div {fold} AS INT)").alias("j")).agg(F.log1p(F.sum("value")).alias("value"))
    return nets.images(c, ["chrom", "w_start", "replicate", "split"], IMAGE)


def held(df, most=2_000):
    """At most so many images, by hash, on the driver."""
    return df.orderBy(F.xxhash64(*[c for c in df.columns if c != "image"])).limit(most).toPandas()


def trained_classifier(s, d):
    rows = settled(window_images(s, d))
    pdf = held(rows)
    y = pdf["type"].map({k: i for i, k in enumerate(E.CLASSES)}).to_numpy()
    x, own = nets.pixels_of(pdf, IMAGE), pdf["structure"].to_numpy()
    val = np.isin(own, np.unique(own)[::4])  # every fourth structure, with both replicates
    if val.all():
        return rows, nets.classifier(20260920, **SHAPE), 0, []
    return rows, *nets.fit_classifier((x[~val], y[~val], own[~val]), (x[val], y[val], own[val]), epochs=EPOCHS, patience=3, **SHAPE)


def classified(s, d):
    """Logits' best class and the size of the hidden vector, of every structure and replicate."""
    rows, net, _, _ = trained_classifier(s, d)
    run = lambda x: {"predicted": [E.CLASSES[k] for k in nets.predict(net, x).argmax(1)], "hidden": np.sqrt((nets.predict(net, x, "hidden") ** 2).sum(1))}
    return nets.apply(rows, IMAGE, run, "structure long, type string, replicate string, predicted string, hidden double", ["structure", "type", "replicate"])


def training_history(s, d):
    """Loss and validation score by epoch, and the epoch that is kept."""
    _, _, best, history = trained_classifier(s, d)
    return s.createDataFrame([(h["epoch"], h["train_loss"], h["score"][0], -h["score"][1], h["epoch"] == best) for h in history], "epoch int, train_loss double, macro_f1 double, loss double, kept boolean")


def attention(s, d):
    """Grad-CAM of every structure and replicate: its mean on the diagonal band and off it."""
    rows, net, _, _ = trained_classifier(s, d)
    i, j = np.indices((IMAGE, IMAGE))
    band = np.abs(i - j) <= 1
    run = lambda x: {k: [float(nets.grad_cam(net, v)[m].mean()) for v in x] for k, m in (("band", band), ("rest", ~band))}
    return nets.apply(rows, IMAGE, run, "structure long, replicate string, band double, rest double", ["structure", "replicate"])


def trained_autoencoder(s, d):
    rows = settled(background_images(s, d))
    parts = [nets.pixels_of(held(rows.where(F.col("split") == k), n), IMAGE) for k, n in (("train", 600), ("val", 200))]
    if not all(len(p) for p in parts):
        return rows, nets.autoencoder(20260920, (4, 4, 8)), parts
    return rows, nets.fit_autoencoder(*parts, epochs=EPOCHS, patience=3, widths=(4, 4, 8))[0], parts


def reconstruction(s, d):
    """Mean squared error of the convolutional autoencoder on every background window, and the size of the pooled code."""
    rows, net, _ = trained_autoencoder(s, d)
    run = lambda x: {"error": ((nets.predict(net, x) - x) ** 2).mean((1, 2, 3)), "code": np.sqrt((nets.predict(net, x, "code").mean((2, 3)) ** 2).sum(1))}
    return nets.apply(rows, IMAGE, run, "chrom string, w_start long, replicate string, split string, error double, code double", ["chrom", "w_start", "replicate", "split"])


add("ml01_classified", classified)
add("ml02_training", training_history)
add("ml12_grad_cam", attention)
add("ml04_autoencoder", lambda s, d: reconstruction(s, d).groupBy("split").agg(F.count("*").alias("n"), F.avg("error").alias("mean_error")))
add("ml05_pooled_encoder", lambda s, d: reconstruction(s, d).groupBy("chrom", "w_start").agg(F.avg("code").alias("code")))
add("ml11_two_components", lambda s, d: ml.pca95(SQ.emb(s, d), "embedding")[0].select("vec_id", F.abs(F.col("pca")[0]).alias("x"), F.abs(F.col("pca")[1]).alias("y")))
add("st07_label_agreement", lambda s, d: stats.adjusted_rand(SQ.emb(s, d).select("label", (F.col("vec_id") % 3).alias("b")), "label", "b"), "WITH c AS (SELECT label, vec_id % 3 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS al FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY label)), e AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((ij - i * j / (al * (al - 1) / 2)) / ((i + j) / 2 - i * j / (al * (al - 1) / 2)), 6) AS ari FROM a, x, e", False)
add("src10_inventory", lambda s, d: A.inventory(s, d).groupBy("kind", "tags").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")))
add(
    "src11_container_health",
    lambda s, d: A.container_health(X.pixels(s, d), X.sizes(s, d), 100, ["replicate"]),
    """, k AS (SELECT p.*, size_bp FROM fx_pixels p LEFT JOIN fx_sizes USING (chrom))
SELECT replicate, CAST(100 AS BIGINT) AS binsize, count(*) AS pixels, count(DISTINCT chrom) AS chromosomes, (SELECT CAST(sum(size_bp // 100) AS BIGINT) FROM fx_sizes) AS bins, count(*) FILTER (bin1 > bin2) AS below_diagonal,
count(*) FILTER ((bin2 + 1) * 100 > size_bp OR bin1 < 0) AS outside, count(*) FILTER (cnt < 0 OR isnan(cnt)) AS bad_counts, false AS has_weight, bool_and(bin1 <= bin2 AND (bin2 + 1) * 100 <= size_bp AND bin1 >= 0 AND cnt >= 0) AS readable FROM k GROUP BY 1""",
)


def block_splits(s, d):
    """Structures with the split of the block that holds their center."""
    t = X.structures(s, d).withColumn("block_id", P.block_name(F.col("chrom"), F.col("s_center"), X.BLOCK))
    return t.join(P.hash_block_split(t.select("block_id").distinct(), "block_id", 20260920), "block_id")


add(
    "sp05_split_diagnostics",
    lambda s, d: P.diagnostics(block_splits(s, d), "block_id", "type", "split"),
    """, t AS (SELECT *, chrom || ':' || CAST(floor(s_center / 12800) AS BIGINT) AS block_id FROM fx_structures),
h AS (SELECT block_id, row_number() OVER (ORDER BY sha256('20260920|' || block_id), block_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT block_id FROM t)),
sp AS (SELECT t.*, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM t JOIN h USING (block_id)),
g AS (SELECT split, coalesce(type, 'ALL') AS class, count(DISTINCT block_id) AS groups, count(*) AS n FROM sp GROUP BY GROUPING SETS ((split, type), (split)))
SELECT split, class, groups, n, round(n / sum(n) OVER (PARTITION BY class), 6) AS share FROM g""",
)


def master_split(s, d):
    """Blocks of each chromosome in three splits, such that small background windows are in all of them."""
    free = I.without_overlap(X.windows(s, d).where("scale = 'small'"), X.structures(s, d), IQ.WIN, X.BUCKET).select("chrom", "scale", F.expr("w_start div 3200").alias("block"))
    return P.master_split(X.sizes(s, d), 3200, 20260920, free)


add("iv10_master_split", master_split)
add("gt01_engineering_gate", lambda s, d: X.structures(s, d).agg(F.count("*").alias("n"), F.count_distinct("type").alias("k")).select(*G.gate({"some": F.col("n") > 0, "classes": F.col("k") >= 2, "unknown_fails": F.lit(None).cast("boolean")})), "SELECT count(*) > 0 AS some, count(DISTINCT type) >= 2 AS classes, false AS unknown_fails, false AS ready FROM fx_structures")
