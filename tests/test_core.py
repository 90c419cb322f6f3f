"""Literals worked out by hand, and properties that don't depend on data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import schema
from pairloom.functions import ids
from pairloom.functions import vectors as V
from pairloom.operators import contacts as K
from pairloom.operators import intervals as I
from pairloom.operators import ml
from pairloom.operators import selection as S
from pairloom.operators import splits as P
from pairloom.operators import stats


def pixels(spark, rows, **more):
    return spark.createDataFrame([("rep1", "c", *map(int, r[:2]), float(r[2])) for r in rows], "replicate string, chrom string, bin1 long, bin2 long, cnt double")


def test_expected(spark):
    sizes = spark.createDataFrame([("c", 300)], "chrom string, size_bp long")
    got = K.expected(pixels(spark, [(0, 0, 6), (0, 1, 4), (1, 1, 3), (2, 2, 3)]), sizes, ["replicate", "chrom"], 3).orderBy("d").collect()
    assert [r["expected"] for r in got] == [4, 2, 0]


def test_genome_oe(spark):
    m, e = [[4, 4, 9], [4, 8, 2], [9, 2, 12]], [4.0, 2.0, 0.0]
    rows = [(i, j, float(m[i][j]), e[abs(i - j)]) for i in range(3) for j in range(3)]
    got = spark.createDataFrame(rows, "i int, j int, v double, e double").select("i", "j", K.genome_oe(F.col("v"), F.col("e")).alias("oe"), K.reproducibility_oe(F.col("v"), F.col("e")).alias("r")).orderBy("i", "j").collect()
    assert [r["oe"] for r in got] == [1, 2, 0, 2, 2, 1, 0, 1, 3] and [r["r"] for r in got][2] is None


def test_local_oe(spark):
    m = [[2, 4, 8], [4, 2, 4], [8, 4, 2]]
    cells = spark.createDataFrame([(1, i, j, j - i, float(m[i][j]), 3) for i in range(3) for j in range(i, 3)], "w int, i int, j int, d int, value double, n int")
    assert all(abs(r["oe"] - 1) < 1e-7 for r in K.local_oe(cells, ["w"], F.col("n")).collect())


def test_rebin(spark):
    got = K.rebin(pixels(spark, [(i, i, 1) for i in range(100)]), F.lit(0), 10, 20, 10).collect()
    assert len(got) == 10 and all(r["i"] == r["j"] and r["value"] == 2 for r in got)


def test_mask_sizes(spark):
    n = spark.createDataFrame([(4,), (8,), (32,), (64,), (128,)], "n int").select(K.mask_size(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in n] == [1, 15, 435, 1891, 7875]


def test_density_counts_zeros(spark):
    cells = spark.createDataFrame([(1, i, j, j - i, float(4 * i + j), 4) for i in range(4) for j in range(i, 4)], "w int, i int, j int, d int, value double, n int")
    r = K.density_features(cells, ["w"], F.col("n")).first()
    assert (r["density_mean"], r["density_std"], r["density_total"]) == (3, 0, 3)
    sparse = spark.createDataFrame([(1, 0, 5, 5, 10.0, 8)], "w int, i int, j int, d int, value double, n int")
    r, v = K.density_features(sparse, ["w"], F.col("n")).first(), [10.0] + [0.0] * 14
    assert np.isclose(r["density_mean"], np.mean(v)) and np.isclose(r["density_std"], np.std(v))
    assert np.isclose(K.masked_percentile(sparse, ["w"], F.col("n"), 0.95).first()["percentile"], np.percentile(v, 95))


@pytest.mark.parametrize(("centers", "n"), [((3200, 9599, 15998), 1), ((3200, 9600), 2)])
def test_islands(spark, centers, n):
    df = spark.createDataFrame([("c", c - 3200, c + 3200) for c in centers], "chrom string, a long, b long")
    assert I.islands(df, "a", "b", [], ["chrom"]).select("island").distinct().count() == n


def test_union(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 15), ("b", 0, 4)], "chrom string, a long, b long")
    assert I.union_bp(df, "a", "b", []).first()["union_bp"] == 19


def test_anti_join_touching(spark):
    w = spark.createDataFrame([(0, "c", 0, 3600), (1, "c", 1, 3601), (2, "c", 16400, 20000)], "k int, chrom string, w_start long, w_end long")
    e = spark.createDataFrame([("c", 3600, 16400)], "chrom string, s_start long, s_end long")
    assert sorted(r["k"] for r in I.without_overlap(w, e, ["k"], 1000).collect()) == [0, 2]


def test_windows(spark):
    size = lambda n: spark.createDataFrame([("c", n)], "chrom string, size_bp long")
    assert [r["w_start"] for r in K.windows(size(20000), (("x", 6400, 4000),)).orderBy("w_start").collect()] == [0, 4000, 8000, 12000]
    n = {r["scale"]: r["count"] for r in K.windows(size(4641652)).groupBy("scale").count().collect()}
    assert n == {"small": 11597, "medium": 5795, "large": 2894}


def test_window_cells_equal_a_join(spark):
    rnd = random.Random(2)
    px = pixels(spark, [(b, b + rnd.randrange(40), rnd.randrange(1, 5)) for b in range(0, 200)])
    sizes = spark.createDataFrame([("c", 24000)], "chrom string, size_bp long")
    got = {(r["scale"], r["w_start"], r["i"], r["j"], r["value"]) for r in K.window_cells(px, sizes).collect()}
    w = K.windows(sizes).collect()
    want = {(x["scale"], x["w_start"], p["bin1"] - x["w_start"] // 100, p["bin2"] - x["w_start"] // 100, p["cnt"]) for x in w for p in px.collect() if p["bin1"] * 100 >= x["w_start"] and (p["bin2"] + 1) * 100 <= x["w_end"]}
    assert got == want


def test_block_split_sizes(spark):
    b = spark.createDataFrame([(f"c:{i}",) for i in range(37)], "block string")
    n = {r["split"]: r["count"] for r in P.hash_block_split(b, "block", 1).groupBy("split").count().collect()}
    assert n == {"train": 26, "val": 6, "test": 5}


def test_tail_probability(spark):
    q = spark.createDataFrame([(float(x),) for x in range(6)], "x double")
    c = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "x double")
    assert [round(r["p"], 9) for r in stats.tail_p(q, c, "x").orderBy("x").collect()] == [1, 1, 0.8, 0.4, 0.4, 0.2]


NMS = [("a", 0, 6400, 3200, 1), ("b", 800, 7200, 4000, 2), ("c", 1600, 8000, 4800, 3), ("d", 3200, 9600, 6400, 4), ("e", 8000, 14400, 11200, 5)]


def peaks(spark, rows, seed=0):
    df = spark.createDataFrame(random.Random(seed).sample([("c", *r, 3200.0) for r in rows], len(rows)), "chrom string, id string, w_start long, w_end long, center long, rank long, radius double")
    return S.greedy(df.repartition(3), ["chrom"], "rank", "center", "radius")


def test_nms_and_regions(spark):
    for seed in range(2):
        got = {r["id"]: r["owner"] for r in peaks(spark, NMS, seed).collect()}
        assert got == {"a": 1, "b": 1, "c": 1, "d": 4, "e": 5}
    r = {x["peak_rank"]: (x["r_start"], x["r_end"], x["members"]) for x in S.regions(peaks(spark, NMS), ["chrom"], "rank", "w_start", "w_end", 800).collect()}
    assert r[1] == (0, 8000, 3)
    r = {x["peak_rank"]: x["members"] for x in S.regions(peaks(spark, [x for x in NMS if x[0] != "b"]), ["chrom"], "rank", "w_start", "w_end", 800).collect()}
    assert r[1] == 1


def test_cross_scale_radius(spark):
    rows = [("small_a", 1600, 3200, 1), ("medium_a", 3200, 6400, 2), ("large_a", 6400, 12800, 3), ("small_b", 8000, 3200, 4)]
    df = spark.createDataFrame([("c", n, c, r, w / 2) for n, c, w, r in rows], "chrom string, id string, center long, rank long, radius double")
    assert {r["id"]: r["owner"] for r in S.greedy(df, ["chrom"], "rank", "center", "radius").collect()} == {"small_a": 1, "medium_a": 1, "large_a": 1, "small_b": 4}


def test_greedy_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [("ab"[i % 2], rnd.randrange(0, 60000), k + 1, float(rnd.choice((800, 1600, 3200)))) for k, i in enumerate(range(300))]
    got = {(r["chrom"], r["rank"]): r["owner"] for r in S.greedy(spark.createDataFrame(rows, "chrom string, center long, rank long, radius double"), ["chrom"], "rank", "center", "radius").collect()}
    kept = {"a": [], "b": []}
    for chrom, at, rank, radius in rows:
        near = [k for k in kept[chrom] if abs(k[0] - at) < max(k[2], radius)]
        assert got[chrom, rank] == (near[0][1] if near else rank)
        if not near:
            kept[chrom].append((at, rank, radius))


@pytest.mark.parametrize("most", [0, 30])
def test_greedy_by_rounds_equals_the_pass(spark, most):
    """Long chains are cut by rounds: the same peaks and owners as one pass, for noise, ramps and ties of place; no round is in vain."""
    rnd = random.Random(4)
    rows = [("n", rnd.randrange(0, 60000), k + 1, float(rnd.choice((800, 1600, 3200)))) for k in range(120)]
    rows += [("r", 700 * k, k + 1, 1600.0) for k in range(12)] + [(None, 400 * k, 30 - k, 800.0) for k in range(12)] + [("t", 5, k + 1, 100.0) for k in range(9)]
    df = spark.createDataFrame(rows, "chrom string, center long, rank long, radius double")
    key = lambda x: sorted((str(r["chrom"]), r["rank"], r["is_peak"], r["owner"]) for r in x.collect())
    assert key(S.greedy(df, ["chrom"], "rank", "center", "radius", most=most)) == key(S.greedy(df, ["chrom"], "rank", "center", "radius"))
    peaks, rounds = S.peaks_by_rounds(df, ["chrom"], "rank", "center", "radius", 3200.0, most)
    assert 0 < rounds <= 12 and peaks.count() > 20


@pytest.mark.parametrize("tile", [1000, 7000, 1 << 30])
def test_segments_do_not_hang_on_tiles(spark, tile):
    rnd = random.Random(2)
    rows = [(c, a, a + rnd.randrange(1, 4000)) for c in ("x", None) for a in (rnd.randrange(0, 120000) for _ in range(80))] + [("y", 0, 10**6), ("y", 999_999, 10**6), ("y", 10**6, 10**6 + 1)]
    df = spark.createDataFrame(rows, "chrom string, a long, b long")
    got = {(r["chrom"], r["a"], r["b"]): (r["island"], r["gap"]) for r in I.gap_islands(I.islands(df, "a", "b", [], ["chrom"], tile), "a", 900, ["b"], ["chrom"], tile).select("*", F.col("island").alias("gap")).collect()}
    one = {(r["chrom"], r["a"], r["b"]): r["island"] for r in I.islands(df, "a", "b", [], ["chrom"], tile).collect()}
    for c in ("x", "y", None):
        own, top, k = sorted((a, b) for d, a, b in rows if d == c), None, 0
        last, g = None, 0
        for a, b in own:
            k += top is None or a >= top
            g += last is None or a - last > 900
            top, last = max(top or b, b), a
            assert one[c, a, b] == k and got[c, a, b][1] == g


def test_coverage_budget(spark):
    df = spark.createDataFrame([("c", 0, 8000, 1), ("c", 3200, 9600, 2), ("c", 8000, 14400, 3)], "chrom string, a long, b long, rank long")
    cum = I.cumulative_union(df, "a", "b", "rank", [], 1000)
    assert [r["cumulative_bp"] for r in cum.orderBy("rank").collect()] == [8000, 9600, 14400]
    n = lambda f: S.within_budget(cum, F.lit(f * 20000), "rank").count()
    assert (n(0.10), n(0.45), n(0.0)) == (1, 2, 0)


def proposals(spark, rows):
    df = spark.createDataFrame([(n, s, w, "c", a, a + w, a + w // 2, d, d, p, p, n == "b", False) for n, s, a, w, d, p in rows], "window_id string, scale string, window_bp long, chrom string, w_start long, w_end long, center long, rep1_density_p double, rep2_density_p double, rep1_shape_p double, rep2_shape_p double, rep1_zero_axis boolean, rep2_zero_axis boolean")
    return S.channel_proposals(df)


def test_channels(spark):
    got = proposals(spark, [("s", "small", 0, 3200, 0.04, 0.06), ("m", "medium", 10000, 6400, 0.06, 0.03), ("l", "large", 30000, 12800, 0.05, 0.05)]).collect()
    assert {(r["scale"], r["branch"]) for r in got} == {("small", "density"), ("medium", "shape"), ("large", "density"), ("large", "shape")}
    got = proposals(spark, [("s1", "small", 0, 3200, 0.001, 0.7), ("s2", "small", 400, 3200, 0.002, 0.7), ("m1", "medium", 0, 6400, 0.001, 0.7), ("l1", "large", 0, 12800, 0.001, 0.7)]).collect()
    assert {r["window_id"] for r in got} == {"s1", "m1", "l1"}


def test_transitive_merge(spark):
    p = proposals(spark, [(n, "small", a, 3200, q, 0.8) for n, a, q in (("a", 0, 0.01), ("b", 3000, 0.02), ("c", 6000, 0.03))])
    r = S.merged_proposals(p, ("small", "medium", "large")).collect()
    assert [(x["r_start"], x["r_end"], x["members"], x["window_id"], x["center"], x["support_channels"], x["rep1_support"], x["zero_axis"], x["from_small_density"], x["from_small_shape"]) for x in r] == [(0, 9200, 3, "a", 1600, 1, 3, True, True, False)]


def test_class_weights(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "unit int, kind string")
    assert {r["kind"]: round(r["weight"], 9) for r in P.class_weights(df, "unit", "kind").collect()} == {"a": round(2 / 3, 9), "b": round(4 / 3, 9), "c": round(4 / 3, 9)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 1)], "t int, p int")
    assert stats.summary_metrics(df, "t", "p").first()["accuracy"] == 0.5
    c = {(r["t"], r["p"]): r["n"] for r in stats.confusion(df, "t", "p").collect()}
    assert [[c[i, j] for j in range(3)] for i in range(3)] == [[1, 0, 0], [1, 0, 0], [0, 1, 1]]


def test_floor_and_percentiles(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.4, 0.3), (0.6, 0.5)], "p double, s double")
    r = stats.known_floor(df, "p", "s").first()
    assert (round(r["pearson_floor"], 9), round(r["spearman_floor"], 9), r["valid"]) == (0.22, 0.12, True)
    x = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert [round(v, 9) for v in x.agg(F.expr("percentile(x, array(0.95, 0.025, 0.975))")).first()[0]] == [3.8, 1.05, 3.9]


def test_pca95(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 40))
    a, b = a - a.mean(), b - b.mean()
    b -= a * (a @ b) / (a @ a)
    a, b = a / a.std() * math.sqrt(0.95), b / b.std() * math.sqrt(0.05)
    df = spark.createDataFrame([(i, [10 + float(x), 5 + float(y)]) for i, (x, y) in enumerate(zip(a, b))], "i int, v array<double>")
    out, shares = ml.pca95(df, "v")
    assert len(shares) == 1 and abs(sum(r["pca"][0] for r in out.collect())) < 1e-8


def test_hdbscan_finds_blobs_and_noise():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [np.array([[20.0, -20.0]])])
    labels, member = ml.hdbscan(x)
    assert len(set(labels[:60])) == 3 and all(len(set(labels[k : k + 20])) == 1 for k in (0, 20, 40)) and labels[60] == -1
    assert ((member >= 0) & (member <= 1)).all() and ml.silhouette(x[:60], labels[:60]) > 0.9


def test_density_runs_of_any_number_of_points(spark, monkeypatch):
    """In blocks of 50 and beyond the plain form's limit: the plain form's figures, with equal points and noise among them."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, sd, (k, 2)) for c, sd, k in (((0, 0), 0.2, 40), ((4, 3), 0.4, 40), ((0, 6), 2.0, 40))] + [np.full((8, 2), 9.0)])
    x = x[rng.permutation(len(x))]
    y, want = x - x.mean(0), []
    first = None
    for least, samples in ml.SETTINGS:
        labels, member = ml.hdbscan(y, least, samples)
        first, kept = labels if first is None else first, labels >= 0
        want.append((least, samples, len(x), len(set(labels[kept].tolist())), int((~kept).sum()), ml.silhouette(y[kept], labels[kept]), ml.rand_index(first, labels), float(member.mean())))
    monkeypatch.setattr(ml, "MOST_POINTS", 100)
    monkeypatch.setattr(ml.density.density_runs, "__defaults__", (0.95, 50))
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [tuple(r) for r in ml.density_runs(df, "id", "v").collect()]
    assert want[0][3] > 2 and got == [pytest.approx(w) for w in want]
    assert [r["noise"] for r in ml.density_runs(df.limit(3), "id", "v").collect()] == [3, 3, 3] and ml.density_runs(df.limit(0), "id", "v").first()["points"] == 0


def test_cosine_of_zeros(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and got[1] is None and math.isclose(got[2], 1)


def test_strict_parsers(spark):
    df = spark.createDataFrame([("TRUE",), ("maybe",)], "x string")
    assert spark.createDataFrame([("TRUE",)], "x string").select(schema.strict_boolean(F.col("x"))).first()[0] is True
    with pytest.raises(Exception, match="not true or false"):
        df.select(schema.strict_boolean(F.col("x"))).collect()
    with pytest.raises(ValueError, match="missing columns: y, z"):
        schema.require(df, ["z", "x", "y"])


def test_identifiers(spark):
    r = spark.range(1).select(ids.short_decimal(F.lit(100.5)).alias("a"), ids.short_decimal(F.lit(100.0)).alias("b"), ids.structure_id(F.lit(" chin "), F.lit("c"), F.lit(1), F.lit(3), F.lit(2.0)).alias("c")).first()
    import hashlib

    assert (r["a"], r["b"], r["c"]) == ("100.5", "100", "CHIN_" + hashlib.sha256(b"CHIN|c|1|3|2").hexdigest()[:16])


def test_pair_counts_equal_enumeration(spark):
    rnd = random.Random(3)
    make = lambda n, a, b: spark.createDataFrame([("ab"[i % 2], s := rnd.randrange(0, 300), s + rnd.randrange(1, 60)) for i in range(n)], f"chrom string, {a} long, {b} long")
    left, right = make(60, "w_start", "w_end"), make(50, "s_start", "s_end")
    want = {}
    for x in left.collect():
        for y in right.collect():
            want[x["chrom"]] = want.get(x["chrom"], 0) + (x["chrom"] == y["chrom"] and x["w_start"] < y["s_end"] and x["w_end"] > y["s_start"])
    assert {r["chrom"]: r["pairs"] for r in I.overlap_pairs(left, right, ("w_start", "w_end"), ("s_start", "s_end")).collect()} == want
    for bucket in (7, 50, 1000):
        assert I.range_join(left, right, bucket).count() == sum(want.values())


def test_range_join_has_no_nested_loop(spark):
    from pairloom.plans import fixtures as X

    df = I.range_join(X.windows(spark, "/root/testdata/sf0.001"), X.structures(spark, "/root/testdata/sf0.001"), X.BUCKET)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_group_split_never_divides_a_group(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, rnd.randrange(40), rnd.choice(["CHIN", "CHIN", "OPCID", "CHID"])) for i in range(200)], "structure int, grp int, type string")
    out = P.group_split(df, "grp", "type", ["CHIN", "OPCID", "CHID"])
    assert out.count() == 200 and P.groups_in_two_splits(out, "grp", "split").count() == 0
    assert out.groupBy("split").agg(F.count_distinct("type").alias("n")).where("n = 3").count() == 3


def test_every_status(spark):
    """The cascade's labels in their order: validity, calibration, overlap, strict novelty, noise, known-like, clustered."""
    from pairloom.operators import status as G

    rows = []
    for i in range(6):  # cluster 0 is novel: six candidates, five of six pass
        rows.append((f"n{i}", False, True, 0, "unannotated", True, i > 0))
    for i in range(4):  # too few
        rows.append((f"f{i}", False, True, 1, "unannotated", True, True))
    rows += [("bad", True, False, 2, "CHIN-like", False, None), ("known", True, False, 2, "CHIN-like", True, True), ("like", False, False, 2, "CHIN-like", True, True), ("like-low", False, False, 2, "CHIN-like", True, False)]
    rows += [("noise", False, False, -1, "", True, True), ("noise-low", False, False, -1, "", True, False), ("mixed", False, False, 3, "mixed-known", True, True), ("mixed-low", False, False, 3, "mixed-known", True, False)]
    df = spark.createDataFrame(rows, "id string, known boolean, novel_like boolean, cluster_id int, cluster_annotation string, correlation_valid boolean, passes boolean")
    clusters = spark.createDataFrame([(0, 6, 0, True), (1, 4, 0, True), (2, 4, 3, False), (3, 2, 1, False)], "cluster_id int, candidate_count long, known_count long, novel_like boolean")
    got = {r["id"]: r for r in G.with_status(df, clusters).collect()}
    want = {f"n{i}": "STRICT_NOVEL_CLUSTER_MEMBER" if i else "UNANNOTATED_CLUSTERED_LOW_REPRODUCIBILITY" for i in range(6)} | {f"f{i}": "UNANNOTATED_CLUSTERED_REPRODUCIBLE" for i in range(4)}
    want |= {"bad": "INSUFFICIENT_QUALITY", "known": "KNOWN_OVERLAP", "like": "KNOWN_LIKE_CLUSTER_REPRODUCIBLE", "like-low": "KNOWN_LIKE_CLUSTER_LOW_REPRODUCIBILITY"}
    want |= {"noise": "UNANNOTATED_NOISE_REPRODUCIBLE", "noise-low": "UNANNOTATED_NOISE_LOW_REPRODUCIBILITY", "mixed": "UNANNOTATED_CLUSTERED_REPRODUCIBLE", "mixed-low": "UNANNOTATED_CLUSTERED_LOW_REPRODUCIBILITY"}
    assert {k: r["final_status"] for k, r in got.items()} == want and all(r["evidence_note"] == G.NOTES[r["final_status"]] for r in got.values())
    assert {r["candidate_pool"] for r in got.values()} == set(G.POOLS) and got["bad"]["reproducible"] is None
    strict, more = G.final_tables(G.with_status(df, clusters))
    assert strict.count() == 5 and {r["id"] for r in more.collect()} == {"f0", "f1", "f2", "f3", "like", "noise", "mixed"}
    stopped = {r["final_status"] for r in G.with_status(df, clusters, False).collect()}
    assert stopped == {"INSUFFICIENT_QUALITY", "CONTROL_CALIBRATION_FAILURE"}


def test_master_blocks():
    from pairloom.operators import splits as P

    rows = P.master_blocks("c", 2_000_001, 100_000, 7)
    assert [r[3:5] for r in rows][-1] == (2_000_000, 2_000_001) and [r[2] for r in rows][:2] == ["c:0", "c:1"]
    assert {s: sum(r[5] == s for r in rows) for s in P.MASTER} == {"train": 15, "validation": 3, "calibration": 3}
    few = {"small": {0, 1, 2, 3}, "large": {0, 1, 5}}
    fit = P.master_blocks("c", 2_000_001, 100_000, 7, few)
    assert fit[0][6] > 1 and all({fit[b][5] for b in blocks} == set(P.MASTER) for blocks in few.values())
    for bad in ((150_000, None), (2_000_000, {"small": {1, 2}})):
        with pytest.raises(ValueError):
            P.master_blocks("c", bad[0], 100_000, 7, bad[1])


def test_seeds():
    from pairloom.functions import seeds

    a, b = seeds.seed_all().random(3).tolist(), seeds.seed_all().random(3).tolist()
    assert a == b and seeds.named("x") != seeds.named("y") and 0 <= seeds.named("x") < 1 << 63


def test_recalls(spark):
    from pairloom.operators import evaluation as E

    t = spark.createDataFrame([(1, "CHIN", "c", 0, 100, 50.0), (2, "CHIN", "c", 300, 400, 350.0), (3, "CHID", "d", 0, 10, 5.0)], "structure long, type string, chrom string, s_start long, s_end long, s_center double")
    w = spark.createDataFrame([("m", "c", 50, 60), ("m", "c", 55, 310), ("n", "c", 390, 500), ("o", "d", 50, 60)], "k string, chrom string, w_start long, w_end long")
    got = {r["k"]: r for r in E.comparison(w, t, ["k"], 64).collect()}
    assert (got["m"]["n"], got["m"]["union_bp"], got["m"]["CHIN_recall"], got["m"]["CHIN_overlap_recall"]) == (2, 260, 0.5, 1.0)
    assert got["n"]["recall"] == 0 and got["n"]["overlap_recall"] == pytest.approx(1 / 3) and got["o"]["overlap_recall"] == 0 and got["m"]["OPCID_recall"] == 0
