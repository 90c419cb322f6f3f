"""Statistics over masks from sparse cells, held against dense NumPy matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import contacts as K
from pairloom.operators import masked as M
from pairloom.operators.ranges import quantiles

N = 9
UP = [(i, j) for i in range(N) for j in range(i, N)]


def average_ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    return np.array([out[v == x].mean() for x in v])


def correlations(a, b):
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None, None
    return np.corrcoef(a, b)[0, 1], np.corrcoef(average_ranks(a), average_ranks(b))[0, 1]


@pytest.fixture(scope="module")
def maps():
    """Windows with upper triangles of two replicates: empty, full, constant, sparse, negative, one-sided."""
    rng = np.random.default_rng(6)
    out = {}
    for w, density in enumerate([0, 0.05, 0.1, 0.3, 0.6, 0.9, 1.0, 1.0]):
        a, b = (np.triu(rng.integers(1, 5, (N, N)) * (rng.random((N, N)) < density)).astype(float) for _ in range(2))
        out[w] = (a, b)
    out[8] = (np.triu(np.full((N, N), 3.0)), out[4][1])
    out[9] = (np.triu(rng.normal(size=(N, N)).round(1) * (rng.random((N, N)) < 0.5)), np.triu(rng.normal(size=(N, N)).round(1)))
    out[10] = (out[3][0], np.zeros((N, N)))
    return out


@pytest.fixture(scope="module")
def pairs(spark, maps):
    rows = [(w, i, j, j - i, float(a[i, j]), float(b[i, j]), N) for w, (a, b) in maps.items() for i, j in UP if a[i, j] or b[i, j]]
    return spark.createDataFrame(rows, "w int, i int, j int, d int, a double, b double, n int").cache()


@pytest.fixture(scope="module")
def cells(pairs):
    return pairs.where("a <> 0").withColumnRenamed("a", "value").drop("b").cache()


def band(m, gap):
    return np.array([m[i, j] for i, j in UP if j - i > gap])


def whole(m):
    return (m + m.T - np.diag(np.diag(m))).ravel()


def same(a, b):
    return a is None and b is None or a is not None and b is not None and np.isclose(a, b, atol=1e-9)


def test_mask_correlations(spark, pairs, maps):
    sizes = spark.createDataFrame([(w,) for w in maps], "w int")
    got = {(r["w"], r["mask"]): r for r in M.mask_correlations(pairs, sizes, ["w"], N).collect()}
    assert len(got) == 3 * len(maps)
    for w, (a, b) in maps.items():
        for mask, gap in (("upper", -1), ("offdiag", 0), ("exclude_band2", 2)):
            x, y, r = band(a, gap), band(b, gap), got[w, mask]
            assert r["n"] == len(x)
            for mine, theirs in zip((r["pearson"], r["spearman"]), correlations(x, y)):
                assert same(mine, theirs), (w, mask, mine, theirs)


def test_measure_pairs(spark, pairs, maps):
    """Cells at a distance of 5 are not defined."""
    ok = [(i, j) for i, j in UP if j - i != 5]
    total = sum(j - i > 2 for i, j in UP)
    inner, outer = ([(i, j) for i, j in ok if j - i > g] for g in (2, 0))
    sizes = spark.createDataFrame([(w, len(inner), len(outer), total) for w in maps] + [(99, 4, 8, total)], "w int, m long, m_full long, total long")
    got = {r["w"]: r for r in M.measure_pairs(pairs.where("d > 0 AND d <> 5"), sizes, ["w"]).collect()}
    assert got[99]["reason"] == "too_few_valid_pixels" and got[99]["pearson"] is None
    for w, (a, b) in maps.items():
        x, y = (np.array([m[c] for c in inner]) for m in (a, b))
        fx, fy = (np.array([m[c] for c in outer]) for m in (a, b))
        r, p = got[w], np.concatenate([x, y])
        assert same(r["pearson"], correlations(x, y)[0]) and same(r["spearman"], correlations(x, y)[1])
        assert same(r["full_pearson"], correlations(fx, fy)[0]) and same(r["full_spearman"], correlations(fx, fy)[1])
        norms = np.linalg.norm(x) * np.linalg.norm(y)
        assert same(r["cosine"], x @ y / norms if norms else None)
        iqr = np.percentile(p, 75) - np.percentile(p, 25)
        assert same(r["iqr"], iqr) and np.isclose(r["nrmse"], np.sqrt(np.mean((x - y) ** 2)) / (iqr + 1e-12))
        assert np.isclose(r["finite_fraction"], len(inner) / total) and r["n"] == len(inner)
        assert r["reason"] == ("zero_variance" if np.ptp(x) == 0 or np.ptp(y) == 0 else "valid")


def test_features_of_whole_and_masked_matrices(cells, maps):
    whole_, mask = ({r["w"]: r for r in f(cells, ["w"], F.col("n")).collect()} for f in (K.intensity_features, K.density_features))
    for w in whole_:
        v, u = whole(maps[w][0]), band(maps[w][0], 2)
        assert np.allclose([whole_[w][c] for c in ("mean", "std", "max", "total", "median", "p95")], [v.mean(), v.std(), v.max(), v.sum(), np.median(v), np.percentile(v, 95)])
        assert np.allclose([mask[w][f"density_{c}"] for c in ("mean", "std", "p95", "total")], [u.mean(), u.std(), np.percentile(u, 95), u.sum()])
    assert set(whole_) == {w for w, (a, _) in maps.items() if a.any()}


def test_clip_minmax_and_shape(cells, maps):
    clip, scaled = ({(r["w"], r["i"], r["j"]): r for r in f.collect()} for f in (K.percentile_clip(cells, ["w"], F.col("n"), 0.9), K.minmax(cells, ["w"], F.col("n"))))
    shape = {(r["w"], r["i"], r["j"]): r for r in K.robust_shape(cells, ["w"], F.col("n"), 3.5, "value").collect()}
    for (w, i, j), r in clip.items():
        m, v = maps[w][0], whole(maps[w][0])
        assert np.isclose(r["clipped"], min(m[i, j], np.percentile(v, 90)))
        span = v.max() - v.min()
        assert np.isclose(scaled[w, i, j]["scaled"], (m[i, j] - v.min()) / span if span else 0)
        assert np.isclose(scaled[w, i, j]["zero_scaled"], (0 - v.min()) / span if span else 0)
        x = np.log1p(np.clip(m, 0, 3.5))
        u = band(x, 2)
        med, mad = np.median(u), np.median(np.abs(u - np.median(u)))
        scale = 1.0 if mad <= 1e-8 else 1.4826 * mad + 1e-8
        assert np.isclose(shape[w, i, j]["shape"], np.clip((x[i, j] - med) / scale, -10, 10)) and np.isclose(shape[w, i, j]["zero_shape"], np.clip(-med / scale, -10, 10))


def test_reconstruction_error(spark, cells, maps):
    own = cells.withColumn("per", F.lit("p")).withColumnRenamed("value", "oe")
    model = K.distance_model(own, ["per"], spark.createDataFrame([("p", len(maps))], "per string, windows int"), N)
    got = {r["w"]: r for r in K.reconstruction_error(own, ["w"], model, ["per"], N).collect()}
    mean = {d: np.mean([a[i, j] for a, _ in maps.values() for i, j in UP if j - i == d]) for d in range(N)}
    for w, r in got.items():
        off = np.array([[(maps[w][0][i, j] - mean[j - i]) ** 2, j - i] for i, j in UP])
        assert np.isclose(r["error"], off[off[:, 1] > 2, 0].mean()) and np.isclose(r["all_error"], off[:, 0].mean())


def test_quantiles_by_keys_with_zeros(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x)) for k, n in (("a", 1000), ("b", 7), ("c", 1)) for x in rng.normal(size=n).round(1)] + [("a", None), ("b", float("nan"))]
    zeros = {"a": 300, "b": 0, "d": 5}
    shares = {"low": 0.0, "q": 0.05, "m": 0.5, "t": 0.995, "top": 1.0}
    z = spark.createDataFrame(list(zeros.items()), "k string, zeros long")
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, ["k"], z).collect()}
    assert set(got) == set("abcd")
    for k, r in got.items():
        v = [x for j, x in rows if j == k and x is not None and x == x] + [0.0] * zeros.get(k, 0)
        assert np.allclose([r[n] for n in shares], np.percentile(v, [100 * q for q in shares.values()]))
    every = quantiles(spark.createDataFrame(rows, "k string, v double"), "v", {"m": 0.3}).first()["m"]
    assert np.isclose(every, np.percentile([x for _, x in rows if x is not None and x == x], 30))
    assert quantiles(spark.createDataFrame([], "k string, v double"), "v", shares, ["k"]).count() == 0
