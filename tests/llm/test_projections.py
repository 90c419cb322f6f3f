"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import projections as P

SCHEMA = "vec_id long, embedding array<double>, c long, label int"


def brute(rows, similar=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    ok = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e) for _, e in rows]
    unit = [np.array(e, dtype=float) / np.abs(e).max() if k else None for (_, e), k in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= similar] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, e, 7, 1) for d, e in rows], SCHEMA)
    return sorted(map(tuple, P.near_vectors(df, **options).collect()), key=repr)


def planted(n, groups, dim, seed, noise=0.12):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for size in groups:
        base = rng.normal(size=dim)
        rows += [base + noise * rng.normal(size=dim) * rng.uniform(0.2, 2) for _ in range(size)]
    return [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(rows)), rows)]


def test_equals_all_pairs_with_odd_rows(spark):
    rows = planted(150, [2, 2, 3, 40], 16, 1)
    e = rows[0][1]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15), (None, e), (None, [-x for x in e]), (None, [2 * x for x in e])]
    same = [(910, rows[3][1]), (911, rows[3][1]), (911, rows[3][1]), (912, [1e300 * x for x in e]), (913, [1e-300 * x for x in e]), (914, e[:8]), (915, e[:8]), (916, [-0.0 if x == 0 else x for x in e])]
    assert run(spark, rows + odd + same) == brute(rows + odd + same)


def test_chains_and_tiny_windows(spark):
    """Neighbours in a ring each link with the next only; windows of 8 and blocks of 32 leave it to many passes to join them."""
    ring = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(np.arange(40) * 0.157)]
    rows = ring + [(100 + i, [0.0, 0.0, x]) for i, x in enumerate((1.0, -1.0))]
    assert run(spark, rows, window=8, block=32, similar=0.98, passes=12) == brute(rows, 0.98)


def test_groups_over_the_window_keep_every_link(spark):
    rows = planted(200, [150, 90, 5], 24, 2, noise=0.1)
    assert run(spark, rows, window=16, block=64, passes=8) == brute(rows)


def test_recall_of_single_pairs_at_the_threshold(spark):
    """Pairs with a cosine just above the threshold, among vectors that fill the windows many times over."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1)[:, None]
    df = spark.createDataFrame([(2 * i + k, x.tolist()) for i, p in enumerate(zip(a, b)) for k, x in enumerate(p)], "vec_id long, embedding array<double>")
    found = P.near_vectors(df, window=32, block=128).agg(F.sum("n_links")).first()[0] / 2
    assert found >= 0.999 * len(a)


def test_empty_table_and_floats(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    assert sorted(map(tuple, P.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_agreement_and_labels():
    assert P.agreement(1.0) == 1 and 0.55 < P.agreement(0.95) < 0.65
    label = np.arange(6)
    P.united(label, np.array([4, 2, 5]), np.array([2, 0, 3]))
    assert label.tolist() == [0, 1, 0, 3, 0, 3]


@pytest.mark.parametrize("cut", [1, 3, 100])
def test_runs_cross_batches(cut):
    import pyarrow as pa

    t = pa.table({"k": [1, 1, 1, 2, 3, 3, 3, 3], "v": range(8)})
    assert [r.column("v").to_pylist() for r in P.runs(t.to_batches(max_chunksize=cut), ["k"])] == [[0, 1, 2], [3], [4, 5, 6, 7]]
