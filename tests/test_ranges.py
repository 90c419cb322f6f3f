"""Range-partitioned ranks, sums and quantiles, held against plain versions, and that their plans have no one-task window."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import ranges as R
from pairloom.operators import selection as S
from pairloom.operators import stats


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    return [(i, rnd.choice("ab"), float(rnd.choice([0, 0, 0, 1, 2, round(rnd.gauss(0, 3), 2)])), rnd.random() < 0.4) for i in range(700)] + [(9000, "c", 5.0, True)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double, cal boolean").repartition(5)


def test_ranks(df, rows):
    got = S.ranked(df, [F.desc("v"), F.col("id")], by=-F.col("v"))
    assert got.columns == ["id", "k", "v", "cal", "rank", "percentile"]
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["id"]: (r["rank"], round(r["percentile"], 9)) for r in got.collect()} == {r[0]: (n + 1, round(1 - n / len(rows), 9)) for n, r in enumerate(order)}
    own = S.ranked(df, [F.desc("v"), F.col("id")], ["k"], by=-F.col("v")).collect()
    for k in "abc":
        assert [r["id"] for r in sorted((r for r in own if r["k"] == k), key=lambda r: r["rank"])] == [r[0] for r in order if r[1] == k]


def test_tails_and_running_sums(df, rows):
    got = {r["id"]: r["p"] for r in stats.tail_p_within(df, "v", F.col("cal"), ["k"]).collect()}
    for i, k, v, _ in rows:
        cal = [r[2] for r in rows if r[1] == k and r[3]]
        assert got[i] == pytest.approx((1 + sum(c >= v for c in cal)) / (len(cal) + 1))
    run = {r["id"]: (r["s"], r["all_s"]) for r in R.running_sums(df, "v", {"s": "id"}).collect()}
    assert all(run[i] == (sum(r[0] for r in rows if r[2] <= v), sum(r[0] for r in rows)) for i, _, v, _ in rows)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.93, 1.0])
def test_quantiles(df, rows, share):
    got = {r["k"]: r["q"] for r in R.quantile(df, "v", share, ["k"], "q").collect()}
    assert all(got[k] == pytest.approx(np.quantile([r[2] for r in rows if r[1] == k], share)) for k in "abc")
    assert R.quantile(df, "v", share).first()[0] == pytest.approx(np.quantile([r[2] for r in rows], share))


def test_wide_correlations_and_auc(df, rows):
    two = df.withColumn("w", F.col("v") * 2 + F.col("id") % 5)
    plain, wide = ({r["k"]: (r["n"], r["pearson"], r["spearman"]) for r in stats.correlations(two, "v", "w", ["k"], x).collect()} for x in (False, True))
    assert plain.keys() == wide.keys() and all(wide[k] == pytest.approx(plain[k]) for k in "ab")
    pos, neg = ([r[2] for r in rows if r[3] == x] for x in (True, False))
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert stats.auc(df.withColumn("y", F.col("cal").cast("int")), "y", "v").first()["roc_auc"] == pytest.approx(want)


def test_empty(df):
    none = df.limit(0)
    assert S.ranked(none, [F.col("id")], by=F.col("v")).count() == 0 and R.quantile(none, "v", 0.5, ["k"]).count() == 0
    assert stats.tail_p_within(none, "v", F.col("cal"), ["k"]).count() == 0


@pytest.mark.parametrize("name", ["wf01_rank_percentile", "tk03_top_fraction", "sc05_window_scores", "sc06_tail_probability", "ag15_scale_contribution", "st08_auc", "jn11_best_overlap", "tk10_coverage_curve"])
def test_no_plan_has_one_window_over_all_rows(spark, name):
    from pyspark.sql import Window as W

    from pairloom.plans import catalog

    one = spark.range(9).withColumn("r", F.row_number().over(W.orderBy("id")))
    physical = lambda q: q._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in physical(one)
    plan = physical(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    for below in re.findall(r"Window \[(?:.*\n){1,6}", plan):
        assert "SinglePartition" not in below, below


def test_six_decimals_as_in_sql(spark):
    """Nine decimals that end in 5 at the seventh, which both sides meet as the same double."""
    import duckdb
    from pairloom.plans import fixtures as X

    rnd = random.Random(8)
    xs = [0.5153165, -0.5153165, 2.5e-6, 0.0, -0.0, 1e300, float("inf"), float("-inf")] + [round(rnd.gauss(0, 10**k), 6) + s * 5e-7 for k in range(4) for s in (-1, 1) for _ in range(100)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(X.r6("x")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    assert spark.range(1).select(X.r6(F.lit(float("nan"))), X.r6(F.lit(None).cast("double"))).first() == (None, None)


def test_quartiles_of_few_decimals_as_in_sql(spark):
    """Interquartile ranges of six-decimal values end in a 5 at the seventh now and then; to six decimals they are the SQL's."""
    import duckdb
    import pandas as pd
    from pairloom.plans import fixtures as X

    rnd = random.Random(5)
    t = pd.DataFrame([(g, round(rnd.gauss(0.01, 0.03), 6)) for g in range(600) for _ in range(rnd.randrange(2, 60))], columns=["g", "v"])
    q = R.quantiles(spark.createDataFrame(t), "v", {"q1": 0.25, "q3": 0.75}, ["g"]).select("g", X.r6("q1"), X.r6("q3"), X.r6(F.col("q3") - F.col("q1")))
    want = duckdb.sql("SELECT g, round(quantile_cont(v, 0.25), 6), round(quantile_cont(v, 0.75), 6), round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) FROM t GROUP BY 1").fetchall()
    assert sorted(tuple(r) for r in q.collect()) == sorted(want)
