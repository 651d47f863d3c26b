"""Properties of the distributed helpers, sampling and metrics (against
brute force on small inputs)."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwise.functions.columns import digamma, digamma_py
from meterwise.functions.prefix import exact_quantiles, running_sums
from meterwise.operators import metrics as E
from meterwise.operators import sampling as R
from meterwise.operators.joins import row_positions


def test_running_sums_equal_window(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.randint(0, 9)) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x int, v long").repartition(7)
    got = {(r.g, r.x): r.cum_v for r in running_sums(df, ["g"], ["x"], ["v"], num_blocks=5).collect()}
    w = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    exp = {(r.g, r.x): r.c for r in df.select("g", "x", F.sum("v").over(w).alias("c")).collect()}
    assert got == exp


def test_running_sums_plan_holds_no_blocks(spark):
    df = spark.range(2280).select((F.col("id") % 114).alias("g"), F.col("id").alias("x"), F.lit(1).alias("v"))
    sizes = [len(running_sums(df, ["g"], ["x"], ["v"], num_blocks=n)._jdf.queryExecution().optimizedPlan().toString())
             for n in (4, 120)]
    assert abs(sizes[0] - sizes[1]) < 200


def test_running_sums_split_a_frequent_value(spark):
    df = spark.range(1000).select(F.lit(7.0).alias("x"), "id", F.lit(1).alias("v")).repartition(5)
    out = running_sums(df, [], ["x", "id"], ["v"], num_blocks=6).collect()
    assert {r.id: r.cum_v for r in out} == {i: i + 1 for i in range(1000)}


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(2)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5, 7.0, 10.0]) * rnd.random() for _ in range(301)]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, x double")
    q = {r.p: r.q for r in exact_quantiles(df, "g", "x", [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert q[p] == pytest.approx(float(np.quantile(vals, p)))


def test_row_positions_are_a_permutation(spark):
    df = spark.range(0, 1000, 3).repartition(4)
    pos = sorted(r.row_pos for r in row_positions(df, "id").collect())
    assert pos == list(range(1, df.count() + 1))
    first = row_positions(df, "id").filter("row_pos = 1").first()
    assert first.id == 0


def test_digamma(spark):
    for x in [1, 2, 3, 7, 10, 123, 1e6]:
        got = spark.range(1).select(digamma(F.lit(float(x))).alias("d")).first().d
        assert got == pytest.approx(digamma_py(x), abs=1e-12)
    assert digamma_py(1) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert digamma_py(2) == pytest.approx(1 - 0.5772156649015329, abs=1e-13)


def _labels(spark, n=500, pos_every=7):
    return spark.createDataFrame([(i, 1 if i % pos_every == 0 else 0) for i in range(n)], "client_id long, target int")


def test_folds_disjoint_exhaustive_stratified(spark):
    df = _labels(spark)
    f = R.stratified_folds(df, k=5, seed=42).collect()
    assert len(f) == 500 and len({r.client_id for r in f}) == 500
    for t in (0, 1):
        sizes = [sum(1 for r in f if r.target == t and r.fold == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_ordered_folds_contiguous(spark):
    df = _labels(spark, 23, 3)
    f = sorted(R.ordered_folds(df, k=5).collect(), key=lambda r: r.client_id)
    for t in (0, 1):
        folds = [r.fold for r in f if r.target == t]
        assert folds == sorted(folds)
    assert {r.fold for r in f} == set(range(5))


def test_split_sizes(spark):
    df = _labels(spark)
    s = R.stratified_split(df, test_size=0.3).collect()
    for t in (0, 1):
        n = sum(1 for r in s if r.target == t)
        assert sum(r.is_test for r in s if r.target == t) == round(n * 0.3)


def test_oversample_balances(spark):
    df = _labels(spark)
    o = R.random_oversample(df).groupBy("target").count().collect()
    counts = {r.target: r["count"] for r in o}
    assert counts[0] == counts[1]


def test_bags_balanced(spark):
    df = _labels(spark)
    b = R.balanced_bags(df, n_bags=3).groupBy("bag", "target").count().collect()
    for bag in range(3):
        c = {r.target: r["count"] for r in b if r.bag == bag}
        assert c[0] == c[1]


def _brute_curve(y, s):
    th = sorted(set(s))
    out = []
    P = sum(y)
    for t in th:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / P
        out.append((t, prec, rec, 2 * prec * rec / (prec + rec + 1e-10)))
    return out


def test_curves_against_brute_force(spark):
    rnd = random.Random(3)
    y = [1 if rnd.random() < 0.3 else 0 for _ in range(300)]
    s = [round(rnd.random() * (0.6 + 0.4 * t), 2) for t in y]  # ties on purpose
    df = spark.createDataFrame(list(zip(y, s)), "target int, score double")
    curve = _brute_curve(y, s)
    best = max(curve, key=lambda r: (r[3], -r[0]))
    got = E.best_threshold(df).first()
    assert got.threshold == pytest.approx(best[0]) and got.f1 == pytest.approx(best[3])
    # AUC: probability a positive outranks a negative (ties count half)
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first().roc_auc == pytest.approx(auc)
    # AP: step sum over distinct thresholds, descending
    ap, prev_r = 0.0, 0.0
    for t, p, r, _ in sorted(curve, key=lambda x: -x[0]):
        ap += (r - prev_r) * p
        prev_r = r
    assert E.average_precision(df).first().average_precision == pytest.approx(ap)


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "target int, prediction int, score double")
    m = E.binary_metrics(df).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0 and m.mcc == 0.0 and m.accuracy == 1.0
