"""M1 against a brute-force evaluation of the same estimator."""

import math
import random

import pytest

from meterwise.functions.columns import digamma_py
from meterwise.operators.selection import knn_points, mi_knn


def brute(points, k=3):
    by_f = {}
    for f, y, x in points:
        by_f.setdefault(f, []).append((y, x))
    out = {}
    for f, rows in by_f.items():
        labels = {}
        for y, _ in rows:
            labels[y] = labels.get(y, 0) + 1
        rows = [(y, x) for y, x in rows if labels[y] > 1]
        n = len(rows)
        acc_k = acc_y = acc_m = 0.0
        for i, (y, x) in enumerate(rows):
            same = sorted(abs(x2 - x) for j, (y2, x2) in enumerate(rows) if y2 == y and j != i)
            ki = min(k, labels[y] - 1)
            r = same[ki - 1]
            if r > 0:
                m = sum(1 for _, x2 in rows if abs(x2 - x) < r)
            else:
                m = sum(1 for _, x2 in rows if x2 == x)
            acc_k += digamma_py(ki)
            acc_y += digamma_py(labels[y])
            acc_m += digamma_py(m)
        out[f] = max(0.0, digamma_py(n) + (acc_k - acc_y - acc_m) / n)
    return out


@pytest.fixture
def frame(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        y = 1 if rnd.random() < 0.25 else 0
        rows.append((i, y, y * 2.0 + rnd.gauss(0, 1),          # informative
                     float(rnd.randint(0, 3)),                  # ties everywhere
                     rnd.random(),                              # noise
                     None if i % 5 == 0 else float(y)))         # NULL → 0
    return spark.createDataFrame(rows, "client_id long, target int, a double, b double, c double, d double")


def test_mi_knn_equals_brute_force(frame):
    feats = ["a", "b", "c", "d"]
    pts = [(r.feature, r.y, r.x) for r in knn_points(frame, feats).collect()]
    exp = brute(pts)
    got = {r.Feature: r.MI_Score for r in mi_knn(frame, features=feats).collect()}
    for f in feats:
        assert got[f] == pytest.approx(exp[f], abs=1e-9), f
    assert got["a"] > 0.1 and got["c"] < 0.05 and all(v >= 0 for v in got.values())
    assert not math.isnan(got["b"])
