"""Findings of round 4."""

import threading
import time
from types import SimpleNamespace


def test_package_is_shipped_once_by_jobs_side_by_side():
    """A cluster's file server refuses a second file of one name, which failed all but one of the jobs."""
    from meterwise import session
    shipped = []

    class Context:
        applicationId = f"app-{time.time()}"

        def addPyFile(self, path):
            time.sleep(0.05)
            shipped.append(path)

    spark = SimpleNamespace(sparkContext=Context())
    threads = [threading.Thread(target=session.ship, args=(spark,)) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(shipped) == 1


def _rows(spark, n=700):
    import random

    from meterwise.operators import models as L
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.3), rnd.gauss(0, 1), float(rnd.randint(0, 4)), rnd.random() ** 3, 1.0) for i in range(n)]
    rows = [(i, y, a + y, b, c * (1 + y), d, rnd.uniform(0.5, 2.0), i % 5) for i, y, a, b, c, d in rows]
    df = spark.createDataFrame(rows, "client_id long, target int, a double, b double, c double, d double, weight double, fold int")
    rows = L.assemble(df, ["a", "b", "c", "d"]).coalesce(1)
    return rows.filter("fold > 0"), rows.filter("fold = 0")


def test_fit_in_one_task_equals_spark_ml(spark):
    """A fit was a chain of jobs over the cluster; one task now makes the same trees (splits of equal gain,
    as integer targets make them in deep nodes, may differ by rounding; drawn weights have none)."""
    from meterwise.operators import boosting as B
    from meterwise.operators import models as L
    train, held = _rows(spark)
    again = train.unionByName(train.filter("target = 1"))  # rows that occur twice
    assert B.fits_in_task(again)
    for rows, weight, params in ((train, None, {"n_estimators": 6, "max_depth": 4, "learning_rate": 0.2}),
                                 (again, None, {"n_estimators": 4, "max_depth": 4, "min_child_weight": 7}),
                                 (again, "weight", {"n_estimators": 4, "max_depth": 5, "min_child_weight": 6}),
                                 (train, "weight", {"n_estimators": 4, "max_depth": 3, "min_child_weight": 30}),
                                 (again, None, {"n_estimators": 5, "max_depth": 4, "gamma": 0.02}),
                                 (train, None, {"n_estimators": 3, "max_depth": 2, "gamma": 3.0})):
        est = L.gbt(weight_col=weight, **params)
        want = L.positive_probability(est.fit(rows).transform(held)).select("target", "score", "prediction").collect()
        got = B.scored(est, rows, held).collect()
        assert len(got) == len(want) == 140
        for g, w in zip(got, want):
            assert (g.target, g.prediction) == (w.target, w.prediction) and abs(g.score - w.score) < 1e-9, params


def test_fit_in_one_task_draws_rows_and_features(spark):
    from meterwise.operators import boosting as B
    from meterwise.operators import models as L
    train, held = _rows(spark)
    est = L.gbt(n_estimators=30, max_depth=3, learning_rate=0.1, subsample=0.6, colsample_bytree=0.5)
    assert est.getFeatureSubsetStrategy() == "0.5"

    def log_loss(rows):
        import math
        return -sum(math.log(r.score if r.target else 1 - r.score) for r in rows) / len(rows)

    got = B.scored(est, train, held).collect()
    assert got == B.scored(est, train, held).collect()
    whole = B.scored(L.gbt(n_estimators=30, max_depth=3, learning_rate=0.1), train, held).collect()
    spark_ml = L.positive_probability(est.fit(train).transform(held)).collect()
    assert abs(log_loss(got) - log_loss(spark_ml)) < 0.05 and got != whole


def test_search_runs_small_fits_in_tasks_and_large_ones_on_spark_ml(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from meterwise.operators import boosting as B
    from meterwise.operators import models as L
    from meterwise.operators import strategies as C
    train, held = _rows(spark, 200)
    data = train.unionByName(held).select("client_id", "target", "fold", "features")
    fits = []
    plain = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: (fits.append(1), plain(self, rows))[1])
    draws = [{"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}]
    small = C.search(C.FoldStore(data, {"none": None}, f"{tmp_path}/a"), draws, lambda s, d: L.gbt(**d))
    assert not fits
    monkeypatch.setattr(B, "TASK_CELLS", 100)
    large = C.search(C.FoldStore(data, {"none": None}, f"{tmp_path}/b"), draws, lambda s, d: L.gbt(**d))
    assert len(fits) == 5 and abs(small["none"][0] - large["none"][0]) < 1e-9


def _mi_rows(spark, n=400):
    import random
    rnd = random.Random(11)
    rows = [(i % (n - 20), int(rnd.random() < 0.2) if i > 2 else 5, rnd.gauss(0, 1), float(rnd.randint(0, 2)), 4.0) for i in range(n)]  # ids and labels that hardly occur twice
    return spark.createDataFrame(rows, "client_id long, target int, a double, b double, c double")


def test_mi_knn_blocks_equal_brute_force(spark, monkeypatch):
    """Points at the ends of blocks, a label of three rows, ids that occur twice: r and m as by brute force."""
    from meterwise.operators import selection
    df = _mi_rows(spark)
    monkeypatch.setattr(selection, "RUN", 40)
    got = selection.knn_point_stats(df, features=["a", "b", "c"]).collect()
    assert len(got) == 3 * 400 and len({g.id for g in got}) == 380
    want = []
    for p in got:
        same = sorted(abs(q.x - p.x) for q in got if q.feature == p.feature and q.y == p.y)[1:]
        r = same[min(3, len(same)) - 1]
        near = [q for q in got if q.feature == p.feature and (abs(q.x - p.x) < r or r == 0 and q.x == p.x)]
        want.append((p.feature, p.id, p.y, p.x, r, len(near)))
    assert sorted((g.feature, g.id, g.y, g.x, g.r, g.m) for g in got) == sorted(want)


def test_mi_knn_shuffles_its_points_once(spark, monkeypatch):
    """Before: points, ranks, runs, events (three rows a point) and counts each went through a shuffle."""
    from meterwise.operators import selection
    frame = type(spark.range(0))
    dealt, plain = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: (dealt.append(a), plain(self, *a))[1])
    stats = selection.knn_point_stats(_mi_rows(spark), features=["a", "b", "c"])
    plan = stats._jdf.queryExecution().sparkPlan().toString()
    assert len(dealt) == 1 and "SortMergeJoin" not in plan and "Window" not in plan


def test_equal_vectors_are_found_by_their_hash_first(spark):
    """Sorts and joins by whole vectors took most of smote_tomek's search; equal hashes of different vectors still count as different."""
    from pyspark.sql import functions as F

    from meterwise.operators import neighbors
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(100)]
    sites = neighbors._sites(spark.createDataFrame(rows, "rid long, rvec array<double>"), 3)
    plan = sites._jdf.queryExecution().sparkPlan().toString()
    assert "hash" in plan and plan.index("Window") > 0 and "[hash#" in plan[plan.index("Window"):]
    want = {}
    for i, v in rows:
        want.setdefault(tuple(v), []).append(i)
    assert {tuple(r.rvec): r.ids for r in sites.collect()} == {v: ids[:3] for v, ids in want.items()}
    plain, neighbors.F.xxhash64 = F.xxhash64, lambda *c: F.lit(1).cast("long")
    try:
        sites = neighbors._sites(spark.createDataFrame(rows, "rid long, rvec array<double>"), 3)
        assert {tuple(r.rvec): r.ids for r in sites.collect()} == {v: ids[:3] for v, ids in want.items()}
    finally:
        neighbors.F.xxhash64 = plain
