"""Ordinary but awkward inputs: constant columns, swapped headers, URIs, near-equal points, five folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.operators import models as L
from meterwise.operators import profile as D
from meterwise.operators import synthetic as S
from meterwise.operators.neighbors import knn
from meterwise.sources.io import Catalog, read_table


def test_correlation_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5), (None, 5.0, 1.0)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.corr for r in D.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and got["a", "a"] == 1.0
    assert got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


def test_value_counts_leaves_null_out(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert [tuple(r) for r in D.value_counts(df, "x").collect()] == [(1, 2)]
    assert len(D.value_counts(df, "x", dropna=False).collect()) == 2


def test_csv_is_bound_by_header_and_uris_are_kept(spark, tmp_path):
    (tmp_path / "client.csv").write_text("client_id,disrict\n60,7\n")
    uri = f"file://{tmp_path}/client.csv"
    schema = "disrict int, client_id string, target int"
    df = read_table(spark, uri, schema)
    assert df.columns == ["disrict", "client_id"] and tuple(df.first()) == (7, "60")
    cat = Catalog(spark, [uri], schemas={"client": schema})
    assert list(cat) == [uri] and cat[uri].count() == 1
    with pytest.raises(FileNotFoundError):
        Catalog(spark, [f"file://{tmp_path}/none.csv"])


@pytest.mark.parametrize("kind", ["collinear", "offset", "near"])
def test_knn_is_complete(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "near":
        x = np.repeat(rng.normal(0, 1, (12, 2)), 8, axis=0) + rng.normal(0, 1e-9, (96, 2))
    else:
        t = rng.normal(0, 1, 120)
        x = np.stack([t * 0.3, t * 0.7], axis=1) + (1e6 if kind == "offset" else 0)
    pts = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "rid long, vec array<double>")
    got = knn(pts, pts.withColumnRenamed("rid", "qid"), 3)
    n = {r.qid: r.n for r in got.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {i: 3 for i in range(len(x))}


def test_adasyn_without_border_is_a_clear_error(spark):
    rows = [(str(i), 0, [float(i), 0.0]) for i in range(12)] + [(str(100 + i), 1, [1000.0 + i, 0.0]) for i in range(6)]
    with pytest.raises(ValueError, match="adasyn"):
        S.adasyn(spark.createDataFrame(rows, "key string, label int, vec array<double>"), k=3)


def test_random_search_takes_five_folds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 5, int(v > 0), float(v), float(rng.normal())) for i, v in enumerate(rng.normal(size=60))]
    d = L.assemble(spark.createDataFrame(rows, "client_id long, fold int, target int, a double, b double"), ["a", "b"])
    cvm = L.random_search(d, L.gbt(n_estimators=2, max_depth=2), [{"n_estimators": 2}], parallelism=1)
    assert len(cvm.avgMetrics) == 1 and cvm.getNumFolds() == 5
