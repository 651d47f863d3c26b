"""Catalog and file round trips."""

import os
import tempfile

import pytest

from meterwise.operators.selection import feature_names, filter_by_mi
from meterwise.operators.profile import mi_ranking
from meterwise.sources import io


def test_catalog_rules(spark):
    d = tempfile.mkdtemp(prefix="mw-io-")
    p = os.path.join(d, "client.csv")
    with open(p, "w") as f:
        f.write("client_id,disrict,region,client_catg,creation_date,target\n1,5,1,11,2010-01-01,1\n")
    e = os.path.join(d, "empty.csv")
    open(e, "w").close()
    cat = io.Catalog(spark, [p, p, e], target_column="target",
                     schemas={"client": "client_id string, disrict int, region int, client_catg int, "
                                        "creation_date string, target int"})
    assert len(cat) == 2
    assert cat[p].count() == 1 and cat[e].count() == 0
    assert cat.target.first().target == 1
    with pytest.raises(FileNotFoundError):
        io.Catalog(spark, [os.path.join(d, "missing.csv")])


def test_mi_file_round_trip_and_filter(spark):
    scores = spark.createDataFrame([("a", 0.01), ("b", 0.0001), ("c", 0.002), ("d", 0.2)], "Feature string, MI_Score double")
    path = io.write_mi_ranking(mi_ranking(scores), os.path.join(tempfile.mkdtemp(prefix="mw-mi-"), "mi.csv"))
    back = io.read_mi_ranking(spark, path)
    assert feature_names(filter_by_mi(back, 0.0005, 0.05)) in (["a", "c"], ["c", "a"])
    ranked = mi_ranking(back)
    assert feature_names(filter_by_mi(ranked, 0.0005, 0.05)) == ["a", "c"]


def test_score_export_format(spark):
    df = spark.createDataFrame([(1, 0.558), (2, None)], "client_id long, target double")
    out = {r.client_id: r.target for r in io.format_scores(df).collect()}
    assert out == {1: "%.16f" % 0.558, 2: None}
    assert io.score_file_name("SMOTE", 0.5484) == "fraud_predictions_SMOTE_thr0.548.csv"
