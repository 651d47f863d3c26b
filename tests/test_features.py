"""Hand cases for the feature rules (one test per rule)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import inv
from meterwise.operators import client_features as A
from meterwise.operators.projections import add_combinations, combine_features
from meterwise.plans import assemble


def row(df, cid):
    rows = [r.asDict() for r in df.filter(F.col("client_id") == cid).collect()]
    assert len(rows) == 1, rows
    return rows[0]


def test_client_without_invoices(make):
    c, i = make([(1, 5, 1, 11, 0), (2, 5, 1, 11, 1)], [inv(2)])
    r = row(assemble.features_train(c, i), 1)
    assert r["f_counter_statue_error_occured"] == 1
    assert r["f_counter_regions"] == 0
    for k in ["f_invoive_date_diff_days", "consommation_level_1_mean", "tarif_type", "f_counter_statue_mean",
              "f_client_tenure_days", "f_counter_number_nunique", "avg_consumption_per_month",
              "remarque_frequency", "faulty_status_rate", "f_index_cons_error_sum"]:
        assert r[k] is None, k
    # region features come from the region, not from the client's invoices
    assert r["f_t_region_fraud_rate"] == pytest.approx(0.5)


def test_null_status_is_error_and_faulty_rate_null(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1, status=None)])
    r = row(assemble.features_train(c, i), 1)
    assert r["f_counter_statue_error_occured"] == 1
    assert r["faulty_status_rate"] is None


def test_single_invoice(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1, levels=(3.0, 1.0, 0.0, 0.0))])
    r = row(assemble.features_train(c, i), 1)
    assert r["f_invoive_date_diff_days"] is None
    assert r["consommation_level_1_std"] is None
    assert r["consommation_level_1_min"] == r["consommation_level_1_max"] == r["consommation_level_1_mean"] == 3.0


def test_same_day_and_bad_date(make):
    c, i = make([(1, 5, 1, 11, 0)],
                [inv(1, "2020-01-01"), inv(1, "2020-01-01"), inv(1, "bad"), inv(1, "2020-01-11")])
    gaps = {(r.gap_days, r.n) for r in A.gap_histogram(i).collect()}
    assert gaps == {(0, 1), (10, 1)}
    r = row(A.invoice_frequency(i), 1)
    assert r["f_invoive_date_diff_days"] == 5.0
    assert r["f_invoive_date_median_months"] == pytest.approx(5 / 30.44)


def test_tied_mode_smallest_and_all_null(make):
    c, i = make([(1, 5, 1, 11, 0), (2, 5, 1, 11, 0)],
                [inv(1, tarif=3), inv(1, tarif=1), inv(1, tarif=3), inv(1, tarif=1),
                 inv(2, tarif=None), inv(2, tarif=None)])
    f = assemble.features_train(c, i)
    assert row(f, 1)["tarif_type"] == 1
    assert row(f, 1)["f_tarif_change_count"] == 2
    assert row(f, 2)["tarif_type"] is None
    assert row(f, 2)["f_tarif_change_count"] == 0


def test_zero_months_gives_null(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1, months=0, levels=(5.0, 0.0, 0.0, 0.0))])
    assert row(assemble.features_train(c, i), 1)["avg_consumption_per_month"] is None


def test_blank_remarks(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1, remark=None), inv(1, remark=" "), inv(1, remark="abc")])
    r = row(assemble.features_train(c, i), 1)
    assert r["remarque_frequency"] == pytest.approx(0.5)
    assert r["avg_remarque_length"] == pytest.approx(3.0)


def test_null_consumption_level(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1, levels=(1.0, 2.0, 3.0, None), old=0, new=10),
                                     inv(1, levels=(1.0, 1.0, 1.0, 1.0), old=0, new=10, date="2020-02-01")])
    r = row(assemble.features_train(c, i), 1)
    assert r["f_total_consumption_max"] == 6.0
    assert r["f_index_cons_error_sum"] == pytest.approx(6.0)     # only the complete row: 10 - 4
    assert r["avg_consumption_per_month"] == pytest.approx(2.0)  # 4 / 2 months


def test_status_imputed_with_global_mode(make):
    c, i = make([(1, 5, 1, 11, 0), (2, 5, 1, 11, 0)],
                [inv(1, status="2"), inv(1, status="A"), inv(2, status="2"), inv(2, status="7"),
                 inv(2, status="4")])
    f = assemble.features_train(c, i)
    assert row(f, 1)["f_counter_statue_mean"] == pytest.approx(2.0)
    assert row(f, 2)["f_counter_statue_mean"] == pytest.approx((2 + 2 + 4) / 3)


def test_empty_invoice_table(make):
    c, i = make([(1, 5, 1, 11, 0)], [])
    r = row(assemble.features_train(c, i), 1)
    assert r["f_counter_statue_error_occured"] == 1
    assert r["f_counter_statue_mean"] is None


def test_duplicated_client_fans_out(make):
    c, i = make([(1, 5, 1, 11, 0), (1, 6, 2, 11, 0), (2, 5, 1, 11, 1)], [inv(1), inv(2)])
    f = assemble.features_train(c, i)
    assert f.filter("client_id = 1").count() == 4  # two client rows x two region rows
    assert row(f.filter("client_id = 2"), 2)["f_counter_regions"] == 0
    assert {r.f_counter_regions for r in f.filter("client_id = 1").collect()} == {1}


def test_combination_smoothing_and_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert combine_features(df, "a", "b", "/", "r").first()["r"] == pytest.approx(10.0)
    assert combine_features(df, "a", "b", "+", "r").columns[-1] == "r"
    with pytest.raises(ValueError):
        combine_features(df, "a", "b", "%", "r")
    with pytest.raises(ValueError):
        combine_features(df, "a", "zz", "+", "r")


def test_fused_equals_single_operators(make):
    rows = []
    for cid in range(1, 7):
        for k in range(cid):
            rows.append(inv(cid, f"2020-0{1 + k % 9}-1{k % 10}", tarif=10 + k % 3, meter=cid * 10 + k % 2,
                            status=["0", "1", "A", None, "Faulty"][k % 5], remark=[None, " ", "ab"][k % 3],
                            levels=(float(k), 1.0, 0.0, None if k == 2 else 2.0), old=k, new=3 * k, months=k % 3))
    c, i = make([(cid, cid % 2, cid % 3, 11 + cid % 2, cid % 2) for cid in range(1, 8)], rows)
    fused = assemble.features_train(c, i)
    base = c.select("client_id")
    single = A.add_invoice_frequency_features(base, i)
    single = A.add_counter_statue_error_occured_features(single, i)
    single = A.add_consump_agg(single, i)
    single = A.add_tarif_agg(single, i)
    single = A.add_index_cons_error_agg(single, i)
    single = A.add_counter_statue_agg(single, i)
    single = A.add_client_tenure(single, i, c)
    single = A.add_meter_replacement_count_agg(single, i)
    single = A.add_tarif_change_count_agg(single, i)
    single = A.add_avg_consumption_per_month(single, i)
    single = A.add_reading_remarque_signals(single, i)
    single = A.add_faulty_status_rate(single, i)
    f = {r["client_id"]: r.asDict() for r in fused.collect()}
    s = {r["client_id"]: r.asDict() for r in single.collect()}
    assert f.keys() == s.keys()
    for cid in f:
        for k, v in s[cid].items():
            a = f[cid][k]
            if isinstance(v, float) and a is not None:
                assert a == pytest.approx(v), (cid, k)
            else:
                assert a == v, (cid, k)


def test_add_combinations_appends_seven(make):
    c, i = make([(1, 5, 1, 11, 0)], [inv(1)])
    out = add_combinations(assemble.features_train(c, i))
    assert out.columns[-7:] == [f"f_combi{k}" for k in range(1, 8)]
    assert len(assemble.TRAIN_COLUMNS) == 52 and len(assemble.TEST_COLUMNS) == 48
    r = out.first()
    assert r["f_combi3"] == pytest.approx(r["f_total_consumption_std"] / 1.1) if r["f_total_consumption_std"] \
        else r["f_combi3"] is None or math.isnan(r["f_combi3"])
