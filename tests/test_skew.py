"""A client holding a third of all invoices: results equal a direct pandas
computation of the reference semantics (the scalable plan never gathers its
raw rows in one task; here we check it stays right)."""

import datetime
import random

import pandas as pd
import pytest

from conftest import inv
from meterwise.plans import assemble


def test_hot_client_features(make):
    rnd = random.Random(11)
    rows = []
    start = datetime.date(2015, 1, 1)
    for cid in range(1, 41):
        n = 1200 if cid == 1 else 60
        for k in range(n):
            d = start + datetime.timedelta(days=rnd.randint(0, 2000))
            rows.append(inv(cid, d.isoformat() if rnd.random() > 0.02 else "bad", tarif=rnd.choice([10, 11, 11, 12]),
                            meter=cid * 100 + rnd.randint(0, 5 if cid == 1 else 1),
                            status=rnd.choice(["0", "0", "1", "4", "A", None]),
                            levels=(float(rnd.randint(0, 30)), 0.0, 0.0, 0.0)))
    c, i = make([(cid, cid % 3, cid % 2, 11, cid % 2) for cid in range(1, 41)], rows)
    got = {r.client_id: r for r in assemble.features_train(c, i).collect()}

    pdf = pd.DataFrame(rows, columns=[f.name for f in i.schema.fields])
    pdf["d"] = pd.to_datetime(pdf["invoice_date"], format="%Y-%m-%d", errors="coerce")
    pdf = pdf.sort_values(["client_id", "d"])
    pdf["gap"] = pdf.groupby("client_id")["d"].diff().dt.days
    codes = pdf["counter_statue"].where(pdf["counter_statue"].isin(list("012345"))).astype(float)
    mode = codes.value_counts().sort_index().idxmax()
    pdf["status"] = codes.fillna(mode)
    for cid, g in pdf.groupby("client_id"):
        r = got[cid]
        assert r.f_invoive_date_diff_days == pytest.approx(g["gap"].median())
        counts = g["tarif_type"].value_counts()
        assert r.tarif_type == min(counts[counts == counts.max()].index)
        assert r.f_counter_number_nunique == g["counter_number"].nunique()
        assert r.consommation_level_1_std == pytest.approx(g["consommation_level_1"].std())
        assert r.f_counter_statue_mean == pytest.approx(g["status"].mean())
    assert len(pdf[pdf.client_id == 1]) * 3 >= len(pdf)
