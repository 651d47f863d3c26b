import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from meterwise.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="meterwise-tests")
    yield s
    s.stop()


CLIENT_DDL = "client_id long, disrict int, region int, client_catg int, creation_date date, target int"
INVOICE_DDL = ("client_id long, invoice_date string, tarif_type int, counter_number long, counter_statue string, "
               "counter_code int, reading_remarque string, counter_coefficient int, consommation_level_1 double, "
               "consommation_level_2 double, consommation_level_3 double, consommation_level_4 double, "
               "old_index long, new_index long, months_number int, counter_type string")


def inv(client_id, date="2020-01-01", tarif=10, meter=1, status="0", remark="x", levels=(1.0, 0.0, 0.0, 0.0),
        old=0, new=1, months=1):
    return (client_id, date, tarif, meter, status, 200, remark, 1, *levels, old, new, months, "ELEC")


@pytest.fixture
def make(spark):
    import datetime

    def _make(clients, invoices):
        c = spark.createDataFrame([(cid, d, r, k, datetime.date(2010, 1, 1), t) for cid, d, r, k, t in clients],
                                  CLIENT_DDL)
        i = spark.createDataFrame(invoices, INVOICE_DDL)
        return c, i
    return _make
