"""Feature-table assemblers (train, test, test with transferred rates).

One plan replaces the reference's 21 feature calls (each a full copy,
group-by and merge):

1. one partial/final aggregate of invoices by client (algebraic measures);
2. (client, value) count pre-aggregates → gap histogram (days), tariff
   mode and distinct counts (tariffs, meters);
3. client-sized joins: client rows ← per-client results ← region, district
   and category tables (AQE turns them into broadcast joins when the
   runtime size is below the broadcast threshold, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CREATION_DATE_FORMATS, ensure_date
from ..operators import group_features as G
from ..operators.client_features import (CONSUMPTION_STAT_COLUMNS, client_aggregates, day_tasks, faulty_cols,
                                         gap_histogram, invoice_frequency, monthly_cols, remark_cols,
                                         tariff_and_meter_counts, with_status_mean)
from ..operators.projections import base_columns
from ..session import cut_lineage

INVOICE_FEATURES = (
    ["f_invoive_date_diff_days", "f_invoive_date_median_months", "f_invoive_date_median_years",
     "f_counter_statue_error_occured", "f_counter_regions", "f_region_median_billing_frequence_per"]
    + [f"{G.REGION_STD_PREFIX}_level_{i}" for i in range(1, 5)]
    + CONSUMPTION_STAT_COLUMNS
    + ["tarif_type", "f_index_cons_error_sum", "f_counter_statue_mean", "f_client_tenure_days",
       "f_counter_number_nunique", "f_tarif_change_count", "avg_consumption_per_month",
       "remarque_frequency", "avg_remarque_length", "faulty_status_rate"]
)
TARGET_FEATURES = ["f_t_region_fraud_rate", "f_t_district_target_mean", "f_t_client_catg_target_mean"]
TRAIN_COLUMNS = ["client_id", "target", "disrict", "region", "client_catg"] + INVOICE_FEATURES + TARGET_FEATURES
TEST_COLUMNS = ["client_id", "disrict", "region", "client_catg"] + INVOICE_FEATURES


def _clean(client: DataFrame, invoice: DataFrame):
    client = ensure_date(client, "creation_date", CREATION_DATE_FORMATS).filter(F.col("client_id").isNotNull())
    invoice = invoice.filter(F.col("client_id").isNotNull())
    return client, invoice


def invoice_tables(invoice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(client summary, gap histogram) of the invoices.

    Each is bounded by clients x distinct values and written once to the
    shared checkpoint folder: later stages restart from the files after a
    failure, and several feature tables of the same invoices can share them.
    The histogram, small in bytes but long, is dealt by client into tasks of bounded
    rows, once for the medians of clients and of regions.
    """
    invoice = invoice.filter(F.col("client_id").isNotNull())
    summary, gaps = cut_lineage(client_aggregates(invoice), "client-summary"), cut_lineage(gap_histogram(invoice), "gap-histogram")
    return summary, gaps.repartition(day_tasks(gaps), "client_id")


def build_features(client: DataFrame, invoice: DataFrame, with_target: bool | None = None,
                   tables: tuple | None = None) -> DataFrame:
    """B1 / B2: one feature row per client row (52 columns with target,
    48 without); ``tables`` as made by :func:`invoice_tables`."""
    client, invoice = _clean(client, invoice)
    if with_target is None:
        with_target = "target" in client.columns
    summary, gaps = tables or invoice_tables(invoice)
    agg = with_status_mean(summary)

    per_client = (agg.select(
        "client_id", "n_invoices", "last_invoice_date", "f_counter_statue_error_occured",
        *CONSUMPTION_STAT_COLUMNS, "f_index_cons_error_sum", "f_counter_statue_mean",
        *monthly_cols(), *remark_cols(), *faulty_cols())
        .join(invoice_frequency(invoice, gaps), "client_id", "left")
        .join(tariff_and_meter_counts(invoice), "client_id", "left"))

    client_keys = client.groupBy("client_id").agg(
        (F.count_distinct("region") > 1).cast("int").alias("f_counter_regions"),
        F.min("creation_date").alias("first_creation_date"))

    base = base_columns(client, with_target=with_target)
    out = (base.join(client_keys, "client_id", "left")
           .join(per_client, "client_id", "left")
           .withColumn("f_counter_statue_error_occured",
                       F.coalesce("f_counter_statue_error_occured", F.lit(1)))
           .withColumn("f_client_tenure_days", F.datediff("last_invoice_date", "first_creation_date")))

    per_region = (G.region_billing_median(client, gaps)
                  .join(G.region_summary(client, agg, with_target), "region", "full"))
    out = out.join(G.region_to_clients(client, per_region), "client_id", "left")

    if with_target:
        out = (out.join(G.district_target_rate(client), "disrict", "left")
               .join(G.category_target_rate(client), "client_catg", "left"))
        return out.select(*TRAIN_COLUMNS)
    return out.select(*TEST_COLUMNS)


def features_train(client: DataFrame, invoice: DataFrame, tables: tuple | None = None) -> DataFrame:
    return build_features(client, invoice, with_target=True, tables=tables)


def features_test(client: DataFrame, invoice: DataFrame, tables: tuple | None = None) -> DataFrame:
    return build_features(client.drop("target"), invoice, with_target=False, tables=tables)


def transfer_rates(test_features: DataFrame, train_features: DataFrame) -> DataFrame:
    """Attach the three target rates learned on the training table to
    the test table (distinct (key, rate) pairs, left join per key)."""
    from ..operators.joins import merge_on
    train_features = cut_lineage(train_features.select("region", "disrict", "client_catg", *TARGET_FEATURES), "rates")
    out = merge_on(test_features, train_features, "region", "f_t_region_fraud_rate")
    out = merge_on(out, train_features, "disrict", "f_t_district_target_mean")
    return merge_on(out, train_features, "client_catg", "f_t_client_catg_target_mean")
