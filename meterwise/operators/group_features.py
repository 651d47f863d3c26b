"""Group-level features (region, district, client category) and target rates.

The reference computes region statistics over the client ⋈ invoice rows.  We
roll them up from the per-client partial aggregates instead (eager
aggregation): the big invoice table is never joined to the client table;
only client-sized frames meet.  Region keys are few and hot, so every
region measure is an algebraic or count-map aggregate with map-side
combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .client_features import LEVELS, attach, client_aggregates, gap_histogram

REGION_STD_PREFIX = "f_region_std_deviation_consumption"


def _pooled_std(prefix: str):
    """Pooled sample std of a group from per-client (count, sum, std).

    M2 = Σ M2_i + Σ s_i²/c_i − S²/N with M2_i = std_i² (c_i − 1).
    """
    c, s, sd = F.col(f"{prefix}__n"), F.col(f"{prefix}__sum"), F.col(f"{prefix}_std")
    m2_i = F.coalesce(sd * sd * (c - 1), F.lit(0.0))
    between = F.when(c > 0, s * s / c)
    n = F.sum(c)
    m2 = F.sum(m2_i) + F.sum(between) - F.sum(s) * F.sum(s) / n
    return F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))


def region_consumption_std(client: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Sample std of each consumption level over the region's invoices."""
    rows = client.select("client_id", "region").join(aggregates, "client_id", "left")
    return rows.groupBy("region").agg(
        *[_pooled_std(lv).alias(f"{REGION_STD_PREFIX}{lv[len('consommation'):]}") for lv in LEVELS])


def region_summary(client: DataFrame, aggregates: DataFrame, with_target: bool = True) -> DataFrame:
    """G3 and (with the target) G1 from one join and one aggregate by region."""
    cols = ["client_id", "region"] + (["target"] if with_target else [])
    rows = client.select(*cols).join(aggregates, "client_id", "left")
    exprs = [_pooled_std(lv).alias(f"{REGION_STD_PREFIX}{lv[len('consommation'):]}") for lv in LEVELS]
    if with_target:
        w = F.greatest(F.coalesce(F.col("n_invoices"), F.lit(0)), F.lit(1))
        t = F.col("target").cast("double")
        exprs.append(F.try_divide(F.sum(w * t), F.sum(F.when(t.isNotNull(), w))).alias("f_t_region_fraud_rate"))
    return rows.groupBy("region").agg(*exprs)


def region_fraud_rate(client: DataFrame, aggregates: DataFrame) -> DataFrame:
    """G1: mean target over client ⋈ invoice rows per region, i.e. each
    client weighted by its invoice count (one row when it has none)."""
    rows = (client.select("client_id", "region", "target")
            .join(aggregates.select("client_id", "n_invoices"), "client_id", "left"))
    w = F.greatest(F.coalesce(F.col("n_invoices"), F.lit(0)), F.lit(1))
    t = F.col("target").cast("double")
    return rows.groupBy("region").agg(
        F.try_divide(F.sum(w * t), F.sum(F.when(t.isNotNull(), w))).alias("f_t_region_fraud_rate"))


def region_billing_median(client: DataFrame, gaps: DataFrame) -> DataFrame:
    """Median invoice gap per region over the gaps of all its clients.

    Gap counts are summed per (region, gap) before the percentile, so the
    percentile state of a region is its number of distinct gap values.
    """
    pairs = client.select("client_id", "region").distinct()
    per_gap = (pairs.join(gaps, "client_id")
               .groupBy("region", "gap_days").agg(F.sum("n").alias("n")))
    return per_gap.groupBy("region").agg(
        F.percentile(F.col("gap_days"), F.lit(0.5), F.col("n")).alias("f_region_median_billing_frequence_per"))


def group_target_mean(client: DataFrame, key: str, name: str) -> DataFrame:
    """Mean target over clients per ``key`` (client-weighted)."""
    return client.groupBy(key).agg(F.avg(F.col("target").cast("double")).alias(name))


def district_target_rate(client: DataFrame) -> DataFrame:
    return group_target_mean(client, "disrict", "f_t_district_target_mean")


def category_target_rate(client: DataFrame) -> DataFrame:
    return group_target_mean(client, "client_catg", "f_t_client_catg_target_mean")


def region_to_clients(client: DataFrame, per_region: DataFrame) -> DataFrame:
    """Map region values to clients through distinct (client, region) pairs.

    A client listed in two regions gets two rows (the reference's fan-out).
    """
    return client.select("client_id", "region").distinct().join(per_region, "region", "left").drop("region")


# reference-style attach functions ------------------------------------------ #
def add_region_fraud_rate_features(features, invoice, client):
    return attach(features, region_to_clients(client, region_fraud_rate(client, client_aggregates(invoice))))


def add_median_billing_frequence_per_region(features, invoice, client):
    return attach(features, region_to_clients(client, region_billing_median(client, gap_histogram(invoice))))


def add_sdt_dev_consumption_region(features, invoice, client, postfix_consumption: str):
    column = f"consommation{postfix_consumption}"
    if column not in LEVELS:
        raise KeyError(f"no consumption level {column!r}; known: {LEVELS}")
    name = f"{REGION_STD_PREFIX}{postfix_consumption}"
    per_region = region_consumption_std(client, client_aggregates(invoice)).select("region", name)
    return attach(features, region_to_clients(client, per_region))


def add_district_target_agg(features, client):
    return features.join(district_target_rate(client), "disrict", "left")


def add_client_catg_target_agg(features, client):
    return features.join(category_target_rate(client), "client_catg", "left")
