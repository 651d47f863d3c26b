"""Client-level features: one row per client from the invoice table.

Plan shape (see README "Scale"):

* ``invoice_measures`` projects each invoice once: parsed date, index delta,
  totals, status and remark flags.
* ``client_aggregates`` is ONE ``groupBy(client_id)`` of algebraic measures
  (count / sum / min / max / avg / stddev).  Spark runs it as partial
  aggregation on the map side, so a client holding a third of all invoices
  is collapsed inside each map task before the shuffle.
* ``value_counts`` pre-aggregates (client, kind, value) → count for invoice
  days, tariffs and meters in one pass.  Medians, modes and distinct counts
  are computed from those counts, so no task ever holds the raw invoices of
  one client; the per-client state is bounded by the number of distinct
  days / tariffs / meters of that client.

The ``add_*`` functions attach one feature group to a feature frame with a
left join on ``client_id`` (reference semantics: clients without invoices
keep their row).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (DAYS_PER_MONTH, DAYS_PER_YEAR, ensure_date, mode_smallest,
                                 non_blank, safe_div, scalar_of)

LEVELS = ["consommation_level_1", "consommation_level_2", "consommation_level_3", "consommation_level_4"]
CONSUMPTION_MEASURES = LEVELS + ["f_index_diff", "f_total_consumption"]
STATS = ["min", "max", "std", "mean"]
# Fixed status codes accepted by the status mean (everything else is imputed).
STATUS_CODES = ["0", "1", "2", "3", "4", "5"]

CONSUMPTION_STAT_COLUMNS = [f"{m}_{s}" for m in CONSUMPTION_MEASURES for s in STATS]


# --------------------------------------------------------------------------- #
# projection
# --------------------------------------------------------------------------- #
def invoice_measures(invoice: DataFrame) -> DataFrame:
    """Per-invoice derived columns used by all client aggregates."""
    inv = ensure_date(invoice, "invoice_date")
    levels = [F.col(c).cast("double") for c in LEVELS]
    status = F.col("counter_statue").cast("string")
    remark = F.col("reading_remarque").cast("string")
    level_sum = levels[0] + levels[1] + levels[2] + levels[3]
    index_diff = (F.col("new_index") - F.col("old_index")).cast("double")
    return inv.select(
        "client_id",
        "invoice_date",
        "tarif_type",
        "counter_number",
        *[lv.alias(c) for lv, c in zip(levels, LEVELS)],
        index_diff.alias("f_index_diff"),
        sum((F.coalesce(lv, F.lit(0.0)) for lv in levels[1:]), F.coalesce(levels[0], F.lit(0.0)))
        .alias("f_total_consumption"),
        level_sum.alias("level_sum"),
        (index_diff - level_sum).alias("index_cons_error"),
        F.col("months_number").cast("long").alias("months_number"),
        status.alias("counter_statue"),
        F.when(status.isin(*STATUS_CODES), status.cast("int")).alias("status_code"),
        (status.isNull() | (status != F.lit("0"))).cast("int").alias("status_error"),
        F.coalesce(F.lower(status) == F.lit("faulty"), F.lit(False)).cast("int").alias("is_faulty"),
        remark.alias("reading_remarque"),
        non_blank(remark).cast("int").alias("has_remarque"),
        F.when(non_blank(remark), F.length(remark)).alias("remarque_length"),
    )


# --------------------------------------------------------------------------- #
# one algebraic aggregate per client
# --------------------------------------------------------------------------- #
def _aggregate_exprs():
    exprs = [F.count(F.lit(1)).alias("n_invoices"),
             F.max("status_error").alias("f_counter_statue_error_occured")]
    for m in CONSUMPTION_MEASURES:
        exprs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
                  F.stddev_samp(m).alias(f"{m}_std"), F.avg(m).alias(f"{m}_mean"),
                  F.count(m).alias(f"{m}__n"), F.sum(m).alias(f"{m}__sum")]
    exprs += [
        F.coalesce(F.sum("index_cons_error"), F.lit(0.0)).alias("f_index_cons_error_sum"),
        F.sum("status_code").alias("status__sum"),
        F.count("status_code").alias("status__n"),
        *[F.sum((F.col("status_code") == k).cast("long")).alias(f"status__c{k}") for k in range(6)],
        F.max("invoice_date").alias("last_invoice_date"),
        F.coalesce(F.sum("level_sum"), F.lit(0.0)).alias("total_consumption"),
        F.coalesce(F.sum("months_number"), F.lit(0)).alias("total_months"),
        F.count("reading_remarque").alias("remarque__n"),
        F.coalesce(F.sum("has_remarque"), F.lit(0)).alias("remarque__has"),
        F.avg("remarque_length").alias("avg_remarque_length"),
        F.count("counter_statue").alias("status__nonnull"),
        F.coalesce(F.sum("is_faulty"), F.lit(0)).alias("faulty__n"),
    ]
    return exprs


def client_aggregates(invoice: DataFrame) -> DataFrame:
    """All algebraic per-client measures in one partial/final aggregate."""
    return (invoice_measures(invoice)
            .filter(F.col("client_id").isNotNull())
            .groupBy("client_id").agg(*_aggregate_exprs()))


def status_mode(aggregates: DataFrame) -> DataFrame:
    """One-row frame: the most frequent valid status over all invoices.

    Built from the per-client value counts, so the invoices are not scanned
    again.  Smallest code wins ties; NULL when no valid status exists.
    """
    totals = aggregates.agg(*[F.coalesce(F.sum(f"status__c{k}"), F.lit(0)).alias(f"c{k}")
                              for k in range(6)])
    best = F.array_max(F.array(*[F.struct(F.col(f"c{k}").alias("n"), F.lit(-k).alias("neg"))
                                 for k in range(6)]))
    return totals.select(F.when(best["n"] > 0, -best["neg"]).alias("status_mode"))


def with_status_mean(aggregates: DataFrame) -> DataFrame:
    """Mean status per client after filling invalid codes with the global mode.

    mean = (Σ valid + (#rows − #valid) · mode) / #rows.  The global mode is a
    one-row aggregate, used as a scalar subquery.
    """
    mode = scalar_of(status_mode(aggregates), "status_mode")
    filled = F.coalesce(F.col("status__sum"), F.lit(0)) + \
        (F.col("n_invoices") - F.col("status__n")) * mode
    return aggregates.withColumn("f_counter_statue_mean", safe_div(filled, "n_invoices"))


# --------------------------------------------------------------------------- #
# value counts: days, tariffs, meters
# --------------------------------------------------------------------------- #
KIND_COLUMNS = {"d": "invoice_date", "t": "tarif_type", "m": "counter_number"}


DAY_ROWS = 500_000  # invoice days of a task: their counts stay in its memory


def value_counts(invoice: DataFrame, kinds=("d", "t", "m"), parts: int | None = None) -> DataFrame:
    """(client_id, kind, value, n): counts of invoice days ('d', epoch day),
    tariffs ('t') and meters ('m').  NULL values are left out, as the
    reference's median / mode / nunique skip them.

    Only the requested kinds are built; several kinds share one scan and one
    partial/final aggregate (one row per invoice and kind).  With ``parts`` the
    rows are first dealt by client and value into so many tasks, for values that
    hardly repeat: a task's table of counts is then bounded, whatever the size of
    the files that are scanned.
    """
    inv = invoice.select("client_id", *[KIND_COLUMNS[k] for k in kinds])
    if "d" in kinds:
        inv = ensure_date(inv, "invoice_date")

    def value_of(k):
        c = F.col(KIND_COLUMNS[k])
        return (F.unix_date(c) if k == "d" else c).cast("long")

    if len(kinds) == 1:
        rows = inv.select("client_id", F.lit(kinds[0]).alias("kind"), value_of(kinds[0]).alias("value"))
    else:
        kv = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), value_of(k).alias("value"))
                                 for k in kinds])).alias("kv")
        rows = inv.select("client_id", kv).select("client_id", "kv.kind", "kv.value")
    rows = rows.filter(F.col("client_id").isNotNull() & F.col("value").isNotNull())
    if parts:
        rows = rows.repartition(parts, "client_id", "value")
    return rows.groupBy("client_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def day_tasks(rows: DataFrame) -> int:
    """Tasks for rows of clients and days: ``DAY_ROWS`` each, no fewer than task slots."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / DAY_ROWS))


def gap_histogram(invoice: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Day gaps between consecutive invoices of a client, as counts.

    (client_id, gap_days, n).  Invoices on the same day give gap 0 (n − 1
    times per day); consecutive distinct days give their difference.  The
    window runs over distinct days per client, not over raw invoices.

    Days hardly repeat within a client, so every step holds about a row for each
    invoice; the number of its tasks follows the number of rows (``DAY_ROWS``),
    else they spill once the tables grow.
    """
    parts = day_tasks(invoice)
    kv = counts if counts is not None else value_counts(invoice, ("d",), parts)
    days = (kv.filter(F.col("kind") == "d").select("client_id", F.col("value").alias("day"), "n")
            .repartition(parts, "client_id"))
    w = Window.partitionBy("client_id").orderBy("day")
    stepped = days.withColumn("gap", F.col("day") - F.lag("day").over(w))
    pairs = F.explode(F.array(
        F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).cast("long").alias("gap_days"), (F.col("n") - 1).alias("n")),
    )).alias("p")
    return (stepped.select("client_id", pairs)
            .select("client_id", "p.gap_days", "p.n")
            .filter(F.col("gap_days").isNotNull() & (F.col("n") > 0))
            .groupBy("client_id", "gap_days").agg(F.sum("n").alias("n")))


def invoice_frequency(invoice: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """A1: median day gap per client, also in months and years."""
    g = gaps if gaps is not None else gap_histogram(invoice)
    med = F.percentile(F.col("gap_days"), F.lit(0.5), F.col("n"))
    return (g.groupBy("client_id").agg(med.alias("f_invoive_date_diff_days"))
            .select("client_id", "f_invoive_date_diff_days",
                    (F.col("f_invoive_date_diff_days") / DAYS_PER_MONTH).alias("f_invoive_date_median_months"),
                    (F.col("f_invoive_date_diff_days") / DAYS_PER_YEAR).alias("f_invoive_date_median_years")))


def tariff_and_meter_counts(invoice: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A5, A9, A10 from the value counts: most frequent tariff (smallest on
    ties), number of distinct meters, number of distinct tariffs."""
    kv = counts if counts is not None else value_counts(invoice, ("t", "m"))
    is_t = F.col("kind") == "t"
    is_m = F.col("kind") == "m"
    return (kv.filter(F.col("kind").isin("t", "m"))
            .groupBy("client_id").agg(
                mode_smallest(F.when(is_t, F.col("value")), F.when(is_t, F.col("n"))).alias("tarif_type"),
                F.count(F.when(is_m, 1)).alias("f_counter_number_nunique"),
                F.count(F.when(is_t, 1)).alias("f_tarif_change_count"))
            .select("client_id", F.col("tarif_type").cast("int").alias("tarif_type"),
                    # clients whose meters (tariffs) are all NULL get 0, as nunique does
                    "f_counter_number_nunique", "f_tarif_change_count"))


# --------------------------------------------------------------------------- #
# feature projections of the aggregates
# --------------------------------------------------------------------------- #
def consumption_stats_cols():
    return [F.col(c) for c in CONSUMPTION_STAT_COLUMNS]


def remark_cols():
    return [safe_div("remarque__has", "remarque__n").alias("remarque_frequency"),
            F.col("avg_remarque_length")]


def faulty_cols():
    return [safe_div("faulty__n", "status__nonnull").alias("faulty_status_rate")]


def monthly_cols():
    return [safe_div("total_consumption", "total_months").alias("avg_consumption_per_month")]


# --------------------------------------------------------------------------- #
# attach helpers (reference add_* semantics)
# --------------------------------------------------------------------------- #
def attach(features: DataFrame, per_client: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Left-join per-client columns to ``features``; fill ``defaults`` for
    clients without a match."""
    out = features.join(per_client, "client_id", "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def add_invoice_frequency_features(features, invoice):
    return attach(features, invoice_frequency(invoice))


def add_counter_statue_error_occured_features(features, invoice):
    agg = client_aggregates(invoice).select("client_id", "f_counter_statue_error_occured")
    # a client without invoices has one merged row with a NULL status: error
    return attach(features, agg, {"f_counter_statue_error_occured": 1})


def add_consump_agg(features, invoice):
    return attach(features, client_aggregates(invoice).select("client_id", *consumption_stats_cols()))


def add_tarif_agg(features, invoice):
    return attach(features, tariff_and_meter_counts(invoice).select("client_id", "tarif_type"))


def add_meter_replacement_count_agg(features, invoice):
    return attach(features, tariff_and_meter_counts(invoice).select("client_id", "f_counter_number_nunique"))


def add_tarif_change_count_agg(features, invoice):
    return attach(features, tariff_and_meter_counts(invoice).select("client_id", "f_tarif_change_count"))


def add_index_cons_error_agg(features, invoice):
    return attach(features, client_aggregates(invoice).select("client_id", "f_index_cons_error_sum"))


def add_counter_statue_agg(features, invoice):
    agg = with_status_mean(client_aggregates(invoice))
    return attach(features, agg.select("client_id", "f_counter_statue_mean"))


def add_client_tenure(features, invoice, client):
    """Last invoice day − creation day (client creation date, earliest
    value when a client appears more than once)."""
    created = ensure_date(client.select("client_id", "creation_date"), "creation_date",
                          formats=_creation_formats())
    created = created.groupBy("client_id").agg(F.min("creation_date").alias("creation_date"))
    last = client_aggregates(invoice).select("client_id", "last_invoice_date")
    ten = last.join(created, "client_id").select(
        "client_id", F.datediff("last_invoice_date", "creation_date").alias("f_client_tenure_days"))
    return attach(features, ten)


def _creation_formats():
    from ..functions.columns import CREATION_DATE_FORMATS
    return CREATION_DATE_FORMATS


def add_avg_consumption_per_month(features, invoice):
    return attach(features, client_aggregates(invoice).select("client_id", *monthly_cols()))


def add_reading_remarque_signals(features, invoice):
    return attach(features, client_aggregates(invoice).select("client_id", *remark_cols()))


def add_faulty_status_rate(features, invoice):
    return attach(features, client_aggregates(invoice).select("client_id", *faulty_cols()))


def add_counter_regions_features(features, client):
    """A3: 1 when a client id appears with more than one region."""
    regions = client.groupBy("client_id").agg(
        (F.count_distinct("region") > 1).cast("int").alias("f_counter_regions"))
    return attach(features, regions, {"f_counter_regions": 0})


def starter_aggregates(invoice: DataFrame) -> DataFrame:
    """Row count and the four mean consumption levels per client."""
    return (invoice.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("1transactions_count"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in LEVELS]))
