"""Registered feature queries (A*, G*, W1, B*) and their DuckDB oracles.

The oracles are written the direct way (window over raw invoice rows, joins
of invoice rows to clients) so they check the Spark plans, which take the
scalable route (pre-aggregation, roll-ups), independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import client_features as A
from ..operators import group_features as G
from ..operators.projections import base_columns
from ..sources.fixtures import cte, view, views
from . import assemble
from .registry import norm_sql, register

LV = ["consommation_level_1", "consommation_level_2", "consommation_level_3", "consommation_level_4"]
MEASURES = LV + ["f_index_diff", "f_total_consumption"]
STAT_SQL = {"min": "min", "max": "max", "std": "stddev_samp", "mean": "avg"}

# --------------------------------------------------------------------------- #
# oracle building blocks (DuckDB SQL over the fixture views)
# --------------------------------------------------------------------------- #
O_MEASURES = """m AS (SELECT client_id, invoice_date, tarif_type, counter_number, counter_statue, reading_remarque,
  months_number, consommation_level_1, consommation_level_2, consommation_level_3, consommation_level_4,
  CAST(new_index - old_index AS DOUBLE) AS f_index_diff,
  coalesce(consommation_level_1, 0) + coalesce(consommation_level_2, 0) + coalesce(consommation_level_3, 0)
    + coalesce(consommation_level_4, 0) AS f_total_consumption,
  consommation_level_1 + consommation_level_2 + consommation_level_3 + consommation_level_4 AS level_sum
  FROM invoice)"""

O_BLOCKS = {
    "freq": """freq AS (SELECT client_id, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS f_invoive_date_diff_days,
    quantile_cont(CAST(gap AS DOUBLE), 0.5) / 30.44 AS f_invoive_date_median_months,
    quantile_cont(CAST(gap AS DOUBLE), 0.5) / 365.25 AS f_invoive_date_median_years
  FROM (SELECT client_id, date_diff('day', lag(invoice_date) OVER (PARTITION BY client_id ORDER BY invoice_date NULLS LAST),
          invoice_date) AS gap FROM invoice) g
  GROUP BY client_id)""",
    "err": """err AS (SELECT client_id, max(CASE WHEN counter_statue IS NULL OR counter_statue <> '0' THEN 1 ELSE 0 END)
    AS f_counter_statue_error_occured FROM invoice GROUP BY client_id)""",
    "regs": """regs AS (SELECT client_id, CASE WHEN count(DISTINCT region) > 1 THEN 1 ELSE 0 END AS f_counter_regions
  FROM client GROUP BY client_id)""",
    "rmed": """rmed AS (SELECT region, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS f_region_median_billing_frequence_per
  FROM (SELECT c.region, date_diff('day', lag(i.invoice_date) OVER (PARTITION BY c.region, c.client_id
          ORDER BY i.invoice_date NULLS LAST), i.invoice_date) AS gap
        FROM client c LEFT JOIN invoice i ON c.client_id = i.client_id) g
  GROUP BY region)""",
    "rstd": """rstd AS (SELECT c.region, """ + ", ".join(
        f"stddev_samp(i.consommation_level_{k}) AS f_region_std_deviation_consumption_level_{k}" for k in range(1, 5))
    + """ FROM client c LEFT JOIN invoice i ON c.client_id = i.client_id GROUP BY c.region)""",
    "cons": "cons AS (SELECT client_id, " + ", ".join(
        f"{STAT_SQL[s]}({m}) AS {m}_{s}" for m in MEASURES for s in ["min", "max", "std", "mean"])
    + " FROM m GROUP BY client_id)",
    "tmode": """tmode AS (SELECT client_id, min(tarif_type) AS tarif_type FROM (
    SELECT client_id, tarif_type, cnt, max(cnt) OVER (PARTITION BY client_id) AS mx FROM (
      SELECT client_id, tarif_type, count(*) AS cnt FROM invoice WHERE tarif_type IS NOT NULL GROUP BY client_id, tarif_type) t) t2
  WHERE cnt = mx GROUP BY client_id)""",
    "ierr": """ierr AS (SELECT client_id, coalesce(sum(f_index_diff - level_sum), 0) AS f_index_cons_error_sum
  FROM m GROUP BY client_id)""",
    "smean": """smean AS (SELECT client_id, avg(coalesce(s, gm.gmode)) AS f_counter_statue_mean FROM (
    SELECT client_id, CASE WHEN counter_statue IN ('0', '1', '2', '3', '4', '5') THEN CAST(counter_statue AS INTEGER) END AS s
    FROM invoice) codes
  LEFT JOIN (SELECT s AS gmode FROM (
    SELECT CAST(counter_statue AS INTEGER) AS s FROM invoice WHERE counter_statue IN ('0', '1', '2', '3', '4', '5')) v
    GROUP BY s ORDER BY count(*) DESC, s ASC LIMIT 1) gm ON TRUE
  GROUP BY client_id)""",
    "ten": """ten AS (SELECT c.client_id, date_diff('day', c.creation_date, mx.last_date) AS f_client_tenure_days
  FROM client c JOIN (SELECT client_id, max(invoice_date) AS last_date FROM invoice GROUP BY client_id) mx
  ON c.client_id = mx.client_id)""",
    "meters": """meters AS (SELECT client_id, count(DISTINCT counter_number) AS f_counter_number_nunique,
    count(DISTINCT tarif_type) AS f_tarif_change_count FROM invoice GROUP BY client_id)""",
    "merged": """merged AS (SELECT c.client_id,
    CAST(coalesce(sum(m.level_sum), 0) AS DOUBLE) / nullif(CAST(coalesce(sum(m.months_number), 0) AS DOUBLE), 0)
      AS avg_consumption_per_month,
    CAST(sum(CASE WHEN m.reading_remarque IS NOT NULL AND regexp_matches(m.reading_remarque, '\\S') THEN 1 ELSE 0 END) AS DOUBLE)
      / nullif(count(m.reading_remarque), 0) AS remarque_frequency,
    avg(CASE WHEN m.reading_remarque IS NOT NULL AND regexp_matches(m.reading_remarque, '\\S')
      THEN length(m.reading_remarque) END) AS avg_remarque_length,
    CAST(sum(CASE WHEN lower(m.counter_statue) = 'faulty' THEN 1 ELSE 0 END) AS DOUBLE)
      / nullif(count(m.counter_statue), 0) AS faulty_status_rate
  FROM client c LEFT JOIN m ON c.client_id = m.client_id GROUP BY c.client_id)""",
    "rrate": """rrate AS (SELECT c.region, avg(CAST(c.target AS DOUBLE)) AS f_t_region_fraud_rate
  FROM client c LEFT JOIN invoice i ON c.client_id = i.client_id GROUP BY c.region)""",
    "drate": """drate AS (SELECT disrict, avg(CAST(target AS DOUBLE)) AS f_t_district_target_mean FROM client GROUP BY disrict)""",
    "crate": """crate AS (SELECT client_catg, avg(CAST(target AS DOUBLE)) AS f_t_client_catg_target_mean
  FROM client GROUP BY client_catg)""",
}

INVOICE_FEATURE_SQL = (
    ["freq.f_invoive_date_diff_days", "freq.f_invoive_date_median_months", "freq.f_invoive_date_median_years",
     "coalesce(err.f_counter_statue_error_occured, 1) AS f_counter_statue_error_occured",
     "regs.f_counter_regions", "rmed.f_region_median_billing_frequence_per"]
    + [f"rstd.f_region_std_deviation_consumption_level_{k}" for k in range(1, 5)]
    + [f"cons.{m}_{s}" for m in MEASURES for s in ["min", "max", "std", "mean"]]
    + ["tmode.tarif_type", "ierr.f_index_cons_error_sum", "smean.f_counter_statue_mean", "ten.f_client_tenure_days",
       "meters.f_counter_number_nunique", "meters.f_tarif_change_count", "merged.avg_consumption_per_month",
       "merged.remarque_frequency", "merged.avg_remarque_length", "merged.faulty_status_rate"]
)
PER_CLIENT = ["freq", "err", "regs", "cons", "tmode", "ierr", "smean", "ten", "meters", "merged"]


def _kinds(columns: list[str]) -> str:
    ints = {"client_id", "target", "disrict", "region", "client_catg", "f_counter_statue_error_occured",
            "f_counter_regions", "tarif_type", "f_client_tenure_days", "f_counter_number_nunique",
            "f_tarif_change_count", "1transactions_count", "gap_days", "n"}
    return ", ".join(f"{c}:{'i' if c in ints else 'f'}" for c in columns)


def feature_oracle(with_target: bool, raw: bool = False) -> str:
    blocks = PER_CLIENT + ["rmed", "rstd"] + (["rrate", "drate", "crate"] if with_target else [])
    head = ["c.client_id"] + (["c.target"] if with_target else []) + ["c.disrict", "c.region", "c.client_catg"]
    cols = head + INVOICE_FEATURE_SQL + (["rrate.f_t_region_fraud_rate", "drate.f_t_district_target_mean",
                                          "crate.f_t_client_catg_target_mean"] if with_target else [])
    joins = [f"LEFT JOIN {b} ON c.client_id = {b}.client_id" for b in PER_CLIENT]
    joins += ["LEFT JOIN rmed ON c.region = rmed.region", "LEFT JOIN rstd ON c.region = rstd.region"]
    if with_target:
        joins += ["LEFT JOIN rrate ON c.region = rrate.region", "LEFT JOIN drate ON c.disrict = drate.disrict",
                  "LEFT JOIN crate ON c.client_catg = crate.client_catg"]
    sql = (cte("client", "invoice") + ", " + O_MEASURES + ",\n" + ",\n".join(O_BLOCKS[b] for b in blocks)
           + "\nSELECT " + ", ".join(cols) + "\nFROM client c\n" + "\n".join(joins))
    if raw:
        return sql
    names = [c.split(" AS ")[-1].split(".")[-1] for c in cols]
    return norm_sql(sql, _kinds(names))


def per_client_oracle(block: str, columns: list[str], default: str | None = None) -> str:
    """Client rows left-joined to one oracle block."""
    sel = []
    for c in columns:
        sel.append(f"coalesce({block}.{c}, {default}) AS {c}" if default is not None else f"{block}.{c}")
    sql = (cte("client", "invoice") + ", " + O_MEASURES + ",\n" + O_BLOCKS[block]
           + f"\nSELECT c.client_id, {', '.join(sel)} FROM client c LEFT JOIN {block} ON c.client_id = {block}.client_id")
    return norm_sql(sql, _kinds(["client_id"] + columns))


def per_region_oracle(block: str, columns: list[str]) -> str:
    sql = (cte("client", "invoice") + ", " + O_BLOCKS[block]
           + f"\nSELECT c.client_id, {', '.join(block + '.' + x for x in columns)} FROM (SELECT DISTINCT client_id, region FROM client) c"
           f" LEFT JOIN {block} ON c.region = {block}.region")
    return norm_sql(sql, _kinds(["client_id"] + columns))


# --------------------------------------------------------------------------- #
# Spark side
# --------------------------------------------------------------------------- #
def _ci(spark, sf_dir):
    return views(spark, sf_dir, "client", "invoice")


def _per_client(add):
    def q(spark, sf_dir):
        client, invoice = _ci(spark, sf_dir)
        return add(client.select("client_id"), invoice, client)
    return q


def _sel(*cols):
    return lambda df: df.select("client_id", *cols)


@register("invoice_gaps", norm_sql(cte("invoice") + """
SELECT client_id, gap AS gap_days, count(*) AS n FROM (
  SELECT client_id, date_diff('day', lag(invoice_date) OVER (PARTITION BY client_id ORDER BY invoice_date NULLS LAST),
    invoice_date) AS gap FROM invoice) g
WHERE gap IS NOT NULL GROUP BY client_id, gap""", "client_id:i, gap_days:i, n:i"))
def q_invoice_gaps(spark, sf_dir):
    """Day gaps between consecutive invoices per client (as counts)."""
    return A.gap_histogram(view(spark, sf_dir, "invoice"))


FREQ = ["f_invoive_date_diff_days", "f_invoive_date_median_months", "f_invoive_date_median_years"]


@register("invoice_frequency", per_client_oracle("freq", FREQ))
def q_invoice_frequency(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_invoice_frequency_features(client.select("client_id"), invoice)


@register("status_error_flag", per_client_oracle("err", ["f_counter_statue_error_occured"], "1"))
def q_status_error_flag(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_counter_statue_error_occured_features(client.select("client_id"), invoice)


@register("multi_region_flag", norm_sql(cte("client") + ", " + O_BLOCKS["regs"] +
                                        "\nSELECT c.client_id, regs.f_counter_regions FROM client c "
                                        "LEFT JOIN regs ON c.client_id = regs.client_id",
                                        "client_id:i, f_counter_regions:i"))
def q_multi_region_flag(spark, sf_dir):
    client = view(spark, sf_dir, "client")
    return A.add_counter_regions_features(client.select("client_id"), client)


CONS = [f"{m}_{s}" for m in MEASURES for s in ["min", "max", "std", "mean"]]


@register("consumption_stats", per_client_oracle("cons", CONS))
def q_consumption_stats(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_consump_agg(client.select("client_id"), invoice)


@register("tariff_mode", per_client_oracle("tmode", ["tarif_type"]))
def q_tariff_mode(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_tarif_agg(client.select("client_id"), invoice)


@register("index_error_sum", per_client_oracle("ierr", ["f_index_cons_error_sum"]))
def q_index_error_sum(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_index_cons_error_agg(client.select("client_id"), invoice)


@register("status_mean", per_client_oracle("smean", ["f_counter_statue_mean"]))
def q_status_mean(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_counter_statue_agg(client.select("client_id"), invoice)


@register("client_tenure", per_client_oracle("ten", ["f_client_tenure_days"]))
def q_client_tenure(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_client_tenure(client.select("client_id"), invoice, client)


@register("meter_count", per_client_oracle("meters", ["f_counter_number_nunique"]))
def q_meter_count(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_meter_replacement_count_agg(client.select("client_id"), invoice)


@register("tariff_count", per_client_oracle("meters", ["f_tarif_change_count"]))
def q_tariff_count(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_tarif_change_count_agg(client.select("client_id"), invoice)


@register("avg_monthly_consumption", per_client_oracle("merged", ["avg_consumption_per_month"]))
def q_avg_monthly(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_avg_consumption_per_month(client.select("client_id"), invoice)


@register("remark_signals", per_client_oracle("merged", ["remarque_frequency", "avg_remarque_length"]))
def q_remark_signals(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_reading_remarque_signals(client.select("client_id"), invoice)


@register("faulty_rate", per_client_oracle("merged", ["faulty_status_rate"]))
def q_faulty_rate(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return A.add_faulty_status_rate(client.select("client_id"), invoice)


@register("starter_aggregates", norm_sql(cte("invoice") + """
SELECT client_id, count(*) AS "1transactions_count", """ + ", ".join(
    f"avg({c}) AS {c}_mean" for c in LV) + " FROM invoice GROUP BY client_id",
    _kinds(["client_id", "1transactions_count"] + [f"{c}_mean" for c in LV])))
def q_starter_aggregates(spark, sf_dir):
    """Per-client invoice count and mean consumption levels."""
    return A.starter_aggregates(view(spark, sf_dir, "invoice"))


@register("region_fraud_rate", per_region_oracle("rrate", ["f_t_region_fraud_rate"]))
def q_region_fraud_rate(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return G.add_region_fraud_rate_features(client.select("client_id"), invoice, client)


@register("region_billing_median", per_region_oracle("rmed", ["f_region_median_billing_frequence_per"]))
def q_region_billing_median(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    return G.add_median_billing_frequence_per_region(client.select("client_id"), invoice, client)


RSTD = [f"f_region_std_deviation_consumption_level_{k}" for k in range(1, 5)]


@register("region_consumption_std", per_region_oracle("rstd", RSTD))
def q_region_consumption_std(spark, sf_dir):
    client, invoice = _ci(spark, sf_dir)
    per_region = G.region_consumption_std(client, A.client_aggregates(invoice))
    return G.region_to_clients(client, per_region)


@register("district_target_rate", norm_sql(cte("client") + ", " + O_BLOCKS["drate"] +
                                           "\nSELECT c.client_id, drate.f_t_district_target_mean FROM client c "
                                           "LEFT JOIN drate ON c.disrict = drate.disrict",
                                           "client_id:i, f_t_district_target_mean:f"))
def q_district_target_rate(spark, sf_dir):
    client = view(spark, sf_dir, "client")
    return G.add_district_target_agg(client.select("client_id", "disrict"), client).drop("disrict")


@register("category_target_rate", norm_sql(cte("client") + ", " + O_BLOCKS["crate"] +
                                           "\nSELECT c.client_id, crate.f_t_client_catg_target_mean FROM client c "
                                           "LEFT JOIN crate ON c.client_catg = crate.client_catg",
                                           "client_id:i, f_t_client_catg_target_mean:f"))
def q_category_target_rate(spark, sf_dir):
    client = view(spark, sf_dir, "client")
    return G.add_client_catg_target_agg(client.select("client_id", "client_catg"), client).drop("client_catg")


@register("features_train", feature_oracle(True))
def q_features_train(spark, sf_dir):
    """B1: the 52-column training feature table (flagship query)."""
    client, invoice = _ci(spark, sf_dir)
    return assemble.features_train(client, invoice)


@register("features_test", feature_oracle(False))
def q_features_test(spark, sf_dir):
    """B2: the 48-column feature table without target features."""
    client, invoice = _ci(spark, sf_dir)
    return assemble.features_test(client, invoice)


def _enriched_oracle() -> str:
    test = feature_oracle(False)
    train = feature_oracle(True)
    return norm_sql(f"""WITH te AS ({test}), tr AS ({train})
SELECT te.*, r.f_t_region_fraud_rate, d.f_t_district_target_mean, k.f_t_client_catg_target_mean
FROM te
LEFT JOIN (SELECT DISTINCT region, f_t_region_fraud_rate FROM tr) r ON te.region = r.region
LEFT JOIN (SELECT DISTINCT disrict, f_t_district_target_mean FROM tr) d ON te.disrict = d.disrict
LEFT JOIN (SELECT DISTINCT client_catg, f_t_client_catg_target_mean FROM tr) k ON te.client_catg = k.client_catg""",
                    _kinds(assemble.TEST_COLUMNS + assemble.TARGET_FEATURES))


@register("features_test_enriched", _enriched_oracle())
def q_features_test_enriched(spark, sf_dir):
    """Test features with the three rates transferred from training."""
    client, invoice = _ci(spark, sf_dir)
    tables = assemble.invoice_tables(invoice)
    train = assemble.features_train(client, invoice, tables)
    test = assemble.features_test(client, invoice, tables)
    return assemble.transfer_rates(test, train)


@register("base_columns", norm_sql(cte("client") + "SELECT client_id, target, disrict, region, client_catg FROM client",
                                   "client_id:i, target:i, disrict:i, region:i, client_catg:i"))
def q_base_columns(spark, sf_dir):
    """Base columns of the client table, target second."""
    return base_columns(view(spark, sf_dir, "client"))
