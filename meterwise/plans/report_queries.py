"""Registered profiling (D*), ranking (W3, W4, M2, P9) and metric (E*)
queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as E
from ..operators import profile as D
from ..operators import sampling as R
from ..operators.client_features import invoice_measures
from ..operators.projections import add_combinations, apply_threshold
from ..operators.selection import filter_by_mi, mi_binned, mi_knn
from ..sources import io
from ..sources.fixtures import cte, view, views
from . import assemble
from .feature_queries import O_MEASURES, feature_oracle
from .registry import ORACLES, norm_sql, register

INVOICE_COLS = ["client_id", "invoice_date", "invoice_date_text", "tarif_type", "counter_number", "counter_statue",
                "counter_code", "reading_remarque", "counter_coefficient", "consommation_level_1",
                "consommation_level_2", "consommation_level_3", "consommation_level_4", "old_index", "new_index",
                "months_number", "counter_type"]
NUMERIC_INVOICE = ["client_id", "tarif_type", "counter_number", "counter_code", "counter_coefficient",
                   "consommation_level_1", "consommation_level_2", "consommation_level_3", "consommation_level_4",
                   "old_index", "new_index", "months_number"]
MEASURES = ["consommation_level_1", "consommation_level_2", "consommation_level_3", "consommation_level_4",
            "f_index_diff", "f_total_consumption"]
THRESHOLD = 0.5           # decision threshold of the metric queries on the scored view
MI_BINS = 10
MI_RANGE = (0.0005, 0.05)  # reference cut-offs: lowest minimum and the maximum
TOP_N = 10


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("missing_report", norm_sql(cte("invoice") + _union(
    f"SELECT {i} AS pos, '{c}' AS \"column\", count(*) - count({c}) AS num_missing, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS pct_missing, (count(*) - count({c})) > 0 AS has_missing FROM invoice"
    for i, c in enumerate(INVOICE_COLS)), "pos:i, column:s, num_missing:i, pct_missing:f, has_missing:b"))
def q_missing_report(spark, sf_dir):
    """Missing-value report of the invoice table."""
    return D.missing_report(view(spark, sf_dir, "invoice"))


@register("distinct_report", norm_sql(cte("invoice") + _union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM invoice" for c in INVOICE_COLS),
    "column:s, n_distinct:i"))
def q_distinct_report(spark, sf_dir):
    """Distinct values per column of the invoice table."""
    return D.distinct_report(view(spark, sf_dir, "invoice"))


@register("numeric_summary", norm_sql(cte("invoice") + _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg(CAST({c} AS DOUBLE)) AS mean, "
    f"stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS \"min\", "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, max(CAST({c} AS DOUBLE)) AS \"max\" FROM invoice"
    for c in NUMERIC_INVOICE), "column:s, count:i, mean:f, std:f, min:f, p25:f, p50:f, p75:f, max:f"))
def q_numeric_summary(spark, sf_dir):
    """D3: describe() of the numeric invoice columns, exact quartiles."""
    return D.numeric_summary(view(spark, sf_dir, "invoice"))


@register("table_shape", norm_sql(cte("invoice") + _union(
    f"SELECT {i} AS pos, '{c}' AS \"column\", count({c}) AS non_null, count(*) AS n_rows FROM invoice"
    for i, c in enumerate(INVOICE_COLS)), "pos:i, column:s, non_null:i, n_rows:i"))
def q_table_shape(spark, sf_dir):
    """Shape and non-null counts of the invoice table."""
    return D.table_shape(view(spark, sf_dir, "invoice")).drop("dtype")


@register("class_distribution", norm_sql(cte("client") + """
SELECT target AS class, count(*) AS "count", count(*) * 1.0 / (SELECT count(*) FROM client) AS share
FROM client GROUP BY target""", "class:i, count:i, share:f"))
def q_class_distribution(spark, sf_dir):
    """Class counts and shares of the client table."""
    return D.class_distribution(view(spark, sf_dir, "client"))


@register("value_counts", norm_sql(cte("client") + "SELECT disrict AS value, count(*) AS \"count\" FROM client WHERE disrict IS NOT NULL GROUP BY disrict",
                                   "value:i, count:i"))
def q_value_counts(spark, sf_dir):
    """Clients per district."""
    return D.value_counts(view(spark, sf_dir, "client"), "disrict")


@register("unique_values", norm_sql(cte("invoice") + "SELECT DISTINCT tarif_type AS value FROM invoice", "value:i"))
def q_unique_values(spark, sf_dir):
    """Distinct tariffs."""
    return D.unique_values(view(spark, sf_dir, "invoice"), "tarif_type")


def _corr_oracle():
    parts = []
    for i, a in enumerate(MEASURES):
        for b in MEASURES[i + 1:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS \"corr\" FROM m")
            parts.append(f"SELECT '{b}' AS column_a, '{a}' AS column_b, corr({a}, {b}) AS \"corr\" FROM m")
        parts.append(f"SELECT '{a}' AS column_a, '{a}' AS column_b, CASE WHEN var_pop({a}) > 0 THEN 1.0 END AS \"corr\" FROM m")
    return norm_sql(cte("invoice") + ", " + O_MEASURES + "\n" + _union(parts), "column_a:s, column_b:s, corr:f")


@register("correlation_matrix", _corr_oracle())
def q_correlation_matrix(spark, sf_dir):
    """Correlation of the consumption measures."""
    return D.correlation_matrix(invoice_measures(view(spark, sf_dir, "invoice")), MEASURES)


@register("compare_submissions", norm_sql(cte("client", "scored") + """
SELECT count(a.client_id) AS rows_a, count(b.client_id) AS rows_b, count(a.client_id) = count(b.client_id) AS same_rows,
  sum(CASE WHEN a.client_id IS NOT DISTINCT FROM b.client_id THEN 0 ELSE 1 END) = 0 AS same_ids,
  sum(CASE WHEN a.client_id IS NOT DISTINCT FROM b.client_id THEN 0 ELSE 1 END) AS id_mismatches,
  (SELECT count(*) - count(target) FROM scored) AS missing_target_a,
  (SELECT count(*) - count(target) FROM client) AS missing_target_b
FROM (SELECT client_id, row_number() OVER (ORDER BY client_id) AS pos FROM scored) a
FULL JOIN (SELECT client_id, row_number() OVER (ORDER BY -client_id) AS pos FROM client) b ON a.pos = b.pos""",
    "rows_a:i, rows_b:i, same_rows:b, same_ids:b, id_mismatches:i, missing_target_a:i, missing_target_b:i"))
def q_compare_submissions(spark, sf_dir):
    """Positional comparison of two id lists (ascending vs descending id)."""
    scored, client = views(spark, sf_dir, "scored", "client")
    return D.compare_submissions(scored, client.withColumn("rev", -F.col("client_id")), "client_id", "rev")


@register("first_mismatches", norm_sql(cte("client", "scored") + """
SELECT a.pos AS pos, a.client_id AS client_id, b.client_id AS client_id_file2
FROM (SELECT client_id, row_number() OVER (ORDER BY client_id) AS pos FROM scored) a
FULL JOIN (SELECT client_id, row_number() OVER (ORDER BY -client_id) AS pos FROM client) b ON a.pos = b.pos
WHERE a.client_id IS DISTINCT FROM b.client_id ORDER BY 1 LIMIT 5""", "pos:i, client_id:i, client_id_file2:i"))
def q_first_mismatches(spark, sf_dir):
    """The first five positions whose ids differ (a top-n report)."""
    scored, client = views(spark, sf_dir, "scored", "client")
    return D.first_mismatches(scored, client.withColumn("rev", -F.col("client_id")), "client_id", "rev")


# --------------------------------------------------------------------------- #
# mutual information on the training features (+ the 7 combinations)
# --------------------------------------------------------------------------- #
COMBI_SQL = [
    ("f_combi1", "avg_remarque_length * f_counter_number_nunique"),
    ("f_combi2", "remarque_frequency * f_tarif_change_count"),
    ("f_combi3", "f_total_consumption_std / nullif(f_counter_statue_error_occured + 0.1, 0)"),
    ("f_combi4", "f_region_std_deviation_consumption_level_3 * f_index_diff_mean"),
    ("f_combi5", "f_counter_number_nunique * remarque_frequency"),
    ("f_combi6", "f_counter_statue_error_occured * remarque_frequency"),
    ("f_combi7", "f_index_diff_mean * remarque_frequency"),
]


def _features_with_combinations(spark, sf_dir):
    client, invoice = views(spark, sf_dir, "client", "invoice")
    return add_combinations(assemble.features_train(client, invoice))


def _mi_scores_sql(bins: int = MI_BINS) -> str:
    feats = [c for c in assemble.TRAIN_COLUMNS if c not in ("client_id", "target")] + [n for n, _ in COMBI_SQL]
    combos = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COMBI_SQL)
    filled = ", ".join(f"round(coalesce(CAST({f} AS DOUBLE), 0.0), 9) AS {f}" for f in feats)
    return f"""WITH ft AS ({feature_oracle(True, raw=True)}),
fc AS (SELECT *, {combos} FROM ft),
filled AS (SELECT CAST(target AS INTEGER) AS y, {filled} FROM fc),
lf AS (UNPIVOT filled ON {', '.join(feats)} INTO NAME feature VALUE x),
r AS (SELECT feature, y, x, rank() OVER (PARTITION BY feature ORDER BY x) - 1 AS n_before,
        count(*) OVER (PARTITION BY feature) AS total FROM lf),
b AS (SELECT feature, y, (n_before * {bins}) // total AS bin, total FROM r),
t AS (SELECT feature, bin, y, count(*) AS n, max(total) AS total FROM b GROUP BY feature, bin, y),
t2 AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM t)
SELECT feature AS "Feature", greatest(sum(CAST(n AS DOUBLE) / total * ln(CAST(n AS DOUBLE) * total / (nb * ny))), 0.0) AS "MI_Score"
FROM t2 GROUP BY feature"""


@register("mi_knn")
def q_mi_knn(spark, sf_dir):
    """M1: k-nearest-neighbour MI of every training feature (+ the seven
    combinations) with the target, as the reference ranks features.  Its
    tie-breaking noise is a seeded hash, so no SQL oracle reproduces it; a
    test checks it against a brute-force evaluation."""
    return mi_knn(_features_with_combinations(spark, sf_dir))


@register("mi_binned", norm_sql(_mi_scores_sql(), "Feature:s, MI_Score:f"))
def q_mi_binned(spark, sf_dir):
    """M2: binned MI of every training feature with the target."""
    return mi_binned(_features_with_combinations(spark, sf_dir), bins=MI_BINS)


def _rounded_scores(spark, sf_dir):
    # scores equal up to summation order must tie in both engines
    scores = mi_binned(_features_with_combinations(spark, sf_dir), bins=MI_BINS)
    return scores.withColumn("MI_Score", F.round("MI_Score", 12))


@register("mi_ranking", norm_sql(f"""WITH s AS ({_mi_scores_sql()})
SELECT "Feature", "MI_Score", row_number() OVER (ORDER BY round("MI_Score", 12) DESC, "Feature") - 1 AS rank FROM s""",
                                 "Feature:s, MI_Score:f, rank:i"))
def q_mi_ranking(spark, sf_dir):
    """MI ranking, descending."""
    return D.mi_ranking(_rounded_scores(spark, sf_dir))


@register("mi_top_n", norm_sql(f"""WITH s AS ({_mi_scores_sql()})
SELECT "Feature", "MI_Score" FROM s ORDER BY round("MI_Score", 12) DESC, "Feature" LIMIT {TOP_N}""", "Feature:s, MI_Score:f"))
def q_mi_top_n(spark, sf_dir):
    """Top-n features of the ranking (a top-n report)."""
    return D.mi_top_n(_rounded_scores(spark, sf_dir), TOP_N)


@register("filter_mi", norm_sql(f"""WITH s AS ({_mi_scores_sql()})
SELECT "Feature" AS feature, "MI_Score" AS mi FROM s WHERE "MI_Score" BETWEEN {MI_RANGE[0]} AND {MI_RANGE[1]}""",
                                "feature:s, mi:f"))
def q_filter_mi(spark, sf_dir):
    """Features whose MI lies in the reference's cut-off range."""
    return filter_by_mi(mi_binned(_features_with_combinations(spark, sf_dir), bins=MI_BINS), *MI_RANGE)


@register("mi_handoff", norm_sql(f"""WITH s AS ({_mi_scores_sql()}),
r AS (SELECT "Feature" AS feature, round("MI_Score", 12) AS mi,
  row_number() OVER (ORDER BY round("MI_Score", 12) DESC, "Feature") - 1 AS rank FROM s)
SELECT feature, mi, rank FROM r WHERE mi BETWEEN {MI_RANGE[0]} AND {MI_RANGE[1]}""", "feature:s, mi:f, rank:i"))
def q_mi_handoff(spark, sf_dir):
    """The ranking written as a file, read back, ranked as in
    the file (by score, then name) and cut to the reference's range."""
    path = io.write_mi_ranking(_rounded_scores(spark, sf_dir), io.scratch_dir(spark, "mi_ranking"))
    return filter_by_mi(D.mi_ranking(io.read_mi_ranking(spark, path)), *MI_RANGE)


# --------------------------------------------------------------------------- #
# metrics on the scored view
# --------------------------------------------------------------------------- #
def _scored(spark, sf_dir):
    return apply_threshold(view(spark, sf_dir, "scored"), THRESHOLD)


PRED = f"CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END"
O_COUNTS = f"""cnt AS (SELECT
  CAST(sum(CASE WHEN target = 1 AND {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN target = 0 AND {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN target = 0 AND {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
  CAST(sum(CASE WHEN target = 1 AND {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(count(*) AS DOUBLE) AS n FROM scored)"""


def _z(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


@register("confusion_matrix", norm_sql(cte("scored") + f"""
SELECT target AS label, {PRED} AS prediction, count(*) AS "count" FROM scored GROUP BY 1, 2""",
    "label:i, prediction:i, count:i"))
def q_confusion_matrix(spark, sf_dir):
    """Confusion matrix at threshold 0.5."""
    return E.confusion_matrix(_scored(spark, sf_dir))


@register("classification_report", norm_sql(cte("scored") + ", " + O_COUNTS + f""",
pr AS (SELECT {_z('tp', 'tp + fp')} AS p1, {_z('tp', 'tp + fn')} AS r1, {_z('tn', 'tn + fn')} AS p0,
  {_z('tn', 'tn + fp')} AS r0, tp + fn AS s1, tn + fp AS s0, {_z('tp + tn', 'n')} AS acc, n FROM cnt),
f AS (SELECT *, {_z('2 * p1 * r1', 'p1 + r1')} AS f1, {_z('2 * p0 * r0', 'p0 + r0')} AS f0 FROM pr)
SELECT '0' AS "row", p0 AS "precision", r0 AS recall, f0 AS f1_score, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', {_z('p0 * s0 + p1 * s1', 'n')}, {_z('r0 * s0 + r1 * s1', 'n')},
  {_z('f0 * s0 + f1 * s1', 'n')}, n FROM f""", "row:s, precision:f, recall:f, f1_score:f, support:i"))
def q_classification_report(spark, sf_dir):
    """Classification report at threshold 0.5."""
    return E.classification_report(_scored(spark, sf_dir))


@register("binary_metrics", norm_sql(cte("scored") + ", " + O_COUNTS + f""",
pr AS (SELECT *, {_z('tp', 'tp + fp')} AS prec, {_z('tp', 'tp + fn')} AS rec, {_z('tn', 'tn + fp')} AS spec FROM cnt),
ll AS (SELECT avg(CAST(target AS DOUBLE) * ln(least(greatest(score, 1e-15), 1 - 1e-15))
  + (1 - CAST(target AS DOUBLE)) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) AS neg_log_loss FROM scored)
SELECT {_z('tp + tn', 'n')} AS accuracy, (rec + spec) / 2 AS balanced_accuracy, prec AS "precision", rec AS recall,
  {_z('2 * prec * rec', 'prec + rec')} AS f1, {_z('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc,
  neg_log_loss FROM pr, ll""",
    "accuracy:f, balanced_accuracy:f, precision:f, recall:f, f1:f, mcc:f, neg_log_loss:f"))
def q_binary_metrics(spark, sf_dir):
    """Accuracy … MCC and negated log loss at threshold 0.5."""
    return E.binary_metrics(_scored(spark, sf_dir))


O_CURVE = """cur AS (SELECT score, pos, neg,
    sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    sum(pos) OVER () AS p_total, sum(neg) OVER () AS n_total
  FROM (SELECT score, CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
        CAST(sum(CASE WHEN target <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS neg FROM scored GROUP BY score) s),
prc AS (SELECT score AS threshold, coalesce(tp / nullif(tp + fp, 0), 0.0) AS "precision",
    CASE WHEN p_total = 0 THEN 1.0 ELSE tp / p_total END AS recall FROM cur)"""


@register("pr_curve", norm_sql(cte("scored") + ", " + O_CURVE + """
SELECT threshold, "precision", recall, 2 * "precision" * recall / ("precision" + recall + 1e-10) AS f1 FROM prc""",
    "threshold:f, precision:f, recall:f, f1:f"))
def q_pr_curve(spark, sf_dir):
    """E5: precision-recall curve over distinct scores."""
    return E.pr_curve(view(spark, sf_dir, "scored"))


@register("best_threshold", norm_sql(cte("scored") + ", " + O_CURVE + """
SELECT threshold, f1 FROM (SELECT threshold, 2 * "precision" * recall / ("precision" + recall + 1e-10) AS f1 FROM prc) c
ORDER BY f1 DESC, threshold ASC LIMIT 1""", "threshold:f, f1:f"))
def q_best_threshold(spark, sf_dir):
    """E5: threshold with the best F1 (lowest on ties)."""
    return E.best_threshold(view(spark, sf_dir, "scored"))


@register("roc_auc", norm_sql(cte("scored") + ", " + O_CURVE + """
SELECT sum(neg * (2 * tp - pos) / 2.0) / (max(p_total) * max(n_total)) AS roc_auc FROM cur""", "roc_auc:f"))
def q_roc_auc(spark, sf_dir):
    """ROC AUC."""
    return E.roc_auc(view(spark, sf_dir, "scored"))


@register("average_precision", norm_sql(cte("scored") + ", " + O_CURVE + """
SELECT sum(pos / p_total * (tp / (tp + fp))) AS average_precision FROM cur""", "average_precision:f"))
def q_average_precision(spark, sf_dir):
    """Average precision (step sum)."""
    return E.average_precision(view(spark, sf_dir, "scored"))


@register("mse", norm_sql(cte("scored") + "SELECT avg(power(score - target, 2)) AS mse FROM scored", "mse:f"))
def q_mse(spark, sf_dir):
    """Mean squared error of score against label (Brier score)."""
    return E.mse(view(spark, sf_dir, "scored"), "target", "score")


def _cv_oracle():
    m = f"""WITH sc AS (SELECT s.client_id, s.target, s.score, f.fold FROM scored s JOIN (
    SELECT client_id, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(concat('42-', CAST(client_id AS VARCHAR))),
      client_id) - 1) % 5 AS INTEGER) AS fold FROM scored) f ON s.client_id = f.client_id),
cnt AS (SELECT fold,
  CAST(sum(CASE WHEN target = 1 AND {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN target = 0 AND {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN target = 0 AND {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
  CAST(sum(CASE WHEN target = 1 AND {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(count(*) AS DOUBLE) AS n,
  avg(CAST(target AS DOUBLE) * ln(least(greatest(score, 1e-15), 1 - 1e-15))
      + (1 - CAST(target AS DOUBLE)) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) AS neg_log_loss FROM sc GROUP BY fold),
pr AS (SELECT *, {_z('tp', 'tp + fp')} AS prec, {_z('tp', 'tp + fn')} AS rec, {_z('tn', 'tn + fp')} AS spec FROM cnt),
e3 AS (SELECT fold, {_z('tp + tn', 'n')} AS accuracy, (rec + spec) / 2 AS balanced_accuracy, prec AS "precision",
  rec AS recall, {_z('2 * prec * rec', 'prec + rec')} AS f1,
  {_z('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc, neg_log_loss FROM pr),
cur AS (SELECT fold, score, pos, neg,
    sum(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    sum(pos) OVER (PARTITION BY fold) AS p_total, sum(neg) OVER (PARTITION BY fold) AS n_total
  FROM (SELECT fold, score, CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
        CAST(sum(CASE WHEN target <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS neg FROM sc GROUP BY fold, score) s),
e4 AS (SELECT fold, sum(neg * (2 * tp - pos) / 2.0) / (max(p_total) * max(n_total)) AS roc_auc,
  sum(pos / p_total * (tp / (tp + fp))) AS average_precision FROM cur GROUP BY fold),
fm AS (SELECT * FROM e3 JOIN e4 USING (fold))"""
    metrics = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "neg_log_loss", "roc_auc",
               "average_precision"]
    body = " UNION ALL ".join(f"""SELECT '{x}' AS metric, avg("{x}") AS mean, stddev_pop("{x}") AS std FROM fm"""
                              for x in metrics)
    return norm_sql(cte("scored") + ", " + m.replace("WITH ", "", 1) + "\n" + body, "metric:s, mean:f, std:f")


@register("cv_metrics", _cv_oracle())
def q_cv_metrics(spark, sf_dir):
    """Metrics per stratified fold of given scores, then mean and
    population std over the folds."""
    scored = view(spark, sf_dir, "scored")
    folds = R.stratified_folds(scored.select("client_id", "target"), k=5, seed=42).select("client_id", "fold")
    return E.cv_metrics(E.fold_metrics(scored.join(folds, "client_id"), THRESHOLD))


@register("apply_threshold", norm_sql(cte("scored") + f"SELECT client_id, target, score, {PRED} AS prediction FROM scored",
                                      "client_id:i, target:i, score:f, prediction:i"))
def q_apply_threshold(spark, sf_dir):
    """label = score ≥ threshold."""
    return _scored(spark, sf_dir)


# --------------------------------------------------------------------------- #
# SQL oracle of the k-NN MI estimator (M1)
# --------------------------------------------------------------------------- #
def _digamma_sql(x: str) -> str:
    from ..functions.columns import _DIGAMMA_SERIES, _DIGAMMA_SHIFT
    y = f"(CAST({x} AS DOUBLE) + {float(_DIGAMMA_SHIFT)})"
    series = f"ln({y}) - 1.0 / (2.0 * {y})" + "".join(f" - ({c!r}) / pow({y}, {p})" for p, c in _DIGAMMA_SERIES)
    rec = " + ".join(f"1.0 / (CAST({x} AS DOUBLE) + {float(i)})" for i in range(_DIGAMMA_SHIFT))
    return f"(({series}) - ({rec}))"


def _mi_knn_sql() -> str:
    feats = [c for c in assemble.TRAIN_COLUMNS if c not in ("client_id", "target")] + [n for n, _ in COMBI_SQL]
    combos = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COMBI_SQL)
    filled = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in feats)
    h32 = "('0x' || substr(md5(concat_ws('-', '50', '{salt}', feature, CAST(id AS VARCHAR))), 1, 8))::BIGINT"
    gap = ", ".join(f"{f}(x, {j}) OVER w" for j in (1, 2, 3) for f in ("lag", "lead"))
    return f"""WITH ft AS ({feature_oracle(True, raw=True)}),
fc AS (SELECT *, {combos} FROM ft),
filled AS (SELECT client_id AS id, CAST(target AS INTEGER) AS y, {filled} FROM fc),
lf AS (UNPIVOT filled ON {', '.join(feats)} INTO NAME feature VALUE x),
sc AS (SELECT feature, id, y, x / CASE WHEN stddev_pop(x) OVER (PARTITION BY feature) > 0
         THEN stddev_pop(x) OVER (PARTITION BY feature) ELSE 1.0 END AS x FROM lf),
nz AS (SELECT feature, id, y, x + 1e-10 * greatest(1.0, avg(abs(x)) OVER (PARTITION BY feature))
         * (sqrt(-2.0 * ln((CAST({h32.format(salt='n1')} AS DOUBLE) + 0.5) / 4294967296.0))
            * cos(2.0 * 3.141592653589793 * ((CAST({h32.format(salt='n2')} AS DOUBLE) + 0.5) / 4294967296.0))) AS x
       FROM sc),
sized AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_y FROM nz),
pts AS (SELECT *, least(3, n_y - 1) AS k_i FROM sized WHERE n_y > 1),
nb AS (SELECT feature, id, y, x, n_y, k_i, list_sort(list_filter([{gap}], lambda v: v IS NOT NULL)) AS nbs FROM pts
       WINDOW w AS (PARTITION BY feature, y ORDER BY x, id)),
rad AS (SELECT feature, id, y, x, n_y, k_i, list_sort(list_transform(nbs, lambda v: abs(v - x)))[k_i] AS r FROM nb),
cnt AS (SELECT a.feature, a.id, count(*) AS m FROM rad a JOIN pts b ON a.feature = b.feature
          AND b.x >= a.x - 2 * a.r AND b.x <= a.x + 2 * a.r
        WHERE (a.r > 0 AND abs(b.x - a.x) < a.r) OR (a.r = 0 AND b.x = a.x)
        GROUP BY a.feature, a.id),
per AS (SELECT rad.feature, rad.k_i, rad.n_y, cnt.m FROM rad JOIN cnt ON rad.feature = cnt.feature AND rad.id = cnt.id)
SELECT feature AS "Feature", greatest(0.0, {_digamma_sql('count(*)')} + avg({_digamma_sql('k_i')})
  - avg({_digamma_sql('n_y')}) - avg({_digamma_sql('m')})) AS "MI_Score" FROM per GROUP BY feature"""


ORACLES["mi_knn"] = norm_sql(_mi_knn_sql(), "Feature:s, MI_Score:f")
