"""Registered model, source/sink, projection and join queries.

Model queries (L*, B4) are trained on Spark ML, so they have no SQL oracle
(the driver checks rows only); tests cover their mechanics and persistence on
small tables, not the quality of these queries' models.  Source, projection
and join queries have oracles.
"""

from __future__ import annotations

import os

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import persist as P
from ..operators import profile as D
from ..operators import sampling as R
from ..operators import strategies as C
from ..operators import synthetic as S
from ..operators.client_features import starter_aggregates
from ..operators.jobs import Ledger, fits_at_once, write_sized
from ..operators.joins import align_by_position, align_files, left_join_on, merge_on
from ..operators.metrics import cv_metrics, mse
from ..operators.projections import (add_combinations, apply_threshold, cast_categoricals, combine_features,
                                     drop_columns, encode_counter_type, fill_constants, fill_zero, impute_mean,
                                     log_transform, null_to_zero_features, select_features, select_numeric)
from ..session import cut_lineage, ensure_checkpoint_dir, shared_path
from ..sources import io
from ..sources.fixtures import cte, read_base, view, views
from . import assemble
from .feature_queries import feature_oracle
from .registry import norm_sql, register

SEED = 42
GBT_QUERY_PARAMS = {"n_estimators": 150, "max_depth": 6, "learning_rate": 0.1}
STARTER_PARAMS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1}  # the starter's misspelt 500 leaves the default of 100; it grows 31 leaves
SEARCH_DRAWS = 50
CHAIN_DRAWS = 30
SEARCH_FOLDS = 5
BAGS = 10
PARALLEL_FITS = 8


def search_draws():
    """The draws of the registered search: the reference's number and ranges."""
    return L.draw_params(SEARCH_DRAWS, seed=SEED)


# --------------------------------------------------------------------------- #
# model input
# --------------------------------------------------------------------------- #
def model_table(spark, sf_dir, combinations: bool = True):
    """Training features (NULL → 0) with a stratified 5-fold column; written
    once to the shared checkpoint folder because every fit reads it."""
    client, invoice = views(spark, sf_dir, "client", "invoice")
    ft = assemble.features_train(client, invoice)
    if combinations:
        ft = add_combinations(ft)
    data = cut_lineage(null_to_zero_features(ft), "model-features")  # the folds read it more than once
    data = R.stratified_folds(data, k=5, seed=SEED)
    return cut_lineage(data)


def feature_list(df):
    return [c for c in df.columns if c not in ("client_id", "target", "fold", "weight", "is_test", "copy", "bag")]


def _split(data):
    """Training and hold-out rows; written once, because statistics, weights, fit and scoring each read them."""
    s = cut_lineage(R.stratified_split(data, test_size=0.3, seed=SEED), "split")
    return s.filter(F.col("is_test") == 0).drop("is_test"), s.filter(F.col("is_test") == 1).drop("is_test")


def _fit_rows(df, cols):
    """Vectors of the rows, in as many files as their bytes need (every tree reads them once a level)."""
    return write_sized(L.assemble(df, cols), shared_path(df.sparkSession, "tables", "fit-rows"))


def _scored(model, df, threshold=0.5):
    out = L.positive_probability(model.transform(df))
    return apply_threshold(out, threshold).select("client_id", "target", "score", "prediction")


@register("standardize", norm_sql(f"""WITH ft AS ({feature_oracle(True, raw=True)})
SELECT client_id, target, """ + ", ".join(
    f"coalesce((coalesce(CAST({c} AS DOUBLE), 0.0) - avg(coalesce(CAST({c} AS DOUBLE), 0.0)) OVER ()) / "
    f"nullif(stddev_pop(coalesce(CAST({c} AS DOUBLE), 0.0)) OVER (), 0), 0.0) AS {c}"
    for c in assemble.TRAIN_COLUMNS[2:]) + " FROM ft",
    ", ".join(["client_id:i", "target:i"] + [f"{c}:f" for c in assemble.TRAIN_COLUMNS[2:]])))
def q_standardize(spark, sf_dir):
    """L1: feature matrix standardised with population std."""
    client, invoice = views(spark, sf_dir, "client", "invoice")
    data = null_to_zero_features(assemble.features_train(client, invoice))
    return L.standardize(data, assemble.TRAIN_COLUMNS[2:])


@register("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    """L2: balanced, L2-regularised logistic regression on standardised
    features; scores of the 30 % hold-out."""
    data = model_table(spark, sf_dir, combinations=False)
    cols = feature_list(data)
    train, test = _split(data)
    train, test = L.standardize(train, cols, test)
    train = R.balanced_weight(train)
    total_w = train.agg(F.sum("weight")).first()[0]
    model = L.logistic("weight", c=1.0, total_weight=total_w).fit(_fit_rows(train, cols))
    return _scored(model, L.assemble(test, cols))


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    """L3: boosted trees with the class-ratio weight; hold-out scores."""
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    train, test = _split(data)
    train = R.with_class_weight(train)
    model = L.gbt(weight_col="weight", **GBT_QUERY_PARAMS).fit(_fit_rows(train, cols))
    return _scored(model, L.assemble(test, cols))


@register("resampled_fit")
def q_resampled_fit(spark, sf_dir):
    """Over-sample (R5) inside the estimator, then boosted trees."""
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    train, test = _split(data)
    est = L.ResampledEstimator(inner=L.gbt(**GBT_QUERY_PARAMS),
                               sampler=lambda d: R.random_oversample(d, seed=SEED).drop("copy"))
    model = est.fit(_fit_rows(train, cols))
    return _scored(model, L.assemble(test, cols))


@register("fit_bagged")
def q_fit_bagged(spark, sf_dir):
    """Ten boosted-tree models on balanced bags, mean probability."""
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    train, test = _split(data)
    bags = L.assemble(R.balanced_bags(train, n_bags=BAGS, seed=SEED), cols).select("target", "bag", "features")
    models = L.fit_bagged(bags, lambda: L.gbt(**GBT_QUERY_PARAMS), BAGS, parallelism=BAGS)
    scores = L.score_bagged(models, L.assemble(test, cols))
    return apply_threshold(scores.join(test.select("client_id", "target"), "client_id"), 0.5)


@register("fit_linear")
def q_fit_linear(spark, sf_dir):
    """Linear regression on the harvest template data (training-mean
    imputation, 20 % hold-out); MSE of the hold-out."""
    h = view(spark, sf_dir, "harvest").withColumnRenamed("row_id", "client_id")
    s = R.random_split(h, test_size=0.2, seed=SEED)
    cols = ["quakers", "altitude_low_meters", "altitude_high_meters", "altitude_mean_meters"]
    train, test = impute_mean(s.filter("is_test = 0"), s.filter("is_test = 1"), columns=cols)
    model = L.linear("quality_score").fit(L.assemble(train, cols))
    return mse(model.transform(L.assemble(test, cols)), "quality_score")


def _vector_rows(sampler):
    """A sampler of rows for (client_id, target, features)."""
    return lambda d: sampler(d).select("target", "features")


def strategy_samplers():
    """The strategies against imbalance; None keeps the rows (class weights act in the learner)."""
    return {
        "scale_pos_weight": None,
        "RandomOverSampler": _vector_rows(lambda d: R.random_oversample_drawn(d, seed=SEED)),
        "SMOTE": vector_sampler(lambda p: S.smote_drawn(p, seed=SEED)),
        "ADASYN": vector_sampler(lambda p: S.adasyn(p, seed=SEED)),
        "SMOTETomek": vector_sampler(lambda p: S.smote_tomek(p, seed=SEED)),
    }


def strategy_estimator(strategy, params):
    return L.gbt(weight_col="weight" if strategy == "scale_pos_weight" else None, **params)


def fold_store(spark, sf_dir, strategies):
    """The fold store over the training features and its ledger; both are found again by a later run over the same rows."""
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    name = C.fingerprint(data.select("client_id", "target", "fold", *[F.round(c, 6).alias(c) for c in cols]))
    rows = L.assemble(R.with_class_weight(data), cols).select("client_id", "target", "weight", "fold", "features")
    folder = os.path.join(ensure_checkpoint_dir(spark), "strategies", name)
    kept = write_sized(rows, os.path.join(folder, "rows"))
    samplers = {k: v for k, v in strategy_samplers().items() if k in strategies}
    return C.FoldStore(kept, samplers, folder), Ledger(spark, os.path.join(folder, "ledger")), cols


@register("random_search")
def q_random_search(spark, sf_dir):
    """Random search over boosted-tree parameters, over-sampling
    inside each stratified fold, F1 of class 1; returns the F1 of every draw."""
    store, ledger, _ = fold_store(spark, sf_dir, ["RandomOverSampler"])
    draws = search_draws()
    found = C.search(store, draws, strategy_estimator, parallelism=fits_at_once(store.data, PARALLEL_FITS), ledger=ledger)["RandomOverSampler"]
    rows = [(i, f, str(sorted(d.items()))) for i, (f, d) in enumerate(zip(found, draws))]
    return spark.createDataFrame(rows, "draw int, mean_f1 double, params string")


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    """5-fold out-of-fold metrics of the class-weight model, mean
    and population std per metric."""
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    d = L.assemble(R.with_class_weight(data), cols).select("client_id", "target", "weight", "fold", "features")
    scored = cut_lineage(L.cross_validated_scores(d, L.gbt(weight_col="weight", **GBT_QUERY_PARAMS)))
    return cv_metrics(L.fold_metrics(scored))


@register("score_test")
def q_score_test(spark, sf_dir):
    """Fit on the training table, score the test table (with
    transferred rates), scores as submitted (client_id, target=P(1))."""
    client, invoice = views(spark, sf_dir, "client", "invoice")
    train = model_table(spark, sf_dir, combinations=False)
    cols = feature_list(train)
    tables = assemble.invoice_tables(invoice)
    test = null_to_zero_features(assemble.transfer_rates(assemble.features_test(client, invoice, tables),
                                                         assemble.features_train(client, invoice, tables)))
    model = L.gbt(weight_col="weight", **GBT_QUERY_PARAMS).fit(_fit_rows(R.with_class_weight(train), cols))
    scored = L.positive_probability(model.transform(L.assemble(test.select("client_id", *cols), cols)))
    return scored.select("client_id", F.col("score").alias("target"))


def _points(spark, sf_dir, split=True):
    data = model_table(spark, sf_dir)
    cols = feature_list(data)
    train = _split(data)[0] if split else data
    return S.to_points(train, "target", "client_id", cols), cols


def _unpack(points, cols):
    return points.select("key", F.col("label").alias("target"), "synthetic",
                         *[F.col("vec")[i].alias(c) for i, c in enumerate(cols)])


@register("smote")
def q_smote(spark, sf_dir):
    """SMOTE (k = 5) of the training features to equal class sizes."""
    pts, cols = _points(spark, sf_dir, split=False)
    return _unpack(S.smote(pts, seed=SEED), cols)


@register("adasyn")
def q_adasyn(spark, sf_dir):
    """ADASYN (k = 5) of the training features."""
    pts, cols = _points(spark, sf_dir, split=False)
    return _unpack(S.adasyn(pts, seed=SEED), cols)


def _tomek_oracle():
    from .report_queries import COMBI_SQL
    feats = assemble.TRAIN_COLUMNS[2:] + [n for n, _ in COMBI_SQL]
    combos = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COMBI_SQL)
    vec = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0)" for f in feats)
    cols = ", ".join(f"vec[{i + 1}] AS {f}" for i, f in enumerate(feats))
    sql = f"""WITH ft AS ({feature_oracle(True, raw=True)}),
fc AS (SELECT *, {combos} FROM ft),
pts AS (SELECT CAST(client_id AS VARCHAR) AS key, target AS label, [{vec}] AS vec FROM fc),
nn AS (SELECT a.key AS a, arg_min(b.key, struct_pack(d := list_distance(a.vec, b.vec), k := b.key)) AS b
  FROM pts a, pts b WHERE a.key <> b.key GROUP BY a.key),
links AS (SELECT n1.a FROM nn n1 JOIN nn n2 ON n1.b = n2.a AND n2.b = n1.a
  JOIN pts p1 ON p1.key = n1.a JOIN pts p2 ON p2.key = n1.b WHERE p1.label <> p2.label)
SELECT key, label AS target, 0 AS synthetic, {cols} FROM pts WHERE key NOT IN (SELECT a FROM links)"""
    return norm_sql(sql, ", ".join(["key:s", "target:i", "synthetic:i"] + [f"{f}:f" for f in feats]))


@register("tomek_clean", _tomek_oracle())
def q_tomek_clean(spark, sf_dir):
    """Training rows without their Tomek links."""
    pts, cols = _points(spark, sf_dir, split=False)
    return _unpack(S.tomek_clean(pts.withColumn("synthetic", F.lit(0))), cols)


@register("smote_tomek")
def q_smote_tomek(spark, sf_dir):
    """SMOTE followed by Tomek-link removal."""
    pts, cols = _points(spark, sf_dir, split=False)
    return _unpack(S.smote_tomek(pts, seed=SEED), cols)


def vector_sampler(method):
    """Wrap a point sampler for Spark ML rows (target, features vector)."""
    def run(d):
        pts = d.select(F.col("client_id").cast("string").alias("key"), F.col("target").alias("label"),
                       vector_to_array("features").alias("vec"))
        return S.as_training_rows(method(pts))
    return run


@register("compare_strategies")
def q_compare_strategies(spark, sf_dir):
    """For each imbalance strategy search, cross-validated metrics, threshold and submission file."""
    store, ledger, cols = fold_store(spark, sf_dir, list(strategy_samplers()))
    client, invoice = views(spark, sf_dir, "client", "invoice")
    tables = assemble.invoice_tables(invoice)
    test = assemble.transfer_rates(assemble.features_test(client, invoice, tables), assemble.features_train(client, invoice, tables))
    test = null_to_zero_features(add_combinations(test))
    vectors = cut_lineage(L.assemble(test.select("client_id", *cols), cols).select("client_id", "features"), "test-vectors")
    return C.compare(store, L.draw_params(CHAIN_DRAWS, seed=SEED), strategy_estimator, vectors, os.path.join(store.folder, "chain"),
                     parallelism=fits_at_once(store.data, PARALLEL_FITS), ledger=ledger)


HARVEST_NUMBERS = ["quakers", "altitude_low_meters", "altitude_high_meters", "altitude_mean_meters"]


@register("predict_saved")
def q_predict_saved(spark, sf_dir):
    """A pipeline of null filling, combined column, scaling and regression is
    fitted, saved, loaded, and scores a held-out file; its predictions beside
    those of the pipeline that was never saved."""
    h = view(spark, sf_dir, "harvest").withColumnRenamed("row_id", "client_id")
    parts = R.random_split(h, test_size=0.2, seed=SEED)
    train, held = parts.filter("is_test = 0").drop("is_test"), parts.filter("is_test = 1").drop("is_test")
    features = [*HARVEST_NUMBERS, "altitude_range"]
    stages = [P.MeanFill(columns=HARVEST_NUMBERS), P.Combinations(specs=[["altitude_range", "altitude_high_meters", "-", "altitude_low_meters"]]),
              P.NullFill(columns=features), P.Standardizer(columns=features), L.assembler(features), L.linear("quality_score")]
    model = L.pipeline(stages).fit(train)
    again = L.load_pipeline(L.save_model(model, shared_path(spark, "models", "harvest")))
    file = io.write_one_csv(held.select("client_id", *HARVEST_NUMBERS, "quality_score"), os.path.join(io.scratch_dir(spark, "held-out"), "held.csv"), ["client_id"])
    schema = "client_id long, " + ", ".join(f"{c} double" for c in [*HARVEST_NUMBERS, "quality_score"])
    rows = io.read_table(spark, file, schema, fmt="csv")
    fresh = model.transform(held).select("client_id", F.col("prediction").alias("fresh"))
    return again.transform(rows).select("client_id", "quality_score", "prediction").join(fresh, "client_id")


@register("starter_pipeline")
def q_starter_pipeline(spark, sf_dir):
    """Starter model — client columns + invoice count and mean levels,
    boosted trees, predicted labels for every client."""
    client, invoice = views(spark, sf_dir, "client", "invoice")
    base = cast_categoricals(client).join(starter_aggregates(invoice), "client_id", "left")
    data = fill_zero(drop_columns(base, "creation_date"))
    cols = [c for c in data.columns if c not in ("client_id", "target")]
    model = L.gbt(**STARTER_PARAMS).fit(_fit_rows(data, cols))
    pred = model.transform(L.assemble(data.drop("target"), cols))
    return pred.select("client_id", F.col("prediction").cast("int").alias("target"))


# --------------------------------------------------------------------------- #
# sources and sinks
# --------------------------------------------------------------------------- #
@register("scan_catalog", norm_sql("""SELECT 'customer' AS name, count(*) AS n_rows FROM customer
UNION ALL SELECT 'nation', count(*) FROM nation""", "name:s, n_rows:i"))
def q_scan_catalog(spark, sf_dir):
    """Catalog over files (a repeated path is read once)."""
    paths = [f"{sf_dir}/customer.parquet", f"{sf_dir}/nation.parquet", f"{sf_dir}/customer.parquet"]
    cat = io.Catalog(spark, paths)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(os.path.basename(k).split(".")[0]).alias("name"),
                                                             "n_rows") for k, df in cat.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("extract_target", norm_sql(cte("client") + "SELECT client_id, target FROM client", "client_id:i, target:i"))
def q_extract_target(spark, sf_dir):
    """The client table written as CSV, read back through the
    catalog with an explicit schema; target of the first table holding it."""
    folder = io.scratch_dir(spark, "client_csv")
    io.write_csv(view(spark, sf_dir, "client"), folder)
    schema = "client_id long, disrict int, region int, client_catg int, creation_date date, target int"
    cat = io.Catalog(spark, [folder], target_column="target", schemas={os.path.basename(folder).split(".")[0]: schema})
    return cat.target


@register("export_predictions", norm_sql(cte("scored") + "SELECT client_id, score AS target FROM scored",
                                         "client_id:i, target:f"))
def q_export_predictions(spark, sf_dir):
    """Chosen prediction columns written as CSV and read back."""
    folder = os.path.join(io.scratch_dir(spark, "predictions"), "predictions.csv")
    io.export_predictions(view(spark, sf_dir, "scored").drop("target").withColumnRenamed("score", "target"), folder)
    return io.read_table(spark, folder, "client_id long, target double", fmt="csv")


@register("export_scores", norm_sql(cte("scored") + "SELECT client_id, printf('%.16f', score) AS target FROM scored",
                                    "client_id:i, target:s"))
def q_export_scores(spark, sf_dir):
    """Scores as %.16f text in a file named by strategy and threshold."""
    folder = io.scratch_dir(spark, "scores")
    path = io.export_scores(view(spark, sf_dir, "scored").drop("target").withColumnRenamed("score", "target"),
                            folder, "scale_pos_weight", 0.744)
    return io.read_table(spark, path, "client_id long, target string", fmt="csv")


@register("split_roundtrip", norm_sql(cte("client") + """
SELECT client_id, target, CASE WHEN rk <= round(n * 0.2) THEN 1 ELSE 0 END AS is_test FROM (
  SELECT client_id, target, row_number() OVER (ORDER BY md5(concat('42-', CAST(client_id AS VARCHAR))), client_id) AS rk,
  count(*) OVER () AS n FROM client) t""", "client_id:i, target:i, is_test:i"))
def q_split_roundtrip(spark, sf_dir):
    """A random 20 % split written as Parquet and read back."""
    s = R.random_split(view(spark, sf_dir, "client").select("client_id", "target"), test_size=0.2, seed=SEED)
    folder = io.scratch_dir(spark, "split")
    io.write_parquet(s, folder)
    return spark.read.parquet(folder)


# --------------------------------------------------------------------------- #
# projections and joins
# --------------------------------------------------------------------------- #
@register("drop_columns", norm_sql(cte("client") + "SELECT disrict, region, client_catg FROM client",
                                   "disrict:i, region:i, client_catg:i"))
def q_drop_columns(spark, sf_dir):
    """Drop id, target and date columns."""
    return drop_columns(view(spark, sf_dir, "client"), "client_id", "target", "creation_date")


@register("select_numeric", norm_sql(cte("harvest") + """SELECT row_id, quakers, altitude_low_meters,
  altitude_high_meters, altitude_mean_meters, quality_score FROM harvest""",
    "row_id:i, quakers:f, altitude_low_meters:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f"))
def q_select_numeric(spark, sf_dir):
    """Numeric columns of the harvest table."""
    return select_numeric(view(spark, sf_dir, "harvest"))


@register("select_features", norm_sql(cte("scored", "client") + """SELECT s.client_id, s.target, c.disrict, s.score
FROM scored s JOIN client c ON s.client_id = c.client_id""", "client_id:i, target:i, disrict:i, score:f"))
def q_select_features(spark, sf_dir):
    """Keep id, target and a named feature list."""
    scored, client = views(spark, sf_dir, "scored", "client")
    return select_features(scored.join(client.select("client_id", "disrict"), "client_id"), ["disrict", "score"])


@register("fill_zero", norm_sql(cte("harvest") + """SELECT row_id, quakers, coalesce(altitude_low_meters, 0) AS altitude_low_meters,
  coalesce(altitude_high_meters, 0) AS altitude_high_meters, coalesce(altitude_mean_meters, 0) AS altitude_mean_meters,
  quality_score FROM harvest""",
    "row_id:i, quakers:f, altitude_low_meters:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f"))
def q_fill_zero(spark, sf_dir):
    """P5: NULL → 0 in every numeric column."""
    return fill_zero(view(spark, sf_dir, "harvest"))


FILL_CONSTANTS = {"altitude_low_meters": 1000.0, "altitude_high_meters": 1500.0, "altitude_mean_meters": 1250.0}


@register("fill_constants", norm_sql(cte("harvest") + """SELECT row_id, quakers, coalesce(altitude_low_meters, 1000.0) AS altitude_low_meters,
  coalesce(altitude_high_meters, 1500.0) AS altitude_high_meters, coalesce(altitude_mean_meters, 1250.0) AS altitude_mean_meters,
  quality_score FROM harvest""",
    "row_id:i, quakers:f, altitude_low_meters:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f"))
def q_fill_constants(spark, sf_dir):
    """NULL → a constant per column."""
    return fill_constants(view(spark, sf_dir, "harvest"), FILL_CONSTANTS)


@register("impute_mean", norm_sql(cte("harvest") + """SELECT row_id, quakers,
  coalesce(altitude_low_meters, avg(altitude_low_meters) OVER ()) AS altitude_low_meters,
  coalesce(altitude_high_meters, avg(altitude_high_meters) OVER ()) AS altitude_high_meters,
  coalesce(altitude_mean_meters, avg(altitude_mean_meters) OVER ()) AS altitude_mean_meters, quality_score FROM harvest""",
    "row_id:i, quakers:f, altitude_low_meters:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f"))
def q_impute_mean(spark, sf_dir):
    """NULL → column mean."""
    return impute_mean(view(spark, sf_dir, "harvest"),
                       columns=["altitude_low_meters", "altitude_high_meters", "altitude_mean_meters"])


@register("log_transform", norm_sql(cte("harvest") + """SELECT row_id, quakers, altitude_high_meters, altitude_mean_meters,
  quality_score, CASE WHEN altitude_low_meters > 0 THEN ln(altitude_low_meters) END AS log_altitude_low_meters FROM harvest""",
    "row_id:i, quakers:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f, log_altitude_low_meters:f"))
def q_log_transform(spark, sf_dir):
    """Log of a column, source dropped."""
    return log_transform(view(spark, sf_dir, "harvest"), ["altitude_low_meters"])


@register("combine_features", norm_sql(cte("harvest") + """SELECT *, quality_score / nullif(quakers + 0.1, 0) AS ratio FROM harvest""",
    "row_id:i, quakers:f, altitude_low_meters:f, altitude_high_meters:f, altitude_mean_meters:f, quality_score:f, ratio:f"))
def q_combine_features(spark, sf_dir):
    """Smoothed ratio of two columns, appended last."""
    return combine_features(view(spark, sf_dir, "harvest"), "quality_score", "quakers", "/", "ratio")


@register("add_combinations", norm_sql(
    f"""WITH ft AS ({feature_oracle(True, raw=True)}) SELECT client_id, """ + ", ".join(
        f"CAST({e} AS DOUBLE) AS {n}" for n, e in [
            ("f_combi1", "avg_remarque_length * f_counter_number_nunique"),
            ("f_combi2", "remarque_frequency * f_tarif_change_count"),
            ("f_combi3", "f_total_consumption_std / nullif(f_counter_statue_error_occured + 0.1, 0)"),
            ("f_combi4", "f_region_std_deviation_consumption_level_3 * f_index_diff_mean"),
            ("f_combi5", "f_counter_number_nunique * remarque_frequency"),
            ("f_combi6", "f_counter_statue_error_occured * remarque_frequency"),
            ("f_combi7", "f_index_diff_mean * remarque_frequency")]) + " FROM ft",
    "client_id:i, " + ", ".join(f"f_combi{i}:f" for i in range(1, 8))))
def q_add_combinations(spark, sf_dir):
    """The seven combined features of the training table."""
    client, invoice = views(spark, sf_dir, "client", "invoice")
    out = add_combinations(assemble.features_train(client, invoice))
    return out.select("client_id", *[f"f_combi{i}" for i in range(1, 8)])


@register("encode_counter_type", norm_sql(cte("invoice") + """SELECT client_id, counter_number,
  CASE counter_type WHEN 'ELEC' THEN 0 WHEN 'GAZ' THEN 1 END AS counter_type FROM invoice""",
    "client_id:i, counter_number:i, counter_type:i"))
def q_encode_counter_type(spark, sf_dir):
    """ELEC → 0, GAZ → 1."""
    return encode_counter_type(view(spark, sf_dir, "invoice").select("client_id", "counter_number", "counter_type"))


@register("cast_categoricals", norm_sql(cte("client") + "SELECT client_id, CAST(client_catg AS INTEGER) AS client_catg, "
                                        "CAST(disrict AS INTEGER) AS disrict FROM client",
                                        "client_id:i, client_catg:i, disrict:i"))
def q_cast_categoricals(spark, sf_dir):
    """Categorical codes as integers (from text)."""
    c = view(spark, sf_dir, "client").select("client_id", F.col("client_catg").cast("string").alias("client_catg"),
                                            F.col("disrict").cast("string").alias("disrict"))
    return cast_categoricals(c)


@register("left_join_on", norm_sql(cte("client") + """SELECT c.client_id, c.disrict, n.n_name, n.n_regionkey
FROM client c LEFT JOIN nation n ON c.disrict = n.n_nationkey""", "client_id:i, disrict:i, n_name:s, n_regionkey:i"))
def q_left_join_on(spark, sf_dir):
    """Left join with a validated one-to-many key."""
    client = view(spark, sf_dir, "client").select("client_id", "disrict")
    nation = read_base(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "disrict")
    return left_join_on("disrict", client, nation.select("disrict", "n_name", "n_regionkey"), validate="many_to_one")


@register("transfer_rates", norm_sql(cte("client") + """SELECT c.client_id, c.disrict, r.rate
FROM client c LEFT JOIN (SELECT DISTINCT disrict, rate FROM (
  SELECT disrict, avg(CAST(target AS DOUBLE)) OVER (PARTITION BY disrict) AS rate FROM client) x) r ON c.disrict = r.disrict""",
    "client_id:i, disrict:i, rate:f"))
def q_transfer_rates(spark, sf_dir):
    """Distinct (key, value) pairs of one table attached to another."""
    client = view(spark, sf_dir, "client")
    rates = client.groupBy("disrict").agg(F.avg(F.col("target").cast("double")).alias("rate")).join(
        client.select("client_id", "disrict"), "disrict")
    return merge_on(client.select("client_id", "disrict"), rates, "disrict", "rate")


@register("align_files", norm_sql(cte("harvest") + "SELECT row_number() OVER (ORDER BY row_id) AS row_pos, row_id, quakers, quality_score FROM harvest",
                                  "row_pos:i, row_id:i, quakers:f, quality_score:f"))
def q_align_files(spark, sf_dir):
    """A file of features and a file of ratings without a common column, paired row by row."""
    h = view(spark, sf_dir, "harvest")
    folder = io.scratch_dir(spark, "pair")
    x = io.write_one_csv(h.select("row_id", "quakers"), os.path.join(folder, "x.csv"), ["row_id"])
    ordered = h.repartitionByRange(3, "row_id").sortWithinPartitions("row_id").select("quality_score")
    y = io.write_csv(ordered, os.path.join(folder, "y"))
    read = spark.read.option("header", True)
    return align_files(read.schema("row_id long, quakers double").csv(x), read.schema("quality_score double").csv(y))


@register("fetch_csv", norm_sql(cte("client") + "SELECT client_id, region, target FROM client", "client_id:i, region:i, target:i"))
def q_fetch_csv(spark, sf_dir):
    """A CSV behind a URL, fetched once into the shared folder and read from there."""
    path = io.write_one_csv(view(spark, sf_dir, "client").select("client_id", "region", "target"),
                            os.path.join(io.scratch_dir(spark, "web"), "client.csv"), ["client_id"])
    return io.read_table(spark, io.fetch_once(spark, f"file://{path}"), "client_id long, region int, target int", fmt="csv")


@register("distinct_sketches", norm_sql(cte("invoice") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, true AS within FROM invoice" for c in ("client_id", "counter_number", "tarif_type", "invoice_date")),
    "column:s, n_distinct:i, within:b"))
def q_distinct_sketches(spark, sf_dir):
    """Distinct counts from mergeable sketches of each region's invoices, and whether they are within the error bound of the exact ones."""
    columns = ["client_id", "counter_number", "tarif_type", "invoice_date"]
    invoice = view(spark, sf_dir, "invoice").select(*columns)
    kept = cut_lineage(D.distinct_sketches(invoice, ["tarif_type"], [c for c in columns if c != "tarif_type"]), "sketches")
    tarif = D.distinct_sketches(invoice, columns=["tarif_type"])
    near = D.distinct_from_sketches(kept.select("column", "sketch").unionByName(tarif)).withColumnRenamed("n_distinct", "near")
    both = D.distinct_report(invoice).join(near, "column")
    return both.select("column", "n_distinct", (F.abs(F.col("near") - F.col("n_distinct")) <= D.sketch_error() * F.col("n_distinct") + 1).alias("within"))


@register("align_by_position", norm_sql(cte("harvest") + """SELECT a.row_pos, a.row_id, a.quakers, b.quality_score FROM
  (SELECT row_number() OVER (ORDER BY row_id) AS row_pos, row_id, quakers FROM harvest) a JOIN
  (SELECT row_number() OVER (ORDER BY row_id) AS row_pos, quality_score FROM harvest) b ON a.row_pos = b.row_pos""",
    "row_pos:i, row_id:i, quakers:f, quality_score:f"))
def q_align_by_position(spark, sf_dir):
    """Features and ratings paired by row position."""
    h = view(spark, sf_dir, "harvest")
    return align_by_position(h.select("row_id", "quakers"), h.select(F.col("row_id").alias("rid"), "quality_score"),
                             "row_id", "rid").drop("rid")


# --------------------------------------------------------------------------- #
# SQL oracles of the k-NN samplers (brute-force neighbours, same md5 draws)
# --------------------------------------------------------------------------- #
def _sampler_sql(kind: str) -> str:
    from .report_queries import COMBI_SQL
    feats = assemble.TRAIN_COLUMNS[2:] + [n for n, _ in COMBI_SQL]
    combos = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COMBI_SQL)
    vec = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0)" for f in feats)
    newv = ", ".join(f"vec[{i + 1}] + u * (nvec[{i + 1}] - vec[{i + 1}])" for i in range(len(feats)))
    h32 = "('0x' || substr(md5(concat_ws('-', '{seed}', '{salt}', {a}, CAST({b} AS VARCHAR))), 1, 8))::BIGINT"
    nn_draw = h32.format(seed=SEED, salt="nn", a="d.key", b="d.s")
    u_draw = h32.format(seed=SEED, salt="u", a="d.key", b="d.s")
    head = f"""WITH ft AS ({feature_oracle(True, raw=True)}),
fc AS (SELECT *, {combos} FROM ft),
pts AS (SELECT CAST(client_id AS VARCHAR) AS key, target AS label, [{vec}] AS vec FROM fc),
cls AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
st AS (SELECT arg_max(label, n * 10 - label) AS maj, arg_min(label, n * 10 + label) AS mino,
  max(n) AS n_maj, min(n) AS n_min FROM cls),
mino AS (SELECT p.* FROM pts p, st WHERE p.label = st.mino),
mnn AS (SELECT a.key, b.key AS rid, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key)
  AS nn_rank FROM mino a, mino b WHERE a.key <> b.key QUALIFY nn_rank <= 5),
kf AS (SELECT key, count(*) AS k_found FROM mnn GROUP BY key),"""
    if kind == "smote":
        counts = """cnt AS (SELECT m.key, st.n_maj - st.n_min AS g, st.n_min,
    row_number() OVER (ORDER BY md5('42-' || m.key), m.key) AS rk FROM mino m, st),
nnew AS (SELECT key, g // n_min + CASE WHEN rk <= g % n_min THEN 1 ELSE 0 END AS n_new FROM cnt),"""
        base = "pts"
    else:
        counts = """anb AS (SELECT a.key, b.label AS nl, row_number() OVER (PARTITION BY a.key
    ORDER BY list_distance(a.vec, b.vec), b.key) AS r FROM mino a, pts b WHERE a.key <> b.key QUALIFY r <= 5),
hard AS (SELECT anb.key, sum(CASE WHEN anb.nl <> st.mino THEN 1.0 ELSE 0.0 END) / 5 AS ratio FROM anb, st GROUP BY anb.key),
nnew AS (SELECT h.key, CAST(round_even(h.ratio / (SELECT sum(ratio) FROM hard) * (st.n_maj - st.n_min), 0) AS BIGINT)
  AS n_new FROM hard h, st),"""
        base = "pts"
    gen = f"""d AS (SELECT n.key, k.k_found, s FROM nnew n JOIN kf k ON n.key = k.key, range(1, n.n_new + 1) t(s)
  WHERE n.n_new > 0),
dr AS (SELECT d.key, d.s, 1 + {nn_draw} % d.k_found AS nn_rank, ({u_draw} + 0.5) / 4294967296.0 AS u FROM d),
syn AS (SELECT dr.key || '#' || CAST(dr.s AS VARCHAR) AS key, st.mino AS label, 1 AS synthetic, [{newv}] AS vec
  FROM dr JOIN mnn ON dr.key = mnn.key AND dr.nn_rank = mnn.nn_rank
  JOIN mino a ON a.key = dr.key JOIN (SELECT key AS rid, vec AS nvec FROM mino) b ON b.rid = mnn.rid, st),
res AS (SELECT key, label, 0 AS synthetic, vec FROM {base} UNION ALL SELECT key, label, synthetic, vec FROM syn)"""
    return head + counts + gen, feats


def _unpacked_sql(body: str, feats, source: str = "res") -> str:
    cols = ", ".join(f"vec[{i + 1}] AS {f}" for i, f in enumerate(feats))
    return norm_sql(body + f"\nSELECT key, label AS target, synthetic, {cols} FROM {source}",
                    ", ".join(["key:s", "target:i", "synthetic:i"] + [f"{f}:f" for f in feats]))


def _smote_oracle():
    body, feats = _sampler_sql("smote")
    return _unpacked_sql(body, feats)


def _adasyn_oracle():
    body, feats = _sampler_sql("adasyn")
    return _unpacked_sql(body, feats)


def _smote_tomek_oracle():
    body, feats = _sampler_sql("smote")
    body += """,
nn1 AS (SELECT a.key AS a, arg_min(b.key, struct_pack(d := list_distance(a.vec, b.vec), k := b.key)) AS b
  FROM res a, res b WHERE a.key <> b.key GROUP BY a.key),
links AS (SELECT n1.a FROM nn1 n1 JOIN nn1 n2 ON n1.b = n2.a AND n2.b = n1.a
  JOIN res p1 ON p1.key = n1.a JOIN res p2 ON p2.key = n1.b WHERE p1.label <> p2.label),
cleaned AS (SELECT * FROM res WHERE key NOT IN (SELECT a FROM links))"""
    return _unpacked_sql(body, feats, "cleaned")


from .registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["smote"] = _smote_oracle()
_ORACLES["adasyn"] = _adasyn_oracle()
_ORACLES["smote_tomek"] = _smote_tomek_oracle()
