"""Registered split / fold / re-sampling / weight queries (R*) and oracles.

Seeded draws are md5 hashes of '<seed>-<id>', so the oracle reproduces them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as R
from ..sources.fixtures import cte, view
from .registry import norm_sql, register

SEED = 42
TEST_SIZE = 0.3
K = 5
N_BAGS = 10

HASH = f"md5(concat('{SEED}-', CAST(client_id AS VARCHAR)))"
RANK_BY_CLASS = f"row_number() OVER (PARTITION BY target ORDER BY {HASH}, client_id)"


def _client(spark, sf_dir):
    return view(spark, sf_dir, "client").select("client_id", "target")


@register("stratified_split", norm_sql(cte("client") + f"""
SELECT client_id, target, CASE WHEN rk <= round(n_class * {TEST_SIZE}) THEN 1 ELSE 0 END AS is_test FROM (
  SELECT client_id, target, {RANK_BY_CLASS} AS rk, count(*) OVER (PARTITION BY target) AS n_class FROM client) t""",
    "client_id:i, target:i, is_test:i"))
def q_stratified_split(spark, sf_dir):
    """Stratified 30 % hold-out."""
    return R.stratified_split(_client(spark, sf_dir), test_size=TEST_SIZE, seed=SEED)


@register("random_split", norm_sql(cte("client") + f"""
SELECT client_id, target, CASE WHEN rk <= round(n * {TEST_SIZE}) THEN 1 ELSE 0 END AS is_test FROM (
  SELECT client_id, target, row_number() OVER (ORDER BY {HASH}, client_id) AS rk, count(*) OVER () AS n FROM client) t""",
    "client_id:i, target:i, is_test:i"))
def q_random_split(spark, sf_dir):
    """R2: random 30 % hold-out."""
    return R.random_split(_client(spark, sf_dir), test_size=TEST_SIZE, seed=SEED)


@register("stratified_folds", norm_sql(cte("client") + f"""
SELECT client_id, target, CAST(({RANK_BY_CLASS} - 1) % {K} AS INTEGER) AS fold FROM client""",
    "client_id:i, target:i, fold:i"))
def q_stratified_folds(spark, sf_dir):
    """Stratified, shuffled 5-fold assignment."""
    return R.stratified_folds(_client(spark, sf_dir), k=K, seed=SEED)


def _ordered_folds_sql():
    alloc = " + ".join(f"(floor((s + n - 1 - {i}) / {K}) - floor((s - 1 - {i}) / {K}))" for i in range(0))  # noqa
    cums = []
    for i in range(K):
        terms = " + ".join(f"(floor((s + n - 1 - {j}) / {K}) - floor((s - 1 - {j}) / {K}))" for j in range(i + 1))
        cums.append(f"WHEN rk <= {terms} THEN {i}")
    del alloc
    return norm_sql(cte("client") + f"""
, cls AS (SELECT target, n, sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS s
  FROM (SELECT target, count(*) AS n FROM client GROUP BY target) c)
SELECT client_id, target, CASE {' '.join(cums)} ELSE {K - 1} END AS fold FROM (
  SELECT c.client_id, c.target, row_number() OVER (PARTITION BY c.target ORDER BY c.client_id) AS rk, cls.n, cls.s
  FROM client c JOIN cls ON c.target = cls.target) t""", "client_id:i, target:i, fold:i")


@register("ordered_folds", _ordered_folds_sql())
def q_ordered_folds(spark, sf_dir):
    """Unshuffled stratified 5-fold assignment (cv=5)."""
    return R.ordered_folds(_client(spark, sf_dir), k=K)


@register("random_oversample", norm_sql(cte("client") + f"""
, st AS (SELECT max(n) AS n_maj, min(n) AS n_min, arg_max(target, n * 10 - target) AS maj
  FROM (SELECT target, count(*) AS n FROM client GROUP BY target) c),
r AS (SELECT client_id, target, {RANK_BY_CLASS} AS rk FROM client)
SELECT client_id, target, cp AS "copy" FROM (
  SELECT r.client_id, r.target, unnest(range(CASE WHEN r.target <> st.maj
      THEN st.n_maj // st.n_min + CASE WHEN r.rk <= st.n_maj % st.n_min THEN 1 ELSE 0 END ELSE 1 END)) AS cp
  FROM r, st) u""", "client_id:i, target:i, copy:i"))
def q_random_oversample(spark, sf_dir):
    """Random over-sampling of the minority to the majority count."""
    return R.random_oversample(_client(spark, sf_dir), seed=SEED)


@register("oversample_drawn", norm_sql(cte("client") + f"""
, c AS (SELECT target, count(*) AS n, max(count(*)) OVER () AS n_maj FROM client GROUP BY target),
r AS (SELECT client_id, target, {RANK_BY_CLASS} AS rk FROM client),
d AS (SELECT target, n, unnest(range(1, n_maj - n + 1)) AS draw FROM c WHERE n < n_maj),
k AS (SELECT target, draw, CAST('0x' || substr(md5(concat('{SEED}-draw-', CAST(target AS VARCHAR), '-', CAST(draw AS VARCHAR))), 1, 15) AS BIGINT) % n + 1 AS rk FROM d)
SELECT client_id, target, 0 AS "copy" FROM client UNION ALL
SELECT r.client_id, r.target, k.draw FROM r JOIN k ON r.target = k.target AND r.rk = k.rk""", "client_id:i, target:i, copy:i"))
def q_oversample_drawn(spark, sf_dir):
    """Over-sampling by draws with replacement to the majority count."""
    return R.random_oversample_drawn(_client(spark, sf_dir), seed=SEED)


@register("class_weight", norm_sql(cte("client") + """
SELECT CAST(sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END), 0)
  AS scale_pos_weight FROM client""", "scale_pos_weight:f"))
def q_class_weight(spark, sf_dir):
    """Negatives / positives."""
    return R.class_weight(_client(spark, sf_dir))


@register("balanced_weight", norm_sql(cte("client") + """
SELECT client_id, target, CAST(count(*) OVER () AS DOUBLE) / (
  (SELECT count(DISTINCT target) FROM client) * count(*) OVER (PARTITION BY target)) AS weight FROM client""",
    "client_id:i, target:i, weight:f"))
def q_balanced_weight(spark, sf_dir):
    """Balanced per-row class weights."""
    return R.balanced_weight(_client(spark, sf_dir))


@register("balanced_bags", norm_sql(cte("client") + f"""
, st AS (SELECT min(n) AS n_min, arg_max(target, n * 10 - target) AS maj
  FROM (SELECT target, count(*) AS n FROM client GROUP BY target) c),
b AS (SELECT client_id, target, bag FROM client, range({N_BAGS}) t(bag)),
r AS (SELECT client_id, target, bag, row_number() OVER (PARTITION BY bag, target
        ORDER BY md5(concat('{SEED}-', CAST(bag AS VARCHAR), '-', CAST(client_id AS VARCHAR))), client_id) AS rk FROM b)
SELECT client_id, target, bag FROM r, st WHERE r.target <> st.maj OR r.rk <= st.n_min""",
    "client_id:i, target:i, bag:i"))
def q_balanced_bags(spark, sf_dir):
    """Ten balanced bags (all minority rows + an equal majority draw)."""
    return R.balanced_bags(_client(spark, sf_dir), n_bags=N_BAGS, seed=SEED)
