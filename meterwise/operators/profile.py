"""Profiling aggregates (D1–D9), MI ranking order and top-n.

Each report is a small number of aggregates over the whole table; wide
per-column results are unpivoted from one aggregate row with ``explode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.columns import scalar_of
from ..functions.prefix import exact_quantiles
from ..operators.joins import row_positions


def _is_missing(df, name):
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return (c.isNull() | F.isnan(c)) if isinstance(t, (DoubleType, FloatType)) else c.isNull()


def missing_report(df: DataFrame) -> DataFrame:
    """Column, num_missing, pct_missing (0–100), has_missing."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                                        F.col(f"m{i}").alias("num_missing")) for i, c in enumerate(cols)]))
    return (agg.select("__n", rows.alias("r"))
            .select("r.pos", "r.column", "r.num_missing",
                    (F.try_divide(F.col("r.num_missing") * 100.0, F.col("__n"))).alias("pct_missing"),
                    (F.col("r.num_missing") > 0).alias("has_missing")))


def distinct_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number of distinct non-null values per column.

    Exact and distributed: (column, value) pairs are de-duplicated by a
    partial/final aggregate, then counted per column — no per-column
    ``countDistinct`` expand and no set held by one task.
    """
    cols = columns or df.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
                                for c in cols])).alias("p")
    distinct = (df.select(pairs).select("p.column", "p.v").filter(F.col("v").isNotNull())
                .distinct())
    counted = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


SKETCH_LG_K = 12  # 4,096 registers: relative standard error 1.04 / 64


def distinct_sketches(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """D2, approximate: (by..., column, sketch), one mergeable HyperLogLog sketch a column and group.

    Sketches of new rows (a day's partition, say) can be kept and united with
    older ones by :func:`distinct_from_sketches` without reading the old rows."""
    by = by or []
    cols = [c for c in (columns or df.columns) if c not in by]
    agg = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_k)).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)]))
    return agg.select(*by, rows.alias("r")).select(*by, "r.column", "r.sketch")


def distinct_from_sketches(sketches: DataFrame) -> DataFrame:
    """column, n_distinct (estimated) of the union of all sketches of a column."""
    return sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("n_distinct"))


def sketch_error(lg_k: int = SKETCH_LG_K, deviations: float = 3.0) -> float:
    """Relative error that an estimate stays within, but for chance beyond so many standard deviations."""
    return deviations * 1.04 / (1 << lg_k) ** 0.5


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D3: count, mean, std, min, 25 %, 50 %, 75 %, max per numeric column.

    Moments are one aggregate; the quartiles are exact (linear
    interpolation, as pandas ``describe``) and distributed.
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("p")
    ).select("p.column", "p.x")
    mom = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"),
                                     F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                                     F.max("x").alias("max"))
    q = exact_quantiles(long, "column", "x", [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                   for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return mom.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def table_shape(df: DataFrame) -> DataFrame:
    """Per column: position, name, type, non-null count and row count."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                                        F.col(f"c{i}").alias("non_null")) for i, c in enumerate(cols)]))
    return agg.select("__n", rows.alias("r")).select("r.pos", "r.column", "r.dtype", "r.non_null",
                                                     F.col("__n").alias("n_rows"))


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Class, count and share of each class."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = scalar_of(df.agg(F.count(F.lit(1)).alias("__total")), "__total")
    return counts.select("class", "count", (F.col("count") / total).alias("share"))


def value_counts(df: DataFrame, column: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    """(value, count[, share]), most frequent first; NULL is no value unless ``dropna`` is off."""
    if dropna:
        df = df.filter(F.col(column).isNotNull())
    out = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = scalar_of(df.agg(F.count(F.lit(1)).alias("__t")), "__t")
        out = out.withColumn("share", F.col("count") / total)
    return out.orderBy(F.desc("count"), F.asc("value"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column."""
    return df.select(F.col(column).alias("value")).distinct()


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (long form, both orders and
    the diagonal) over the rows where both are set, all from one aggregate.
    A column without variance has no correlation (NULL), not even with itself."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]

    def corr(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    agg = df.agg(*[corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)],
                 *[F.var_pop(F.col(a).cast("double")).alias(f"v{k}") for k, a in enumerate(columns)])
    structs = []
    for k, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{k}").alias("corr")))
        structs.append(F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"c{k}").alias("corr")))
    for k, a in enumerate(columns):
        structs.append(F.struct(F.lit(a).alias("column_a"), F.lit(a).alias("column_b"),
                                F.when(F.col(f"v{k}") > 0, F.lit(1.0)).alias("corr")))
    return agg.select(F.explode(F.array(*structs)).alias("r")).select("r.column_a", "r.column_b", "r.corr")


def compare_submissions(a: DataFrame, b: DataFrame, order_a: str, order_b: str,
                        key: str = "client_id", target: str = "target") -> DataFrame:
    """Structural comparison of two submission tables, one row:
    row counts, whether ids agree position by position, number of
    positions that differ, NULL targets on each side (NULL when a side has
    no target column).  Positions are explicit (``order_*`` columns) and
    computed distributed."""
    pa = row_positions(a.select(*dict.fromkeys([key, order_a])), order_a, "pos")
    pb = row_positions(b.select(*dict.fromkeys([key, order_b])), order_b, "pos")
    joined = pa.select("pos", F.col(key).alias("id_a")).join(pb.select("pos", F.col(key).alias("id_b")), "pos", "full")
    diff = joined.agg(
        F.count("id_a").alias("rows_a"), F.count("id_b").alias("rows_b"),
        F.count_if(~F.coalesce(F.col("id_a").eqNullSafe(F.col("id_b")), F.lit(False))).alias("id_mismatches"))
    def missing(side):
        if target not in side.columns:
            return F.lit(None).cast("long")
        return scalar_of(side.agg(F.count_if(F.col(target).isNull()).alias("m")), "m")
    return diff.select("rows_a", "rows_b", (F.col("rows_a") == F.col("rows_b")).alias("same_rows"),
                       (F.col("id_mismatches") == 0).alias("same_ids"), "id_mismatches",
                       missing(a).alias("missing_target_a"), missing(b).alias("missing_target_b"))


def first_mismatches(a: DataFrame, b: DataFrame, order_a: str, order_b: str, key: str = "client_id",
                     n: int = 5) -> DataFrame:
    """The first ``n`` positions whose ids differ (a top-n report)."""
    pa = row_positions(a.select(*dict.fromkeys([key, order_a])), order_a, "pos").select("pos", F.col(key).alias(key))
    pb = row_positions(b.select(*dict.fromkeys([key, order_b])), order_b, "pos").select("pos", F.col(key).alias(f"{key}_file2"))
    j = pa.join(pb, "pos", "full")
    return (j.filter(~F.coalesce(F.col(key).eqNullSafe(F.col(f"{key}_file2")), F.lit(False)))
            .orderBy("pos").limit(n))


def mi_ranking(scores: DataFrame) -> DataFrame:
    """Ranking by MI descending (name breaks ties), with its rank."""
    w = Window.orderBy(F.desc("MI_Score"), F.asc("Feature"))
    # one row per feature: the ranking table is as small as the column list
    return scores.select("Feature", "MI_Score", (F.row_number().over(w) - 1).alias("rank"))


def mi_top_n(scores: DataFrame, n: int) -> DataFrame:
    """The n best features (a top-n report)."""
    return scores.orderBy(F.desc("MI_Score"), F.asc("Feature")).limit(n)
