"""Running sums over a global order without a single-partition window.

``Window.partitionBy(g).orderBy(x)`` sends every row of group ``g`` to one
task.  For groups that are whole columns (a feature, a class, a score table)
that task grows with the data.  :func:`running_sums` instead

1. range-partitions the rows on the whole (group, order) tuple and writes them
   once, with the partition's number as the block id (a re-executed later
   stage reads the written ids, so it sees the same blocks; nothing about the
   blocks passes through the driver or the plan),
2. computes running sums inside each (group, block),
3. adds the totals of the earlier blocks of the same group (one row for each
   block and each group in it).

The result equals ``sum(v).over(partitionBy(g).orderBy(x).rowsBetween(
unboundedPreceding, currentRow))`` when the order is unique within a group.
A frequent value of the first order column is split over blocks by the other
order columns; rows equal in all of them share a block, so callers either
pre-aggregate ties or end the order with an id.  Group values must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                 prefix: str = "cum_", num_blocks: int | None = None) -> DataFrame:
    """Add ``{prefix}{v}`` = inclusive running sum of ``v`` per group, in
    ascending ``order_cols`` order."""
    n = num_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group_cols, *order_cols)
    tagged = cut_lineage(ranged.withColumn("__blk", F.spark_partition_id()), "running-blocks")
    w_local = (Window.partitionBy(*group_cols, "__blk").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = tagged.select("*", *[F.sum(v).over(w_local).alias(f"__loc_{v}") for v in value_cols])
    # block totals from the windowed rows: already partitioned by (group,
    # block), so no new exchange, and the input is read once
    blocks = local.groupBy(*group_cols, "__blk").agg(*[F.sum(v).alias(f"__tot_{v}") for v in value_cols])
    w_blocks = Window.partitionBy(*group_cols).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*group_cols, "__blk", *[
        F.coalesce(F.sum(f"__tot_{v}").over(w_blocks), F.lit(0)).alias(f"__off_{v}") for v in value_cols])
    out = local.join(offsets, [*group_cols, "__blk"], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(f"__off_{v}") + F.col(f"__loc_{v}")).alias(f"{prefix}{v}") for v in value_cols])


def rank_before(df: DataFrame, group_cols: list[str], value_col: str, count_col: str = "n",
                name: str = "n_before") -> DataFrame:
    """For distinct (group, value, n) rows: number of rows with a smaller
    value in the group (RANK() − 1 of the value)."""
    out = running_sums(df, group_cols, [value_col], [count_col], prefix="__cum_")
    return out.withColumn(name, F.col(f"__cum_{count_col}") - F.col(count_col)).drop(f"__cum_{count_col}")


def exact_quantiles(long_df: DataFrame, group_col: str, value_col: str, probs: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group (pandas / numpy
    'linear'), for a long (group, value) frame, computed distributed.

    Returns (group, p, q).  Values are first reduced to distinct (group,
    value, n), written once; positions come from :func:`running_sums`; the
    requested ranks (a tiny table: groups × probs) are matched by one range join.
    """
    vals = cut_lineage(long_df.filter(F.col(value_col).isNotNull())
                       .groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("n")), "quantile-values")
    ranked = rank_before(vals, [group_col], value_col)  # rows n_before+1 .. n_before+n (1-based)
    totals = vals.groupBy(group_col).agg(F.sum("n").alias("total"))
    want = (totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("h", (F.col("total") - 1) * F.col("p") + 1)
            .withColumn("lo", F.floor("h").cast("long")).withColumn("hi", F.ceil("h").cast("long")))
    start, end = F.col("n_before") + 1, F.col("n_before") + F.col("n")
    # hi is lo or lo + 1: the rows met hold one of the two ranks
    met = ranked.join(want, group_col).filter((F.col("lo") <= end) & (F.col("hi") >= start))
    ends = met.groupBy(group_col, "p", "h", "lo").agg(
        F.max(F.when(F.col("lo") >= start, F.col(value_col))).alias("v_lo"),
        F.max(F.when(F.col("hi") <= end, F.col(value_col))).alias("v_hi"))
    return ends.select(group_col, "p", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("h") - F.col("lo"))).alias("q"))
