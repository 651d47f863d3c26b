"""Feature selection by mutual information (M1, M2) and MI-range filter.

Both estimators work on the long form (feature, row, label, x) so that all
features are scored by the same few distributed jobs, never one feature per
driver loop and never one feature per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import rank_before
from ..session import cut_lineage, ship


def feature_columns(df: DataFrame, target: str = "target", exclude=("client_id",)) -> list[str]:
    skip = set(exclude) | {target}
    return [c for c in df.columns if c not in skip]


def long_form(df: DataFrame, features: list[str], target: str = "target", id_col: str | None = None) -> DataFrame:
    """(feature, [place, id], y, x) with NULL → 0, as the reference fills before MI; place: of the feature in the list."""
    keep = [F.col(target).cast("int").alias("y")] + ([F.col(id_col).alias("id")] if id_col else [])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("place"),
                                         F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias("x"))
                                for i, f in enumerate(features)])).alias("p")
    return df.select(*keep, pairs).select("p.feature", *(["p.place", "id"] if id_col else []), "y", "p.x")


# Fixed number of decimals feature values are rounded to before binning, so
# values that differ only by floating-point noise share a rank.
BIN_DECIMALS = 9


def mi_binned(df: DataFrame, target: str = "target", features: list[str] | None = None,
              bins: int = 10) -> DataFrame:
    """M2: MI (nats) between equal-frequency bins of each feature and the
    label.  bin = ⌊(RANK(x) − 1) · bins / n⌋ over x rounded to 9 decimals,
    so equal values share a bin.

    Returns (Feature, MI_Score).
    """
    feats = features or feature_columns(df, target)
    long = long_form(df, feats, target).withColumn("x", F.round("x", BIN_DECIMALS))
    # the only pass over the input; everything below reads these counts
    cells = cut_lineage(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    per_x = cells.groupBy("feature", "x").agg(F.sum("n").alias("n"))
    ranked = rank_before(per_x, ["feature"], "x")
    totals = per_x.groupBy("feature").agg(F.sum("n").alias("total"))
    binned = (ranked.join(totals, "feature")
              .select("feature", "x", F.expr(f"(n_before * {int(bins)}) div total").alias("bin"), "total"))
    # at most features x bins x labels rows, read three times below
    table = cut_lineage(cells.join(binned, ["feature", "x"])
                        .groupBy("feature", "bin", "y").agg(F.sum("n").alias("n"), F.first("total").alias("total")),
                        "mi-table")
    pb = table.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    py = table.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    t = table.join(pb, ["feature", "bin"]).join(py, ["feature", "y"])
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nb") * F.col("ny")))
    return t.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("MI_Score")) \
        .select(F.col("feature").alias("Feature"), "MI_Score")


def filter_by_mi(scores: DataFrame, min_mi: float, max_mi: float) -> DataFrame:
    """Features with min ≤ MI ≤ max, in file order.

    ``scores`` has the feature name first and the score second (renamed by
    position, like the reference); a ``rank`` column, when present, keeps
    the file order."""
    cols = scores.columns
    s = scores.select(F.col(f"`{cols[0]}`").alias("feature"), F.col(f"`{cols[1]}`").cast("double").alias("mi"),
                      *([F.col("rank")] if "rank" in cols else []))
    return s.filter(F.col("mi").between(float(min_mi), float(max_mi)))


def feature_names(filtered: DataFrame) -> list[str]:
    """Names of a filtered ranking (one row per feature: a column list)."""
    order = ["rank"] if "rank" in filtered.columns else []
    rows = filtered.orderBy(*order).select("feature").collect() if order else filtered.select("feature").collect()
    return [r[0] for r in rows]


# --------------------------------------------------------------------------- #
# M1: k-nearest-neighbour MI of a continuous feature and a discrete label
# (Ross 2014), for all features at once
# --------------------------------------------------------------------------- #
# Fixed constants of the estimator's defaults: 3 neighbours, noise of
# 1e-10 · max(1, mean |x|) standard deviations added after scaling by the std.
KNN_NEIGHBOURS = 3
KNN_NOISE = 1e-10
RUN = 1 << 19  # points of a block


def _hash_normal(seed: int, *cols):
    """A seeded standard-normal draw per row (Box–Muller on two md5 draws)."""
    from .synthetic import hash32
    two32 = float(2 ** 32)
    u1 = (hash32(seed, "n1", *cols).cast("double") + 0.5) / two32
    u2 = (hash32(seed, "n2", *cols).cast("double") + 0.5) / two32
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


def knn_points(df: DataFrame, features: list[str], target: str = "target", id_col: str = "client_id",
               seed: int = 50) -> DataFrame:
    """Long form (feature, place, id, y, x) after NULL → 0, division by the
    population std (0 → 1) and the tie-breaking noise."""
    long = long_form(df, features, target, id_col)
    sd = F.when(F.stddev_pop("x") > 0, F.stddev_pop("x")).otherwise(F.lit(1.0))
    stats = long.groupBy("feature").agg(sd.alias("sd"), F.greatest(F.lit(1.0), F.avg(F.abs("x")) / sd).alias("ma"))
    return (long.join(F.broadcast(stats), "feature")  # one row per feature: bounded by the column list
            .withColumn("x", F.col("x") / F.col("sd") + F.lit(KNN_NOISE) * F.col("ma") * _hash_normal(seed, "feature", "id"))
            .select("feature", "place", "id", "y", "x"))


def _ends(x, r, nx):
    """(lower, upper, r > 0): the m points lie between the ends, or at both if r = 0.  On the side of the
    k-th neighbour its exact value is the end (x ± r could round past it); the other end is x ∓ r."""
    far, right = r > 0, nx > x
    if isinstance(x, np.ndarray):
        return np.where(far, np.where(right, x - r, nx), x), np.where(far, np.where(right, nx, x + r), x), far
    return F.when(far, F.when(right, x - r).otherwise(nx)).otherwise(x), F.when(far, F.when(right, nx).otherwise(x + r)).otherwise(x), far


def _nearest(x: np.ndarray, k: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, value) of the ``want``-th nearest of the k values before and after each of the sorted ones."""
    around = np.full((2 * k, len(x)), np.inf)
    for j in range(1, min(k, len(x) - 1) + 1):
        around[k - j, j:], around[k + j - 1, :-j] = x[:-j], x[j:]
    gap = np.abs(around - x)
    pick = gap.argsort(axis=0, kind="stable")[want - 1]
    at = np.arange(len(x))
    return gap[pick, at], around[pick, at]


def _block(points: pa.Table, k: int, sizes: dict[int, int], block: int) -> pa.Table:
    """The points in the order of (place, x) with r, nx and m as far as this block shows them.

    r is known of points with k others of their label on both sides, m where the ends lie inside.
    ``edge`` marks the first and last 2 k points of each label."""
    place, x = points.column("place").to_numpy(), points.column("x").to_numpy()
    order = np.lexsort((x, place))
    points, place, x, y = points.take(pa.array(order)), place[order], x[order], points.column("y").to_numpy()[order]
    r, nx, m, edge = np.full(len(x), np.nan), np.full(len(x), np.nan), np.full(len(x), -1, np.int64), np.zeros(len(x), bool)
    starts = np.nonzero(np.diff(place, prepend=place[0] - 1))[0]
    for a, b in zip(starts, [*starts[1:], len(x)]):
        here, labels = x[a:b], y[a:b]
        for label in np.unique(labels):
            rows = np.nonzero(labels == label)[0]
            at, mine = a + rows, here[rows]
            edge[at[:2 * k]] = edge[at[-2 * k:]] = True
            if len(rows) <= 2 * k:
                continue
            gap, value = _nearest(mine, k, min(k, sizes[int(label)] - 1))
            inner = slice(k, len(rows) - k)
            own, gap, value = mine[inner], gap[inner], value[inner]
            low, high, far = _ends(own, gap, value)
            n = np.where(far, here.searchsorted(high, "left") - here.searchsorted(low, "right"),
                         here.searchsorted(high, "right") - here.searchsorted(low, "left"))
            inside = np.where(far, (low >= here[0]) & (high <= here[-1]), (low > here[0]) & (high < here[-1]))
            r[at[inner]], nx[at[inner]], m[at[inner]] = gap, value, np.where(inside, n, -1)
    return pa.table([points.column(c) for c in ("place", "id", "y", "x")] + [
        pa.array(r, mask=np.isnan(r)), pa.array(nx, mask=np.isnan(nx)), pa.array(m, mask=m < 0), pa.array(edge), pa.array(np.full(len(x), block))],
        ["place", "id", "y", "x", "r", "nx", "m", "edge", "block"])


def knn_point_stats(df: DataFrame, target: str = "target", features: list[str] | None = None,
                    id_col: str = "client_id", k: int = KNN_NEIGHBOURS, seed: int = 50) -> DataFrame:
    """Per point of each feature: label size N_y, k_i, radius r_i and count m_i.

    * r_i: distance to the k-th nearest point of the same label, k_i =
      min(k, N_y − 1); labels with one point are left out.  In one
      dimension the k nearest lie among the k predecessors and k successors
      in sorted order.
    * m_i: points of any label with |x_j − x_i| < r_i (equal values when
      r_i = 0), i included.

    One shuffle deals the points into blocks of some RUN neighbours in the order
    of (feature, x); nearly all of them see their neighbours and all points within
    r_i in their own block.  Of the others, at the ends of the blocks (some 2 k
    for each block and label), r_i comes from a window over the blocks' end
    points, and m_i from the sizes of the blocks in between and counts in the
    blocks where x_i ± r_i lie.
    """
    feats = features or feature_columns(df, target, exclude=(id_col,))
    spark = df.sparkSession
    ship(spark)
    # the features are planned once; all passes below read this table
    wide = cut_lineage(df.select(id_col, target, *[F.col(f"`{f}`") for f in feats]), "knn-features")
    sizes = {r["y"]: r["n"] for r in wide.groupBy(F.col(target).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    paired = [y for y, n in sizes.items() if y is not None and n > 1]
    pts = knn_points(wide, feats, target, id_col, seed).filter(F.col("y").isin(paired))
    pts = cut_lineage(pts.drop("feature"), "knn-points")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(sizes[y] for y in paired) * len(feats) / RUN))
    id_type = pts.schema["id"].dataType.simpleString()
    ddl = f"place int, id {id_type}, y int, x double, r double, nx double, m long, edge boolean, block long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if sum(len(b) for b in found):
            rows = pa.Table.from_batches(found)
            yield from _block(rows, k, sizes, TaskContext.get().partitionId()).combine_chunks().to_batches(1 << 16)

    met = cut_lineage(pts.repartitionByRange(blocks, "place", "x", "id").mapInArrow(meet, ddl), "knn-blocks")
    n_y = F.create_map(*[F.lit(v) for y in paired for v in (y, sizes[y])])[F.col("y")] if paired else F.lit(None).cast("long")
    met = met.withColumn("n_y", n_y).withColumn("k_i", F.least(F.lit(k), F.col("n_y") - 1))

    # r_i of the end points of the blocks, in the order of all of a feature's end points
    w = Window.partitionBy("place", "y").orderBy("x", "id")
    nears = [f("x", j).over(w) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    ends = met.filter("edge").withColumn("nears", F.array(*nears)).filter(F.col("r").isNull())
    ends = ends.withColumn("ds", F.array_sort(F.transform(
        F.filter("nears", lambda n: n.isNotNull()), lambda n: F.struct(F.abs(n - F.col("x")).alias("d"), n.alias("nx")))))
    kth = F.element_at("ds", F.col("k_i").cast("int"))
    ends = ends.withColumn("r", kth["d"]).withColumn("nx", kth["nx"]).drop("nears", "ds")
    left = ends.unionByName(met.filter(F.col("r").isNotNull() & F.col("m").isNull()))
    left = cut_lineage(left.withColumn("key", F.monotonically_increasing_id()), "knn-open")  # an id may occur twice

    # m_i of the points whose ends lie outside their block
    spans = cut_lineage(met.groupBy("place", "block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")), "knn-spans")
    low, high, far = _ends(F.col("x"), F.col("r"), F.col("nx"))
    cuts = left.select("place", "key", F.explode(F.array(
        F.struct(high.alias("at"), (~far).alias("itself"), F.lit(1).alias("sign")),
        F.struct(low.alias("at"), far.alias("itself"), F.lit(-1).alias("sign")))).alias("c")).select("place", "key", "c.*")
    spanned = cut_lineage(cuts.join(F.broadcast(spans), "place").filter(F.col("lo") <= F.col("at")), "knn-cuts")  # blocks up to an end
    before = spanned.filter(F.col("hi") < F.col("at")).select("key", (F.col("sign") * F.col("n")).alias("n"))
    across = spanned.filter(F.col("hi") >= F.col("at")).select("place", "block", "key", "at", "itself", "sign")
    inside = (met.select("place", "block", "x").join(F.broadcast(across), ["place", "block"])
              .filter((F.col("x") < F.col("at")) | (F.col("itself") & (F.col("x") == F.col("at"))))
              .groupBy("key").agg(F.sum("sign").alias("n")))
    counts = before.unionByName(inside).groupBy("key").agg(F.sum("n").alias("m"))
    opened = left.drop("m").join(F.broadcast(counts), "key")

    columns = ["id", "y", "x", "k_i", "r", "m", "n_y"]
    name = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("place") + 1).alias("feature")
    return met.filter(F.col("m").isNotNull()).select(name, *columns).unionByName(opened.select(name, *columns))


def mi_knn(df: DataFrame, target: str = "target", features: list[str] | None = None,
           id_col: str = "client_id", k: int = KNN_NEIGHBOURS, seed: int = 50) -> DataFrame:
    """M1: MI = max(0, ψ(N) + ⟨ψ(k_i)⟩ − ⟨ψ(N_y)⟩ − ⟨ψ(m_i)⟩) per feature
    (see :func:`knn_point_stats`).  Returns (Feature, MI_Score)."""
    from ..functions.columns import digamma
    per_point = knn_point_stats(df, target, features, id_col, k, seed)
    alike = per_point.groupBy("feature", "k_i", "n_y", "m").agg(F.count(F.lit(1)).alias("n"))  # ψ once for equal counts

    def mean(c):
        return F.sum(F.col("n") * digamma(c)) / F.sum("n")

    scores = alike.groupBy("feature").agg(F.sum("n").alias("n"), mean("k_i").alias("pk"), mean("n_y").alias("py"), mean("m").alias("pm"))
    mi = digamma("n") + F.col("pk") - F.col("py") - F.col("pm")
    return scores.select(F.col("feature").alias("Feature"), F.greatest(mi, F.lit(0.0)).alias("MI_Score"))
