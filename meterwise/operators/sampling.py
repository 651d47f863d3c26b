"""Splitting, folds, re-sampling and class weights.

Randomness is a seeded hash: a row's draw is ``md5('<seed>-<id>')``, so every
result is reproducible and equal in Spark and in SQL.  Ranks inside a class
use distributed running sums (a class may hold most of the rows, so no
per-class window is used).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import scalar_of
from ..functions.prefix import running_sums


def hash_key(id_col: str, seed: int | str, salt: str | None = None):
    """md5 of '<seed>-[<salt>-]<id>' (hex string): the row's seeded draw."""
    parts = [F.lit(f"{seed}-")] + ([F.lit(f"{salt}-")] if salt is not None else []) + \
        [F.col(id_col).cast("string")]
    return F.md5(F.concat(*parts))


def hash_rank(df: DataFrame, group_cols: list[str], id_col: str, seed: int | str,
              name: str = "rank", key=None) -> DataFrame:
    """1-based rank of each row inside its group in seeded-hash order
    (ties on the hash broken by id).

    Digests are evenly spread, so their first three hex digits deal a group into
    4096 even blocks in the order of the ranks: the rows are shuffled once, by
    block, and nothing is written; the blocks are counted from the ids alone."""
    k = key if key is not None else hash_key(id_col, seed)
    tmp = df.withColumn("__h", k).withColumn("__blk", F.coalesce(F.substring("__h", 1, 3), F.lit("")))
    by = [*group_cols, "__blk"]
    before = Window.partitionBy(*group_cols).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tmp.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
               .select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    local = F.row_number().over(Window.partitionBy(*by).orderBy("__h", id_col))
    out = tmp.withColumn("__loc", local).join(offsets, by, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + F.col("__loc")).alias(name))


def _class_counts(df, label):
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("__n_class"))


def stratified_split(df: DataFrame, label: str = "target", id_col: str = "client_id",
                     test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first round(test_size · n_c) rows of each
    class in seeded-hash order form the hold-out part."""
    ranked = hash_rank(df, [label], id_col, seed)
    counts = _class_counts(df, label)
    # one row per class: broadcast is bounded by the number of classes
    return (ranked.join(F.broadcast(counts), label)
            .withColumn("is_test", (F.col("rank") <= F.round(F.col("__n_class") * test_size)).cast("int"))
            .drop("rank", "__n_class"))


def random_split(df: DataFrame, id_col: str = "client_id", test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """R2: adds ``is_test`` for the first round(test_size · n) rows in
    seeded-hash order (no stratification)."""
    ranked = hash_rank(df.withColumn("__all", F.lit(0)), ["__all"], id_col, seed)
    total = scalar_of(df.agg(F.count(F.lit(1)).alias("__n")), "__n")
    return (ranked.withColumn("is_test", (F.col("rank") <= F.round(total * test_size)).cast("int"))
            .drop("rank", "__all"))


def stratified_folds(df: DataFrame, label: str = "target", id_col: str = "client_id",
                     k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank within class in seeded-hash order − 1) mod k, so
    every fold holds the same share of each class (±1)."""
    ranked = hash_rank(df, [label], id_col, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def ordered_folds(df: DataFrame, label: str = "target", id_col: str = "client_id", k: int = 5) -> DataFrame:
    """Unshuffled stratified k-fold (the ``cv=k`` default).

    Classes are laid out in label order; fold i takes from class c as many
    rows as there are positions j ≡ i (mod k) inside the class's block of the
    sorted labels.  Inside a class, rows keep id order and fill folds 0, 1, …
    as contiguous runs.
    """
    counts = _class_counts(df, label)
    start = running_sums(counts, [], [label], ["__n_class"], prefix="__end")
    start = start.select(label, "__n_class", (F.col("__end__n_class") - F.col("__n_class")).alias("__start"))
    # allocation[i, c] = #{j in [s, s + n) : j mod k = i}; run bounds per fold
    alloc = [F.floor((F.col("__start") + F.col("__n_class") - 1 - i) / k).cast("long") -
             F.floor((F.col("__start") - 1 - i) / k).cast("long") for i in range(k)]
    bounds = start.select(label, *[a.alias(f"__a{i}") for i, a in enumerate(alloc)])
    ranked = running_sums(df.withColumn("__one", F.lit(1).cast("long")), [label], [id_col], ["__one"], prefix="__r")
    fold = F.lit(k - 1)
    cum = F.lit(0).cast("long")
    cases = []
    for i in range(k):
        cum = cum + F.col(f"__a{i}")
        cases.append((F.col("__r__one") <= cum, i))
    expr = None
    for cond, i in reversed(cases):
        expr = F.when(cond, F.lit(i)).otherwise(expr if expr is not None else fold)
    return (ranked.join(F.broadcast(bounds), label)
            .withColumn("fold", expr.cast("int"))
            .drop("__one", "__r__one", *[f"__a{i}" for i in range(k)]))


def random_oversample(df: DataFrame, label: str = "target", id_col: str = "client_id",
                      seed: int = 42) -> DataFrame:
    """Repeat minority rows until both classes have the majority count.

    Each minority row gets ⌊n_maj / n_min⌋ copies, and the first
    n_maj mod n_min rows in seeded-hash order one more.  Adds ``copy``
    (0 = the original row).  Binary labels.
    """
    counts = _class_counts(df, label)
    # one row of three class statistics, read once
    st = counts.agg(F.max("__n_class").alias("n_maj"), F.min("__n_class").alias("n_min"),
                    F.max_by(label, F.struct("__n_class", -F.col(label))).alias("maj")).first()
    n_maj, n_min, maj = int(st["n_maj"]), int(st["n_min"]), F.lit(st["maj"])
    # only minority rows need a rank; majority rows pass through once
    ranked = hash_rank(df.filter(F.col(label) != maj), [label], id_col, seed)
    copies = F.lit(n_maj // n_min).cast("long") + (F.col("rank") <= F.lit(n_maj % n_min)).cast("long")
    minority = (ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
                .drop("rank"))
    return df.filter(F.col(label) == maj).withColumn("copy", F.lit(0).cast("long")).unionByName(minority)


def drawn_ranks(spark, draws: int, ranks: int, seed: int, salt: str) -> DataFrame:
    """(draw, rank): for each draw from 1 a seeded rank in 1..ranks, with replacement."""
    text = F.concat(F.lit(f"{seed}-{salt}-"), F.col("draw").cast("string"))
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return spark.range(1, draws + 1).select(F.col("id").alias("draw")).withColumn("rank", F.pmod(digest, F.lit(max(1, ranks))) + 1)


def random_oversample_drawn(df: DataFrame, label: str = "target", id_col: str = "client_id", seed: int = 42) -> DataFrame:
    """R5 with replacement: every row once, and n_maj − n_c more draws from each smaller class.

    Each draw names a rank in its class's seeded-hash order; draws and ranked
    rows meet by (class, rank).  Adds ``copy`` (0 for the row itself, else the
    number of the draw).  Any number of classes."""
    sizes = {r[label]: r["__n_class"] for r in _class_counts(df, label).collect()}  # one row a class
    most = max(sizes.values(), default=0)
    out = df.withColumn("copy", F.lit(0).cast("long"))
    ranked = hash_rank(df.filter(F.col(label).isin([c for c, n in sizes.items() if n < most])), [label], id_col, seed)
    for c, n in sorted(sizes.items()):
        if n < most:
            draws = drawn_ranks(df.sparkSession, most - n, n, seed, f"draw-{c}")
            met = ranked.filter(F.col(label) == c).join(draws, "rank").withColumn("copy", F.col("draw"))
            out = out.unionByName(met.select(*out.columns))
    return out


def class_weight(df: DataFrame, label: str = "target") -> DataFrame:
    """scale_pos_weight = #negatives / #positives (one row)."""
    return df.agg(F.try_divide(F.sum((F.col(label) == 0).cast("double")),
                               F.sum((F.col(label) == 1).cast("double"))).alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str = "target", name: str = "weight") -> DataFrame:
    """Row weight for the positive class = neg / pos, 1 for negatives."""
    w = scalar_of(class_weight(df, label), "scale_pos_weight")
    return df.withColumn(name, F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))


def balanced_weight(df: DataFrame, label: str = "target", name: str = "weight") -> DataFrame:
    """weight = n / (n_classes · n_c) per row ('balanced')."""
    counts = _class_counts(df, label)
    tot = counts.agg(F.sum("__n_class").alias("__n"), F.count(F.lit(1)).alias("__k"))
    per = counts.select(label, (scalar_of(tot, "__n") / (scalar_of(tot, "__k") * F.col("__n_class"))).alias(name))
    return df.join(F.broadcast(per), label)


def balanced_bags(df: DataFrame, label: str = "target", id_col: str = "client_id", n_bags: int = 10,
                  seed: int = 42) -> DataFrame:
    """``n_bags`` balanced bags: every minority row, and n_min majority
    rows drawn without replacement (seeded hash per bag).  Adds ``bag``."""
    counts = _class_counts(df, label)
    st = counts.agg(F.min("__n_class").alias("n_min"), F.max("__n_class").alias("n_maj"),
                    F.max_by(label, F.struct("__n_class", -F.col(label))).alias("maj")).first()
    n_min, n_maj, maj = int(st["n_min"]), int(st["n_maj"]), st["maj"]
    bags = F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1)))
    minority = df.filter(F.col(label) != F.lit(maj)).withColumn("bag", bags)
    majority = df.filter(F.col(label) == F.lit(maj)).withColumn("bag", bags)
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("bag").cast("string"), F.lit("-"), F.col(id_col).cast("string")))
    h15 = F.conv(F.substring(key, 1, 15), 16, 10).cast("double") / float(16 ** 15)
    # Exact draw with a pre-filter: rows whose hash is below a threshold are
    # exactly the rows ranked first in hash order, so ranking only them gives
    # the same first n_min rows as ranking the whole majority — provided every
    # bag keeps at least n_min rows; otherwise the threshold is widened.
    share = min(1.0, 1.2 * n_min / max(n_maj, 1) + 64.0 / max(n_maj, 1))
    while True:
        kept = majority.filter(h15 < F.lit(share)) if share < 1.0 else majority
        # a bag without any kept row is short too, so the full bags are counted
        if share >= 1.0 or kept.groupBy("bag").count().filter(F.col("count") >= n_min).count() == n_bags:
            break
        share = min(1.0, share * 2)
    ranked = hash_rank(kept, ["bag"], id_col, seed, key=key)
    drawn = ranked.filter(F.col("rank") <= n_min).drop("rank")
    return minority.unionByName(drawn)
