"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share
the words of the whole corpus by weight; a source's target stops at
``max_repeat`` times its size and the excess is shared again by weight among
the others until no target is above its stop.

Slot i of the schedule takes the golden-ratio point frac(i * phi); its place
among the cumulative targets names the source, and the rank of the slot among
its source's slots names the block it plays.  A source's documents are shuffled
by digest and laid end to end, at most ``max_repeat`` times over, as far as its
target goes, and cut into blocks of equal word counts; slots and blocks meet by
(source, number).  Blocks beyond a source's last slot, and the remainder of a
target that is no whole number of blocks, play in a finer slot of the source at
the end, so every source plays its target to the word.

Nothing is ranked in one task: positions are running sums inside digest ranges
of a few thousand documents plus the sums of the ranges before; slot ranks are
counted inside runs of slots plus the counts of the runs before.  A source that
holds a third of all rows is dealt out over its digest ranges.

Defined cases: a null text has size 0; documents of size 0 are never taken; no
words at all: every target is 0 and nothing is taken; repeated rows are
documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, text_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SLOTS, BLOCK_WORDS = 1 << 16, 1 << 20
RANGE_DOCS, RUN = 8192, 1 << 14
GOLDEN = 0.6180339887498949
SEED = 20240917


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(df: DataFrame, value: str, group: list[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*group).orderBy(order)) - F.col(value)


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, src (number in code point order), source_size, target; from rows (source, size)."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = cut(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    heads = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    rows = parts.withColumn("place", place).join(F.broadcast(heads), "part").withColumn("src", (F.col("first") + F.col("place")).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows = cut(rows.select("source", "src", "source_size", "part", weight.alias("weight")), "mix-weights")
    stop = F.col("source_size") * max_repeat
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, so each turn stops at least one more source
        over = F.col("weight") * level > stop
        r = rows.agg(F.sum(F.when(over, stop).otherwise(0)).alias("stopped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not r["free"]:
            break
        new = (total - float(r["stopped"] or 0)) / r["free"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return rows.withColumn("target", F.least(stop.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def positions(docs: DataFrame, count: int) -> DataFrame:
    """Rows with ``pos``: words of the same source before them in shuffled order."""
    bits = max(0, math.ceil(math.log2(max(1, count / RANGE_DOCS))))
    h = F.xxhash64(F.lit(SEED), F.col("id"), F.col("key"))
    rng = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    rows = docs.withColumn("h", h).withColumn("rng", rng)
    sums = rows.groupBy("src", "rng").agg(F.sum("size").alias("words"))
    sums = sums.select("src", "rng", _before(sums, "words", ["src"], "rng").alias("base"))
    w = Window.partitionBy("src", "rng").orderBy("h", "id", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("run", F.sum("size").over(w)).join(sums, ["src", "rng"])
            .withColumn("pos", F.col("base") + F.col("run") - F.col("size")).drop("h", "rng", "run", "base"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """slot, src, block: the source of each slot, and the slot's rank among that source's slots."""
    units = targets.withColumn("units", F.round(F.col("target") * 1000).cast("long"))
    heads = units.groupBy("part").agg(F.sum("units").alias("u"))
    heads = heads.select("part", (F.sum("u").over(Window.orderBy("part")) - F.col("u")).alias("first"))  # one row a partition
    spans = units.join(F.broadcast(heads), "part").withColumn("lo", F.col("first") + _before(units, "units", ["part"], "src"))
    spans = cut(spans.select("src", "lo", (F.col("lo") + F.col("units")).alias("hi")).filter("hi > lo"), "mix-spans")
    size = spans.agg(F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    spark = targets.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], "slot long, src long, block long")
    cell = max(1, size["hi"] // (4 * size["n"]))
    x = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1.0)).alias("x"))
    x = x.withColumn("u", F.least(F.floor(F.col("x") * size["hi"]), F.lit(size["hi"] - 1))).withColumn("cell", F.floor(F.col("u") / cell))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    named = x.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "src", F.floor(F.col("slot") / RUN).alias("run"))
    named = cut(named, "mix-slots")
    counts = named.groupBy("src", "run").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("src", "run", _before(counts, "n", ["src"], "run").alias("first"))
    rank = F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1
    return (named.withColumn("rank", rank).join(counts, ["src", "run"])
            .select("slot", "src", (F.col("first") + F.col("rank")).alias("block")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, schedule).

    documents: id, key, source, size, src, source_size, target, pos; pieces:
    src, pos, epoch, slot, first, words - the run of a document's words (from
    the word ``first`` on) that a slot plays; schedule: slot, src, block.
    """
    docs = cut(df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(source_col).alias("source"),
                         word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = cut(source_targets(docs, weights, max_repeat), "mix-targets")
    known = docs.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "part")
    laid = cut(positions(known, docs.count()), "mix-positions")
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    block = max(1, min(BLOCK_WORDS, total // SLOTS))
    slots = -(-total // block)
    plan = cut(schedule(targets, slots), "mix-schedule")
    start = F.col("pos") + F.col("epoch") * F.col("source_size")
    runs = (laid.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_repeat - 1).cast("long"))))
            .withColumn("lo", start).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.round("target").cast("long"))).filter("lo < hi")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
            .withColumn("at", F.greatest("lo", F.col("block") * block))
            .select("src", "pos", "epoch", "block", (F.col("at") - F.col("lo")).alias("first"), (F.least("hi", (F.col("block") + 1) * block) - F.col("at")).alias("words")))
    pieces = runs.join(plan, ["src", "block"], "left").withColumn("slot", F.coalesce("slot", F.lit(slots) + F.col("src")))
    return laid, pieces.select("src", "pos", "epoch", "slot", "first", "words"), plan


def taken_words(df: DataFrame, **options) -> DataFrame:
    """id, key, source, size, source_size, target, taken, ``plays`` (epochs that take the whole document) and ``part`` (words of
    the epoch that takes its beginning only, else 0)."""
    docs, pieces, _ = mix(df, **options)
    each = pieces.groupBy("src", "pos", "epoch").agg(F.sum("words").alias("words"))
    sums = each.groupBy("src", "pos").agg(F.sum("words").alias("taken"))
    some = F.col("size") > 0
    taken = F.when(some, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    # epochs play in order and only a source's last run is cut short
    out = docs.join(sums, ["src", "pos"], "left").withColumn("taken", taken)
    size = F.greatest("size", F.lit(1))
    return out.select("id", "key", "source", "size", "source_size", "target", "taken", F.floor(F.col("taken") / size).cast("int").alias("plays"),
                      (F.col("taken") % size).cast("long").alias("part"))


def beginning(text: Column, n: Column) -> Column:
    """The first n words, one blank apart."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(found, F.lit(1), n.cast("int")), " ")
