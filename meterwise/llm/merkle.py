"""Merkle dataset manifest: one tree per group, one tree over the groups' subroots.

A row's leaf is the SHA-256 of its columns (``-`` for null, else UTF-8 byte
count, ``:``, value); a node is the SHA-256 of the hex digests of at most FAN
consecutive nodes of the level below.

Coordinates by bitmap rank.  Every group's ids form a compressed bitmap: the
non-zero 64-bit words, merged with a bitwise or by partial aggregation.  A
directory of row counts over 2**16, 2**32 and 2**48 ids stands above the words,
so no window holds more than 2**16 counts of a group, whatever the ids.  A
leaf's position is the count before its word plus the popcount of the lower
bits; rows are never sorted.  Ids of several rows add their surplus, kept
beside the word, and equal ids ascend by leaf (again from counts, of the leaf's
first two bytes).

Levels by slot arrays.  SPAN = FAN**LEVELS consecutive nodes share the key
(group, position // SPAN); one grouped pass puts them in their slots and
reduces LEVELS levels.  The number of passes is the logarithm of the largest
group to the base SPAN.  Proofs come back downwards: each pass hands a block
the path above it (a row for SPAN rows of the pass below).

Defined cases: null ids come first in their group, equal rows are separate
leaves; a null group comes first, the others follow bytewise; an empty table
has no root and no rows; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ._tables import cut

FAN, LEVELS = 3, 6
SPAN = FAN ** LEVELS
NULL_WORD = -(1 << 62)  # before the word of every id
CHUNKS = (10, 26, 42)   # words of 2**16, 2**32 and 2**48 ids
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns' lengths and values."""
    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)), 256)


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above the nodes: up to one node, or LEVELS levels if the block is one of several (not ``whole``)."""
    out = [nodes]
    while len(out) <= LEVELS and (len(out[-1]) > 1 or not whole):
        out.append([hashed(*out[-1][i:i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """(left, right) siblings of a slot, from the lowest level up."""
    out = []
    for nodes in levels[:-1]:
        start = slot - slot % FAN
        out.append(("".join(nodes[start:slot]), "".join(nodes[slot + 1:start + FAN])))
        slot //= FAN
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashed(left, leaf, right)
    return leaf


@dataclass
class Manifest:
    leaves: DataFrame        # grp, block, slot, len, id, leaf, changed
    blocks: list[DataFrame]  # grp, block, slot, node: the passes above the leaves
    top: list[DataFrame]     # the passes over the subroots
    subroots: DataFrame      # grp, pos, rows, node
    root: str | None


def _positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, id, leaf, changed, n, pos): first position of each distinct row among its group's n copies; the groups' sizes."""
    spot = ["grp", "word"]
    ids = rows.groupBy(*spot, "bit").agg(F.sum("n").alias("n"))
    more = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("surplus")))
    words = cut(ids.groupBy(*spot).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"), F.collect_list(more).alias("more")), "bitmaps")
    counts = words.select(*spot, "n", *[F.shiftright("word", s).alias(f"c{s}") for s in CHUNKS])
    keys = ["word", *[f"c{s}" for s in CHUNKS]]
    before = None
    for k in range(len(keys) - 1, -1, -1):  # from the widest chunks down to words
        upper = keys[k + 1:k + 2]
        level = counts.groupBy("grp", *keys[k:]).agg(F.sum("n").alias("n"))
        inner = F.sum("n").over(Window.partitionBy("grp", *upper).orderBy(keys[k])) - F.col("n")
        level = level.withColumn("inner", inner)
        if before is None:
            before = level.select("grp", keys[k], F.col("inner").alias("before"))
        else:
            before = level.join(before, ["grp", *upper]).select("grp", keys[k], (F.col("inner") + F.col("before")).alias("before"))
    directory = words.drop("n").join(before, spot)
    lower = F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)")).cast("long")
    surplus = F.aggregate(F.filter("more", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda a, x: a + x["surplus"])
    placed = cut(rows.join(directory, spot).withColumn("pos", F.col("before") + lower + surplus)
                 .withColumn("again", F.exists("more", lambda x: x["bit"] == F.col("bit")))
                 .select(*rows.columns, "pos", "again"), "coordinates")
    # equal ids: counts of the leaf's first two bytes, then the order inside one of those
    same = [*spot, "bit"]
    repeated = placed.filter("again").withColumn("head", F.substring("leaf", 1, 4))
    inner = F.sum("n").over(Window.partitionBy(*same, "head").orderBy("leaf")) - F.col("n")
    heads = repeated.groupBy(*same, "head").agg(F.sum("n").alias("n"))
    heads = heads.select(*same, "head", (F.sum("n").over(Window.partitionBy(*same).orderBy("head")) - F.col("n")).alias("ahead"))
    repeated = repeated.withColumn("inner", inner).join(heads, [*same, "head"]).withColumn("pos", F.col("pos") + F.col("inner") + F.col("ahead"))
    columns = ["grp", "id", "leaf", "changed", "n", "pos"]
    return placed.filter("not again").select(*columns).unionByName(repeated.select(*columns)), words.groupBy("grp").agg(F.sum("n").alias("rows"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, slot, node) of (grp, pos, node)."""
    return cut(nodes.select("grp", F.expr(f"pos div {SPAN}").alias("block"), (F.col("pos") % SPAN).cast("int").alias("slot"), "node"), "nodes")


def _raise(blocks: DataFrame, name: str) -> DataFrame:
    """(grp, pos, node): the nodes LEVELS levels up, or a group's only one."""
    def run(t: pa.Table) -> pa.Table:
        slots = sorted(zip(t["slot"].to_pylist(), t["len"].to_pylist(), t[name].to_pylist()))
        nodes = [x for _, n, x in slots for _ in range(n)]
        block = t["block"][0].as_py()
        return pa.table({"grp": t["grp"][:1], "pos": t["block"][:1], "node": [tree(nodes, block == 0 and len(nodes) < SPAN)[-1][0]]})

    rows = blocks if "len" in blocks.columns else blocks.withColumn("len", F.lit(1))
    return rows.select("grp", "block", "slot", "len", name).groupBy("grp", "block").applyInArrow(run, "grp string, pos long, node string")


def _to_one(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All passes above (grp, pos, node), and the last nodes, one for each group."""
    passes, nodes = [], cut(first, "level")
    while (nodes.agg(F.max("pos")).first()[0] or 0) > 0:
        passes.append(_blocks(nodes))
        nodes = cut(_raise(passes[-1], "node"), "level")
    return passes, nodes


def build(df: DataFrame, id_col: str, group_col: str, columns: list[str], altered: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows; ``altered`` gives columns' values at a later time, to be verified against it."""
    now = [(altered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    same = F.lit(True)
    for c in altered or {}:
        same = same & altered[c].eqNullSafe(F.col(f"`{c}`"))
    one = F.col(f"`{id_col}`").cast("long")
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("grp"), one.alias("id"),
                     leaf.alias("leaf"), F.when(~same, leaf_digest(now)).alias("changed"))
    rows = (rows.groupBy("grp", "id", "leaf", "changed").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NULL_WORD)))
            .withColumn("bit", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")))
    rows, sizes = _positions(cut(rows, "leaves"))
    first, end = F.greatest("pos", F.col("block") * SPAN), F.least(F.col("pos") + F.col("n"), (F.col("block") + 1) * SPAN)
    leaves = cut(rows.withColumn("block", F.explode(F.expr(f"sequence(pos div {SPAN}, (pos + n - 1) div {SPAN})")))
                 .select("grp", "block", (first - F.col("block") * SPAN).cast("int").alias("slot"), (end - first).cast("int").alias("len"),
                         "id", "leaf", "changed"), "leaf-blocks")
    blocks, nodes = _to_one(_raise(leaves, "leaf"))
    # subroots in the order of the groups (the empty name of the null group is first)
    ordered = running_sums(nodes.select(F.lit(0).alias("all"), F.col("grp"), "node", F.lit(1).cast("long").alias("one")), ["all"], ["grp"], ["one"])
    subroots = cut(ordered.select("grp", (F.col("cum_one") - 1).alias("pos"), "node").join(sizes, "grp"), "subroots")
    top, last = _to_one(subroots.select(F.lit("").alias("grp"), "pos", "node"))
    root = last.first()
    return Manifest(leaves, blocks, top, subroots, root.node if root else None)


def _lower(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, pos, subroot, path) of every node of a pass, from those of its blocks."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()),
                        ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        nodes = [x for _, x in sorted(zip(t["slot"].to_pylist(), t["node"].to_pylist()))]
        grp, block, above = t["grp"][0].as_py(), t["block"][0].as_py(), p["path"][0].as_py()
        levels = tree(nodes, block == 0 and len(nodes) < SPAN)
        return pa.Table.from_pylist([
            {"grp": grp, "pos": block * SPAN + i, "subroot": p["subroot"][0].as_py(),
             "path": [{"left": a, "right": b} for a, b in siblings(levels, i)] + above} for i in range(len(nodes))], schema=schema)

    return cut(blocks.groupBy("grp", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("grp", "block"))
               .applyInArrow(run, f"grp string, pos long, subroot string, path {_PATH}"), "paths")


def prove(manifest: Manifest) -> DataFrame:
    """id, group, position, leaf, subroot, root, proof, proof_sha256, folded_root and verified of every row.

    folded_root comes from the altered leaf, if there is one, and the proof.
    """
    spark, root = manifest.leaves.sparkSession, manifest.root
    if root is None:
        return spark.createDataFrame([], _PROVED)
    paths = spark.createDataFrame([("", 0, None, [])], f"grp string, pos long, subroot string, path {_PATH}")
    for blocks in reversed(manifest.top):
        paths = _lower(blocks, paths)
    groups = manifest.subroots.select(F.col("grp").alias("own"), "pos", "node")
    paths = paths.join(groups, "pos").select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "path")
    for blocks in reversed(manifest.blocks):
        paths = _lower(blocks, paths)

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        rows = sorted(zip(t["slot"].to_pylist(), t["len"].to_pylist(), t["id"].to_pylist(), t["leaf"].to_pylist(), t["changed"].to_pylist()),
                      key=lambda r: r[0])
        nodes = [r[3] for r in rows for _ in range(r[1])]
        block, above = t["block"][0].as_py(), [(x["left"], x["right"]) for x in p["path"][0].as_py()]
        levels = tree(nodes, block == 0 and len(nodes) < SPAN)
        out = {k: [] for k in ("id", "pos", "leaf", "proof", "proof_sha256", "folded_root")}
        for slot, n, i, leaf, changed in rows:
            for s in range(slot, slot + n):
                path = siblings(levels, s) + above
                values = (i, block * SPAN + s, leaf, [{"left": a, "right": b} for a, b in path], hashed(*[a + b for a, b in path]), fold(changed or leaf, path))
                for k, v in zip(out, values):
                    out[k].append(v)
        grp, subroot, size = t["grp"][0].as_py(), p["subroot"][0].as_py(), len(nodes)
        columns = [out["id"], [grp[1:] if grp else None] * size, out["pos"], out["leaf"], [subroot] * size, [root] * size, out["proof"],
                   out["proof_sha256"], out["folded_root"], [f == root for f in out["folded_root"]]]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
                 pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])), pa.string(), pa.string(), pa.bool_()]
        return pa.table([pa.array(c, t_) for c, t_ in zip(columns, types)], names=[f.split()[0] for f in _PROVED.split(", ")])

    return (manifest.leaves.groupBy("grp", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(run, _PROVED))


_PROVED = ("id long, grp string, position long, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>, "
           "proof_sha256 string, folded_root string, verified boolean")
