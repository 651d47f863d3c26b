"""N-gram Jaccard join on parity sketches.

A text's set holds the 64-bit hashes of its distinct ``n``-word shingles;
texts with equal sets are one node.  A parity sketch of a set flips one bit
per shingle, so the Hamming distance of two sketches never exceeds the sets'
symmetric difference.  Two sets of sizes s and t with Jaccard similarity of
PERCENT or more differ in at most D = (s + t) * (100 - PERCENT) / (100 + PERCENT)
shingles.

Pigeonhole join.  Sizes are cut into bands; a band has a fixed number of sketch
segments, and a set also takes part in the next band if a partner may be there.
Segments are as wide as the hash, so a segment is kept as the XOR of its
shingles; at most D segments of two similar sets differ.  In any order of the
segments that all sets share, the first D + 1 segments of two similar sets have
one in common, so only these become join keys.  Segments come rare first
(shingles that repeat within map tasks are counted over the corpus; the most
frequent are known to every task), then by digest, empty ones last: exact for
any order, and a passage that many documents share makes no keys.

Candidates.  A key held by at most SMALL nodes gives all pairs of fitting
sizes.  A key held by more is worked in square blocks of BLOCK nodes that
exchange sketches only and return a spanning forest of the pairs that pass;
before that, each of its nodes is tried with the key's first node.
Every pair that passes the sketches' Hamming bound is verified on whole sets
before it counts.  Rounds: verify the best pair of every node, merge, and go
on with the pairs whose ends are still apart, until none is left; pairs inside
a component need no check, so groups of copies cost no quadratic output and no
link between components is lost.

Defined cases: a text without words (or null) has no set and is linked with
nothing; fewer than ``n`` words give one shingle; repeated rows are linked with
each other; a null id is linked like any other but is never a component's
smallest id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_garbage
from ._arrays import NON_BLANK, Hasher, U, give_back, keep_only, mix, signed, slices, words
from ._tables import cut, cut_with, text_key

WORDS, PERCENT = 5, 80
SMALL, BLOCK = 32, 4096
HOT_COUNT, HOT_SHINGLES = 16, 1 << 20
FIRST_BAND, BAND_RATIO, PARTS_PER = 16, 4, 4
BLOOM_BITS = 25
SEEN = 200_000
NONE = np.zeros(0, np.int64)
_STEP = [U(x | 1) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5)]


def _weight(k: int) -> np.uint64:
    return U(int(_STEP[k % 5]) * pow(0x9E3779B97F4A7C15, k // 5, 1 << 64) % (1 << 64))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row) by row."""
    s, e, row = words(data, off, NON_BLANK)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = Hasher(data).ranges(s, e)
    parts, rows = [], []
    if len(h) >= n:
        full = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
        total = np.zeros(len(full), np.uint64)
        for k in range(n):
            total += h[full + k] * _weight(k)
        parts.append(mix(total))
        rows.append(row[full])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    for f, c in zip(first[size < n], size[size < n]):
        total = U(0)
        with np.errstate(over="ignore"):
            for k in range(c):
                total = total + h[f + k] * _weight(k)
            parts.append(mix(np.array([total + U(c)])))
        rows.append(row[f:f + 1])
    x, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (r[1:] != r[:-1])]
    return x[new], r[new]


def nodes_of(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit name for every set."""
    raw = np.ascontiguousarray(x)
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) if b > a else 0 for a, b in zip(edge[:-1], edge[1:])], np.uint64)


def _sets(batches, n: int, once: bool) -> Iterator[tuple]:
    """(batch, first row, rows, set values, edges, node names, fresh) of each slice; fresh: first time in this task."""
    keep_only()
    seen: set[int] = set()
    for batch in batches:
        for lo, hi, data, off in slices(batch.column(0)):
            x, r = shingle_sets(data, off, n)
            edge = np.searchsorted(r, np.arange(hi - lo + 1))
            names = nodes_of(x, edge)
            fresh = np.diff(edge) > 0
            if once:
                for i in np.flatnonzero(fresh):
                    fresh[i] = int(names[i]) not in seen
                    seen.add(int(names[i]))
                if len(seen) > SEEN:
                    seen = set()
            yield batch, lo, hi, x, edge, names, fresh


def _pick(x: np.ndarray, edge: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers (among the kept rows) of the kept rows."""
    size = np.diff(edge)
    return x[np.repeat(keep, size)], np.repeat(np.arange(int(keep.sum())), size[keep])


def most_different(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of two linked sets of these sizes."""
    return (size + other) * (100 - percent) // (100 + percent)


def bands(size: np.ndarray) -> np.ndarray:
    out, edge = np.zeros(len(size), np.int64), FIRST_BAND
    while (size > edge).any():
        out[size > edge] += 1
        edge *= BAND_RATIO
    return out


def prefix_keys(x: np.ndarray, row: np.ndarray, size: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the join keys of every set; ``hot`` marks frequent shingles, ``size`` is by row."""
    partner = size * 100 // percent
    most = most_different(size, partner, percent)
    home, reach = bands(size), bands(partner)
    keys, rows = [], []
    for band in range(int(reach.max()) + 1 if len(reach) else 0):
        member = (home == band) | ((home < band) & (reach >= band))
        if not member.any():
            continue
        mine = member[row]
        v, r, f = x[mine], row[mine], hot[mine]
        if band == 0:  # every shingle is a segment
            digest, seg_row, frequent = mix(v ^ U(0x51ED270B)), r, f
        else:
            parts = PARTS_PER * FIRST_BAND * BAND_RATIO ** (band - 1)
            seg = ((v >> U(32)) * U(parts)) >> U(32)
            order = np.lexsort((seg, r))
            v, r, f, seg = v[order], r[order], f[order], seg[order]
            new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (r[1:] != r[:-1])])
            digest = mix(np.bitwise_xor.reduceat(v, new) ^ mix(seg[new] + U(band << 40)))
            seg_row, frequent = r[new], np.logical_and.reduceat(f, new)
        order = np.lexsort((digest, frequent, seg_row))
        digest, seg_row = digest[order], seg_row[order]
        first = np.searchsorted(seg_row, seg_row, side="left")
        keep = np.arange(len(seg_row)) - first <= most[seg_row]
        keys.append(digest[keep])
        rows.append(seg_row[keep])
        if band:
            count = np.bincount(seg_row, minlength=len(size))
            for i in np.flatnonzero(member & (count <= most)):  # hardly ever: empty segments come last, lowest number first
                used = set((((x[row == i] >> U(32)) * U(parts)) >> U(32)).tolist())
                free = np.array([s for s in range(parts) if s not in used][:int(most[i]) + 1 - int(count[i])], np.uint64)
                keys.append(mix(mix(free + U(band << 40))))
                rows.append(np.full(len(free), i))
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketch(values: np.ndarray) -> np.ndarray:
    """Parity sketch as 64-bit words; the number of bits is a power of two from the set's size."""
    bits = max(256, 1 << int(4 * len(values) - 1).bit_length())
    flips = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words_: np.ndarray, n: int) -> np.ndarray:
    """The sketch of the same set with fewer bits; also for rows of sketches."""
    while words_.shape[-1] > n:
        half = words_.shape[-1] // 2
        words_ = words_[..., :half] ^ words_[..., half:]
    return words_


def distance(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, n) ^ fold(b, n)).sum())


def fits(s, t, percent: int):
    """Sizes that linked sets may have."""
    return (100 * np.minimum(s, t) >= percent * np.maximum(s, t))


class Bloom:
    """A fixed number of bits, whatever the input; a member is always found."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, name: int) -> bool:
        at = int(name) >> (64 - BLOOM_BITS)
        return bool(self.bits[at >> 6] >> U(at & 63) & U(1))

    def marks(self, names: np.ndarray) -> np.ndarray:
        """Which of the names may be members."""
        at = names >> U(64 - BLOOM_BITS)
        return (self.bits[at >> U(6)] >> (at & U(63)) & U(1)).astype(bool)

    @classmethod
    def of(cls, nodes: DataFrame, column: str = "node") -> Bloom:
        """At most 2**BLOOM_BITS / 64 rows come to the driver."""
        at = F.shiftrightunsigned(column, 64 - BLOOM_BITS)
        rows = (nodes.select(at.alias("at")).select(F.expr("at >> 6").alias("w"), F.expr("shiftleft(1L, cast(at & 63 AS INT))").alias("b"))
                .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
        bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        bits[rows.w.to_numpy(np.int64)] = rows.b.to_numpy(np.int64).view(np.uint64)
        del rows
        give_back()
        return cls(bits)


def _scan(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(id, key, n_shingles, node) of every row, and the hashes of frequent shingles."""
    def run(batches):
        for batch in batches:
            ids, key = batch.column(1), batch.column(2)
            seen: set[int] = set()
            pool = []
            for _, lo, hi, x, edge, names, fresh in _sets([batch], n, False):
                for i in np.flatnonzero(fresh):
                    fresh[i] = int(names[i]) not in seen
                    seen.add(int(names[i]))
                pool.append(_pick(x, edge, fresh)[0])
                size = np.diff(edge)
                yield _scanned(ids.slice(lo, hi - lo), key.slice(lo, hi - lo), size, signed(names), NONE, NONE)
            x = np.sort(np.concatenate(pool)) if pool else np.zeros(0, np.uint64)
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.r_[start, len(x)])
            again = count > 1
            yield _scanned(NONE, NONE, NONE, NONE, signed(x[start[again]]), count[again])

    both = cut(docs.select("text", "id", "key").mapInArrow(run, "id long, key long, n_shingles long, node long, shingle long, times long"), "shingles")
    hot = (both.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("n")).filter(F.col("n") >= HOT_COUNT)
           .orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).select("shingle").toPandas())
    return both.filter("n_shingles is not null").select("id", "key", "n_shingles", "node"), np.sort(hot.shingle.to_numpy(np.int64).view(np.uint64))


def _scanned(ids, key, size, names, shingle, times) -> pa.RecordBatch:
    """Rows of texts, or of repeated shingles."""
    def padded(x, front: int, back: int) -> pa.Array:
        x = x if isinstance(x, pa.Array) else pa.array(np.asarray(x, np.int64))
        return pa.concat_arrays([pa.nulls(front, pa.int64()), x, pa.nulls(back, pa.int64())])
    a, b = len(size), len(shingle)
    return pa.RecordBatch.from_arrays([padded(ids, 0, b), padded(key, 0, b), padded(size, 0, b), padded(names, 0, b),
                                       padded(shingle, a, 0), padded(times, a, 0)],
                                      names=["id", "key", "n_shingles", "node", "shingle", "times"])


def _keys(docs: DataFrame, hot: np.ndarray, n: int, percent: int, wanted: Bloom | None = None) -> tuple[DataFrame, Broadcast]:
    """(key, node, size) of every distinct set of a task; of ``wanted`` keys (and a few others) only; and what its tasks read."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, wanted))  # at most HOT_SHINGLES hashes, 2**BLOOM_BITS bits

    def run(batches):
        h, bloom = shared.value
        marks = np.zeros(1 << 20, bool)
        marks[h >> U(44)] = True
        for _, _, _, x, edge, names, fresh in _sets(batches, n, True):
            v, row = _pick(x, edge, fresh)
            if not len(v):
                continue
            frequent = marks[v >> U(44)]
            at = np.flatnonzero(frequent)
            frequent[at] = h[np.minimum(np.searchsorted(h, v[at]), len(h) - 1)] == v[at]
            size = np.diff(edge)[fresh]
            key, r = prefix_keys(v, row, size, frequent, percent)
            if bloom is not None:
                may = bloom.marks(key)
                key, r = key[may], r[may]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(names[fresh][r])), pa.array(size[r].astype(np.int32))],
                                             names=["key", "node", "size"])

    return docs.select("text").mapInArrow(run, "key long, node long, size int"), shared


def _release(spark: SparkSession, shared: Broadcast) -> None:
    """Drop a broadcast whose readers have ended, and the driver's garbage."""
    shared.destroy()
    drop_garbage(spark)
    give_back()


def _whole_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, n: int, sketches: bool) -> DataFrame:
    """(node, size, data): the set, or its parity sketch, of the wanted nodes (and of a few others).

    One text stands for each node, by its key; other texts are not cut into shingles again."""
    named = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(named, "key"))

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.marks(batch.column(1).to_numpy().view(np.uint64))))

    def run(batches):
        for _, _, _, x, edge, names, fresh in _sets(chosen(batches), n, True):
            at = np.flatnonzero(fresh)
            data = [(sketch(x[edge[i]:edge[i + 1]]) if sketches else x[edge[i]:edge[i + 1]]).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(names[at])), pa.array(np.diff(edge)[at].astype(np.int32)), pa.array(data, pa.binary())],
                                             names=["node", "size", "data"])

    found = docs.select("text", "key").mapInArrow(run, "node long, size int, data binary")
    out = cut(found.groupBy("node").agg(F.first("size").alias("size"), F.first("data").alias("data")), "sketches" if sketches else "whole-sets")
    _release(docs.sparkSession, shared)
    return out


def _passing(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, dist): the pairs whose sketches may be linked."""
    a = sketches.select(F.col("node").alias("a"), F.col("data").alias("da"), F.col("size").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("data").alias("db"), F.col("size").alias("sb"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            most = most_different(batch.column(3).to_numpy().astype(int), batch.column(5).to_numpy().astype(int), percent)
            d = np.array([distance(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
                          for p, q in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())], np.int64)
            ok = d <= most if len(d) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok]), pa.array(d[ok])], names=["a", "b", "dist"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "da", "sa", "db", "sb")
    return joined.mapInArrow(run, "a long, b long, dist long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked): exact Jaccard test on whole sets."""
    right = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("data").alias("db")), "b")
    left = sets.select(F.col("node").alias("a"), F.col("data").alias("da"))

    def run(batches):
        for batch in batches:
            ok = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return right.join(left, "a").select("a", "b", "da", "db").mapInArrow(run, "a long, b long, linked boolean")


def _forest(members: pd.DataFrame, refused: pd.DataFrame, percent: int, each: int) -> list[tuple[int, int]]:
    """The passing pairs between different components of one key's block pair.

    Of every node the nearest ``each`` in each other component; for 1, a spanning
    forest of those.  Pairs inside the most common component are never looked at.
    """
    node, comp, size = members.node.to_numpy(), members.comp.to_numpy(), members["size"].to_numpy().astype(int)
    side = members.side.to_numpy()
    words_ = min(len(x) for x in members.data) // 8
    maps = np.stack([fold(np.frombuffer(x, np.uint64), words_) for x in members.data])
    names, count = np.unique(comp, return_counts=True)
    giant = names[count.argmax()]
    no = set(zip(refused.a, refused.b))
    found = []
    for i in np.flatnonzero(comp != giant):
        y = np.flatnonzero((comp != comp[i]) & ((side == 2) | (side != side[i])) & fits(size, size[i], percent))
        d = np.bitwise_count(maps[y] ^ maps[i]).sum(axis=1, dtype=np.int64)
        ok = d <= most_different(size[y], size[i], percent)
        y, d = y[ok], d[ok]
        if no:
            ok = np.array([(min(node[i], node[j]), max(node[i], node[j])) not in no for j in y], bool)
            y, d = y[ok], d[ok]
        order = np.lexsort((node[y], d, comp[y]))
        y, d = y[order], d[order]
        place = np.arange(len(y)) - np.searchsorted(comp[y], comp[y], side="left")
        for j in np.flatnonzero(place < each):
            found.append((d[j], (min(node[i], node[y[j]]), max(node[i], node[y[j]])), comp[i], comp[y[j]]))
    if each > 1:
        return list({x[1] for x in found})
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for _, pair, c1, c2 in sorted(found):
        r1, r2 = root(c1), root(c2)
        if r1 != r2:
            parent[max(r1, r2)] = min(r1, r2)
            out.append(pair)
    return out


def _dense_pairs(dense: DataFrame, comps: DataFrame, refused: DataFrame, sketches: DataFrame, percent: int, each: int) -> DataFrame:
    """(a, b): candidate links between components of the keys with many nodes, from square blocks of sketches."""
    rows = dense.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    live = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    rows = rows.join(live.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")

    def squares(df: DataFrame) -> DataFrame:
        """A row for each block pair (i, j), i <= j, of the row's block; side 0: block i, 1: block j, 2: both."""
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        other = df.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return (other.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))
                .withColumn("side", F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1)))

    left = squares(rows).join(sketches.select("node", "data"), "node").select("key", "i", "j", "node", "size", "comp", "side", "data")
    ends = rows.select("key", "node", "blocks")
    bad = (refused.join(ends.withColumnRenamed("node", "a"), "a")
           .join(ends.select(F.col("key").alias("key_b"), F.col("node").alias("b")), "b").filter("key = key_b")
           .withColumn("pa", F.pmod(F.xxhash64("a"), F.col("blocks"))).withColumn("pb", F.pmod(F.xxhash64("b"), F.col("blocks")))
           .select(F.col("key").alias("bad_key"), F.least("pa", "pb").alias("bad_i"), F.greatest("pa", "pb").alias("bad_j"), "a", "b"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        pairs = _forest(x, y, percent, each) if len(x) > 1 else []
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    return left.groupBy("key", "i", "j").cogroup(bad.groupBy("bad_key", "bad_i", "bad_j")).applyInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the links (a, b); alternating large and small stars."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        kept = down.join(least, "a")
        return (kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                .filter("a <> b").distinct())

    mark = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges = links.filter("a <> b").distinct()  # the callers' links are a table already
    before = None
    while True:
        edges, now = cut_with(star(star(edges, True), False), "stars", **mark)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = now


def linked_nodes(docs: DataFrame, scanned: DataFrame, hot: np.ndarray, n: int, percent: int) -> DataFrame:
    """(node, comp) of every node that is linked with another; ``scanned`` has the node of every text's key."""
    spark = docs.sparkSession
    keyed, read = _keys(docs, hot, n, percent)
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = cut(ends.filter("lo <> hi").select("key"), "shared-keys")
    _release(spark, read)
    keyed, read = _keys(docs, hot, n, percent, Bloom.of(shared, "key"))
    live = cut(keyed.join(shared, "key", "left_semi").distinct(), "live-keys")
    _release(spark, read)
    counts = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    live = live.join(counts, "key")
    sketches = _whole_sets(docs, scanned, live.select("node").distinct(), n, True)
    few = live.filter(F.col("n") <= SMALL).select("key", "node", "size")
    other = few.select("key", F.col("node").alias("b"), F.col("size").alias("sb"))
    pairs = (few.select("key", F.col("node").alias("a"), F.col("size").alias("sa")).join(other, "key")
             .filter((F.col("a") < F.col("b")) & (100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb"))).select("a", "b").distinct())
    rows = {"n": F.count(F.lit(1))}
    dense, many = cut_with(live.filter(F.col("n") > SMALL).select("key", "node", "size"), "dense-keys", **rows)
    some_dense = bool(many["n"])
    hubs = dense.groupBy(F.col("key").alias("hub_key")).agg(F.min(F.struct("node", "size")).alias("hub"))
    stars = (dense.join(hubs, F.col("key") == F.col("hub_key")).filter(F.col("node") != F.col("hub.node"))
             .filter(100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size"))
             .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
    open_pairs = cut(_passing(pairs.unionByName(stars), sketches, percent), "passing-pairs")
    wanted = (open_pairs.select(F.col("a").alias("node")).unionByName(open_pairs.select(F.col("b").alias("node")))
              .unionByName(dense.select("node")).distinct())
    sets = _whole_sets(docs, scanned, wanted, n, False)
    links = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "node long, comp long")
    refused = spark.createDataFrame([], "a long, b long")
    first, each = True, 1
    while True:
        if not first:
            ca, cb = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
            apart = (open_pairs.join(ca, "a", "left").join(cb, "b", "left")
                     .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "dist"))
            open_pairs = cut(apart.join(refused, ["a", "b"], "left_anti"), "open-pairs")
        if first:  # the nearest partner of each node, from either side
            ends = open_pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"), "dist")
            todo = ends.groupBy("node").agg(F.min(F.struct("dist", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            todo = open_pairs.select("a", "b")
        if some_dense and not first:
            todo = todo.unionByName(_dense_pairs(dense, comps, refused, sketches, percent, each))
            each *= 16  # a node with many near misses needs few rounds
        tested, found = cut_with(verify(todo.distinct(), sets, percent), "verified", linked=F.count_if("linked"), **rows)
        if not found["n"] and not first:
            return comps
        refused = cut(refused.unionByName(tested.filter("not linked").select("a", "b")), "refused")
        if found["linked"]:
            links = cut(links.unionByName(tested.filter("linked").select("a", "b")), "all-links")
            comps = cut(components(links), "components")
        drop_garbage(spark)
        first = False


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, key (digest of the text), n_shingles, component (null without words), component_id (smallest id reachable by links) of every row."""
    docs = df.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"))
    rows, hot = _scan(docs, n)
    comps = linked_nodes(docs, rows, hot, n, percent)
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("own"))
    named = classes.join(comps, "node", "left").withColumn("component", F.coalesce("comp", "node"))
    least = named.groupBy("component").agg(F.min("own").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component", "component_id")
    columns = ["id", "key", "n_shingles", "component", "component_id"]
    alone = rows.filter("n_shingles = 0").select("id", "key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return rows.filter("n_shingles > 0").join(by_node, "node").select(*columns).unionByName(alone)
