"""Exact top-k search by integer inner product over a bit-sliced index.

Every vector component x becomes the integer floor(256 * x).  Rows are cut
into blocks; a block stores, per component, one bitmap for each bit of
(value - the block's minimum).  A query adds the slices it needs with bitmap
arithmetic: each component weight is written in signed binary digits, a
negative digit takes the complement of a slice, and all bitmaps of one
weight are summed by carry-save adders into result slices.  The k best rows
are selected from the most significant result slice downward; rows that
still tie at the boundary are resolved exactly by the smaller id.

Index blocks and query blocks meet in a grid of cells (each block is copied
to one row of cells, each query block to one column), so a cell's memory is
bounded by a few blocks; every cell returns at most k rows per query.

Defined cases: a row with null id, null vector, or a null or non-finite
component takes no part; a row is compared with rows of its own length only;
rows that repeat a query's id are its own rows and no candidates; an id that
repeats as a query uses its first vector in value order; inner products are
compared exactly and those beyond 64 bits reported as the end of that range.
Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut

BLOCK_ROWS = 32768
QUERY_ROWS = 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
CELL_BLOCKS = 4
INDEX_SCHEMA = "block long, dims int, ids binary, base binary, bits binary, slices binary"
QUERY_SCHEMA = "block long, dims int, ids binary, vectors binary"
HIT_SCHEMA = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): whole-number vectors of the rows that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
            .filter(F.col("id").isNotNull() & F.col("e").isNotNull() & F.forall("e", finite))
            .select("id", F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))


def _chunks(batches, rows: int):
    """(dims, ids, matrix) pieces of at most ``rows`` rows with equal vector length."""
    held: dict[int, list] = {}
    for b in batches:
        ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        off = col.offsets.to_numpy()
        flat = col.values.to_numpy(zero_copy_only=False)
        size = np.diff(off)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            m = flat[(off[at][:, None] + np.arange(d)[None, :])] if d else np.zeros((len(at), 0), np.int64)
            held.setdefault(int(d), []).append((ids[at], m))
            if sum(len(x[0]) for x in held[int(d)]) >= rows:
                parts = held.pop(int(d))
                i, v = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                full = len(i) // rows * rows
                for lo in range(0, full, rows):
                    yield int(d), i[lo:lo + rows], v[lo:lo + rows]
                if full < len(i):
                    held[int(d)] = [(i[full:], v[full:])]
    for d, parts in held.items():
        yield d, np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def _bitmap(mask: np.ndarray) -> np.ndarray:
    words = -(-len(mask) // 64)
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[:len(packed)] = packed
    return out.view(np.uint64)


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of the bit-sliced index; no shuffle."""
    def build(batches):
        pid = TaskContext.get().partitionId()
        for k, (d, ids, v) in enumerate(_chunks(batches, block_rows)):
            base = v.min(axis=0) if d else np.zeros(0, np.int64)
            u = (v - base).astype(np.uint64)
            bits = np.array([int(u[:, j].max()).bit_length() for j in range(d)], np.uint8)
            maps = [_bitmap((u[:, j] >> np.uint64(b)) & np.uint64(1)) for j in range(d) for b in range(bits[j])]
            raw = np.concatenate(maps).tobytes() if maps else b""
            yield pa.RecordBatch.from_pylist([{"block": (pid << 32) + k, "dims": d, "ids": ids.astype(np.int64).tobytes(),
                                               "base": base.tobytes(), "bits": bits.tobytes(), "slices": raw}],
                                             schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()),
                                                               ("base", pa.binary()), ("bits", pa.binary()), ("slices", pa.binary())]))
    return rows.select("id", "v").mapInArrow(build, INDEX_SCHEMA)


def build_queries(rows: DataFrame, query_rows: int = QUERY_ROWS) -> DataFrame:
    def build(batches):
        pid = TaskContext.get().partitionId()
        for k, (d, ids, v) in enumerate(_chunks(batches, query_rows)):
            yield pa.RecordBatch.from_pylist([{"block": (pid << 32) + k, "dims": d, "ids": ids.astype(np.int64).tobytes(),
                                               "vectors": v.astype(np.int64).tobytes()}],
                                             schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()),
                                                               ("ids", pa.binary()), ("vectors", pa.binary())]))
    return rows.select("id", "v").mapInArrow(build, QUERY_SCHEMA)


class Block:
    """A bit-sliced index block and its top-k selection."""

    def __init__(self, row):
        self.dims = int(row.dims)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.base = np.frombuffer(row.base, np.int64)
        bits = np.frombuffer(row.bits, np.uint8)
        self.words = -(-len(self.ids) // 64)
        self.maps = np.frombuffer(row.slices, np.uint64).reshape(-1, self.words) if len(row.slices) else np.zeros((0, self.words), np.uint64)
        self.dim_of = np.repeat(np.arange(self.dims), bits)
        self.bit_of = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if self.dims else np.zeros(0, np.int64)
        self.valid = _bitmap(np.ones(len(self.ids), np.uint8))
        self.order = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.order]

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Result slices (least significant first) and the constant to add to them."""
        size = np.abs(q).astype(np.uint64)
        half = size >> np.uint64(1)
        three = size + half
        plus, minus = three & (half ^ three), half & (half ^ three)  # signed binary digits
        plus, minus = np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)
        const = int(sum(int(a) * int(b) for a, b in zip(q, self.base)))
        bags: dict[int, list[np.ndarray]] = {}
        width = int((plus | minus).max()).bit_length() if self.dims else 0
        for c in range(width):
            for digit, flip in ((plus, False), (minus, True)):
                at = np.flatnonzero((digit[self.dim_of] >> np.uint64(c)) & np.uint64(1))
                weights = self.bit_of[at] + c
                for w in np.unique(weights):
                    maps = self.maps[at[weights == w]]
                    if flip:
                        const -= len(maps) << int(w)
                        maps = ~maps
                    bags.setdefault(int(w), []).append(maps)
        out, w = [], 0
        while bags:
            here = bags.pop(w, None)
            if here is None:
                out.append(np.zeros(self.words, np.uint64))
                w += 1
                continue
            bag, up = np.concatenate(here), []
            while len(bag) > 2:  # carry-save adders: three bitmaps become a sum and a carry
                t = len(bag) // 3
                a, b, c = bag[:t], bag[t:2 * t], bag[2 * t:3 * t]
                x = a ^ b
                up.append((a & b) | (x & c))
                bag = np.concatenate([x ^ c, bag[3 * t:]])
            if len(bag) == 2:
                up.append((bag[0] & bag[1])[None, :])
                bag = (bag[0] ^ bag[1])[None, :]
            if up:
                bags.setdefault(w + 1, []).extend(up)
            out.append(bag[0])
            w += 1
        return out, const

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the block: higher score first, ties to the smaller id."""
        levels, const = self.sums(q)
        left = self.valid.copy()
        for r in self.order[np.searchsorted(self.sorted, query_id):np.searchsorted(self.sorted, query_id, side="right")]:
            left[r >> 6] &= ~np.uint64(1 << int(r & 63))
        sure, need = np.zeros(self.words, np.uint64), k
        if int(np.bitwise_count(left).sum()) <= k:
            sure, need = left, 0
        for level in reversed(levels):
            if not need:
                break
            ones = left & level
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                left = ones
            else:
                sure |= ones
                left &= ~level
                need -= n
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if need:  # every row left has the same score
            ties = np.flatnonzero(np.unpackbits(left.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, ties[np.argsort(self.ids[ties], kind="stable")[:need]]])
        return [(int(self.ids[r]), const + sum(((int(m[r >> 6]) >> int(r & 63)) & 1) << w for w, m in enumerate(levels)))
                for r in rows]


def search(index: DataFrame, queries: DataFrame, k: int, cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """The k best rows of every query: query_id, rank (from 1), vec_id, score."""
    n_index, n_query = index.count(), queries.count()
    down, across = max(1, -(-n_index // cell_blocks)), max(1, -(-n_query // cell_blocks))

    def spot(n: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")

    left = (index.withColumn("r", spot(down)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    right = (queries.withColumn("c", spot(across)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list] = {}
        for row in a.itertuples(index=False):
            block = Block(row)
            for chunk in b[b.dims == row.dims].itertuples(index=False):
                ids = np.frombuffer(chunk.ids, np.int64)
                vectors = np.frombuffer(chunk.vectors, np.int64).reshape(len(ids), -1)
                for i, q in zip(ids, vectors):
                    best[int(i)] = sorted(best.get(int(i), []) + block.top(int(i), q, k), key=lambda x: (-x[1], x[0]))[:k]
        out = [(i, v, min(max(s, LEAST), MOST)) for i, hits in best.items() for v, s in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    hits = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(meet, HIT_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k(df: DataFrame, id_col: str, vector_col: str, k: int, is_query: Column, scale: int = 256) -> DataFrame:
    """Exact top-k of the rows for which ``is_query`` (a condition on ``id``) holds, against all rows."""
    rows = quantised(df, id_col, vector_col, scale)
    asked = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    return search(cut(build_index(rows), "bit-slices"), cut(build_queries(asked), "queries"), k)
