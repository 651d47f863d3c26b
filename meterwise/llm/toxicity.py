"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are words (lower-cased; letters, digits and non-ASCII) and their byte
prefixes of PREFIXES lengths, as 64-bit hashes.  The vocabulary holds every
term of a sampled toxic text that no sampled clean text has, or whose
chi-square with the label is what chance gives (1) or more: there is no least
number of texts and no largest number of terms.  A term weighs its TF-IDF, with
document frequencies over all documents, times chi / (chi + HALF), so rare
words count little beside proven ones and decide where there are no others.
The examples are blocks of an inverted index of postings; every term keeps its
largest weight in each block that holds it.  A query first bounds each block by the sum of those
maxima, scores the two best blocks, and then every block whose bound reaches
the k-th best score, so the k nearest examples are exact.  The neighbours vote
with their squared similarity; an isotonic map, fitted on the sampled rows (an
example votes without itself) and weighted to the labels' true shares, turns
votes into probabilities.

The labelled sample is bounded: ``max_toxic`` and ``max_clean`` rows (smallest
digests of the id), of which ``max_examples`` of each label are examples.
Words that occur in no sampled toxic text are not known to the model.

Defined cases: a null or empty text, or one without vocabulary terms, has no
neighbours and gets the calibrated share of label 1 among such texts; without
any labelled row every score is 0; ids that are null or carry two labels learn
nothing or label 1; repeated rows keep their own score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import ALNUM, Hasher, U, give_back, keep_only, mix, signed, slices, words
from ._tables import crc_mod, cut

PREFIXES = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN, MAX_EXAMPLES = 2048, 4096, 1024
CHANCE, HALF = 1.0, 30.0
BLOCK, NEIGHBOURS = 64, 9
RANGE_BITS = 10
_SALT = {n: U(0x1000193 * (n + 1)) for n in (0, *PREFIXES)}


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of every word and prefix."""
    s, e, row = words(data, off, ALNUM)
    h = Hasher(data)
    out, rows = [h.ranges(s, e)], [row]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        out.append(mix(h.ranges(s[long], s[long] + n) ^ _SALT[n]))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


class Vocabulary:
    """Sorted term hashes; looked up behind a bitmap that almost all other terms miss."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & U((1 << 20) - 1)] = True

    def slots(self, term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, row) of the terms that are in the vocabulary."""
        may = self.seen[term & U((1 << 20) - 1)]
        term, row = term[may], row[may]
        at = np.minimum(np.searchsorted(self.hashes, term), max(0, len(self.hashes) - 1))
        ok = self.hashes[at] == term if len(self.hashes) else np.zeros(0, bool)
        return at[ok], row[ok]


def _counted(slot: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, slot) with their counts, by row."""
    pair, n = np.unique(row * width + slot, return_counts=True)
    return pair // width, pair % width, n


def _spread(edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members edges[i]:edges[i + 1] of every i in ``at``, and their number for each."""
    lo = edges[at]
    size = edges[at + 1] - lo
    total = np.cumsum(size)
    return np.repeat(lo - (total - size), size) + np.arange(total[-1] if len(total) else 0), size


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    runs: np.ndarray         # term t has the runs runs[t]:runs[t + 1], one for each block that holds it
    run_block: np.ndarray    # block of a run, and its largest weight
    run_max: np.ndarray
    run_at: np.ndarray       # a run has the postings run_at[r]:run_at[r + 1]
    example: np.ndarray      # of a posting, and its normalised TF-IDF weight
    weight: np.ndarray
    labels: np.ndarray       # of the examples, padded to whole blocks
    ids: np.ndarray
    steps: np.ndarray        # isotonic map: vote -> probability
    values: np.ndarray
    alone: float             # score of a text without neighbours

    @property
    def weights(self) -> np.ndarray:
        """(terms, blocks, BLOCK): the postings as a dense array, to inspect small models."""
        out = np.zeros((len(self.idf), len(self.labels)), np.float32)
        out[np.repeat(np.arange(len(self.idf)), np.diff(self.run_at[self.runs])), self.example] = self.weight
        return out.reshape(len(self.idf), -1, BLOCK)

    def vector(self, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[slot]
        return w / np.sqrt((w * w).sum())

    def _scored(self, run: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sums of weight products over the postings of the runs, for every example."""
        at, size = _spread(self.run_at, run)
        return np.bincount(self.example[at], weights=np.repeat(q, size) * self.weight[at], minlength=len(self.labels))

    def nearest(self, slot: np.ndarray, n: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact k nearest examples (position, cosine) with a positive cosine."""
        q = self.vector(slot, n)
        run, size = _spread(self.runs, slot)
        q, block = np.repeat(q, size), self.run_block[run]
        bound = np.bincount(block, weights=q * self.run_max[run], minlength=len(self.labels) // BLOCK)
        best = np.argsort(-bound, kind="stable")
        chosen = np.zeros(len(bound), bool)
        chosen[best[:2]] = True
        now = chosen[block]
        flat = self._scored(run[now], q[now])
        seen = np.repeat(chosen, BLOCK)
        if without >= 0:
            seen[without] = False
        seen = flat[seen]
        theta = np.partition(seen, -NEIGHBOURS - 1)[-NEIGHBOURS - 1] if len(seen) > NEIGHBOURS else 0.0
        now = ((bound >= theta - 1e-5) & ~chosen)[block]
        if now.any():
            flat += self._scored(run[now], q[now])
        if without >= 0:
            flat[without] = -1
        flat[len(self.ids):] = -1
        at = np.flatnonzero(flat > 1e-6)
        at = at[np.lexsort((at, -flat[at]))][:NEIGHBOURS]
        return at, flat[at]

    def vote(self, slot: np.ndarray, n: np.ndarray, without: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        at, sim = self.nearest(slot, n, without) if len(slot) else (np.zeros(0, int), np.zeros(0))
        if not len(at):
            return None, at, sim
        w = sim.astype(float) ** 2
        return float((w * self.labels[at]).sum() / w.sum()), at, sim

    def score(self, vote: float | None) -> float:
        if vote is None:
            return self.alone
        return float(0.98 * np.interp(vote, self.steps, self.values) + 0.02 * vote)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: step positions and non-decreasing values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([x[i], y[i] * w[i], w[i], x[i]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + b[1], blocks[-1][2] + b[2], b[3]]
    px = np.array([v for b in blocks for v in (b[0], b[3])])
    py = np.repeat([(b[1] + 0.5 * 1e-3) / (b[2] + 1e-3) for b in blocks], 2)
    return px, py


def _labelled(labels: DataFrame, id_col: str, label_col: str, max_toxic: int, max_clean: int) -> tuple[DataFrame, dict]:
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y")))
    most = F.when(F.col("y") == 1, max_toxic).otherwise(max_clean)
    # ranks inside digest ranges plus the counts of the ranges before: no label is one task
    rows = rows.withColumn("h", F.xxhash64("id")).withColumn("rng", F.shiftright("h", 64 - RANGE_BITS))
    sums = rows.groupBy("y", "rng").agg(F.count(F.lit(1)).alias("n"))  # at most 2 * 2**RANGE_BITS rows
    totals = {r.y: r.n for r in sums.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("y").orderBy("rng")) - F.col("n")
    used = sums.withColumn("before", before).filter(F.col("before") < most).select("y", "rng", "before")
    w = Window.partitionBy("y", "rng").orderBy("h", "id")
    sample = (rows.join(used, ["y", "rng"]).withColumn("at", F.col("before") + F.row_number().over(w))
              .filter(F.col("at") <= most).select("id", "y"))
    return sample, totals


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_examples: int = MAX_EXAMPLES) -> Model | None:
    """Learn from the rows of ``labels`` (the caller leaves out what must be held out)."""
    spark = docs.sparkSession
    sample, totals = _labelled(labels, id_col, label_col, max_toxic, max_clean)
    sample = spark.createDataFrame(sample.collect(), "id long, y int")  # at most max_toxic + max_clean ids
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = cut(text.join(F.broadcast(sample), "id"), "labelled-texts")

    def label_counts(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in slices(batch.column(0)):
                term, row = terms(data, off)
                order = np.lexsort((row, term))
                term, row = term[order], row[order]
                new = np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])] if len(term) else np.zeros(0, bool)
                t, at = np.unique(term[new], return_inverse=True)
                toxic = y[lo + row[new]] == 1
                n = [np.bincount(at[toxic == k], minlength=len(t)).astype(np.int64) for k in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(t)), *map(pa.array, n)], names=["term", "tox", "clean"])

    size = labelled.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("tox"), F.count(F.lit(1)).alias("n")).first()
    found = _singled(labelled.select("text", "y").mapInArrow(label_counts, "term long, tox long, clean long")
                     .groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")), size["tox"], size["n"] - size["tox"])
    found = found.toArrow()  # at most the terms of max_toxic texts
    if not found.num_rows:
        return None
    term, chi = found["term"].to_numpy().view(np.uint64), found["chi"].to_numpy()
    order = np.argsort(term)
    vocabulary, chi = Vocabulary(term), chi[order]
    small = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        v = small.value
        total = np.zeros(len(v.hashes), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, off in slices(batch.column(0)):
                total += np.bincount(_counted(*v.slots(*terms(data, off)), len(v.hashes))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows, total[at]])], names=["slot", "n"])

    counts = text.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(len(vocabulary.hashes) + 1)
    n[counts["slot"].to_numpy()] = counts["n"].to_numpy()  # the number of documents comes last
    idf = (np.log((n[-1] + 1) / n[:-1]) + 1e-3) * chi / (chi + HALF)

    def vectors(batches):
        v = small.value
        for batch in batches:
            ids, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, data, off in slices(batch.column(0)):
                row, slot, n = _counted(*v.slots(*terms(data, off)), len(v.hashes))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pylist([
                    {"id": ids[lo + i], "y": y[lo + i], "slot": slot[edge[i]:edge[i + 1]].astype(np.int32).tobytes(),
                     "n": n[edge[i]:edge[i + 1]].astype(np.int32).tobytes()} for i in range(hi - lo)],
                    schema=pa.schema([("id", pa.int64()), ("y", pa.int32()), ("slot", pa.binary()), ("n", pa.binary())]))

    rows = labelled.select("text", "id", "y").mapInArrow(vectors, "id long, y int, slot binary, n binary").toArrow()
    columns = [rows["id"].to_pylist(), rows["y"].to_pylist(), rows["slot"], rows["n"]]
    rows = {i: (i, y, np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(k.as_buffer(), np.int32)) for i, y, s, k in zip(*columns)}
    rows = sorted(rows.values(), key=lambda r: r[0])
    small.destroy()
    del found, counts, columns
    give_back()
    return build(vocabulary, idf, rows, totals, max_examples)


def fit_held_out(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learnt from the labels whose id digest is not 1 modulo 3."""
    return fit(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))


def _singled(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The terms (term, chi) of toxic texts that lean to a label more than chance, or that no clean text has."""
    nt, nc, a, b = F.lit(max(toxic, 1.0)), F.lit(max(clean, 1.0)), F.col("tox"), F.col("clean")
    top = F.pow(a * (nc - b) - b * (nt - a), F.lit(2.0)) * (nt + nc)
    chi = top / F.greatest(nt * nc * (a + b) * (nt + nc - a - b), F.lit(1e-9))
    return counts.withColumn("chi", chi).filter((a > 0) & ((F.col("chi") >= CHANCE) | (b == 0))).select("term", "chi")


def build(vocabulary: Vocabulary, idf: np.ndarray, rows: list, totals: dict, max_examples: int) -> Model | None:
    """Index the examples and calibrate on all rows, an example without itself."""
    rng = np.random.default_rng(11)
    full = [i for i in rng.permutation(len(rows)) if len(rows[i][2])]
    examples = []
    for label in (1, 0):
        own = [i for i in full if rows[i][1] == label]
        examples += own[:min(max_examples, max(1, len(own) * 3 // 4))]
    if not examples:
        return None
    main = {i: int(rows[i][2][np.argmax(idf[rows[i][2]])]) for i in examples}
    examples.sort(key=lambda i: (rows[i][1], main[i], i))  # like beside like: tight block bounds
    blocks = max(2, -(-len(examples) // BLOCK))
    none = np.zeros(0)
    model = Model(vocabulary, idf, none, none, none, none, none, none, np.zeros(blocks * BLOCK), none, none, none, 0.0)
    model.labels[:len(examples)] = [rows[i][1] for i in examples]
    term = np.concatenate([rows[i][2] for i in examples]).astype(np.int64)
    example = np.repeat(np.arange(len(examples)), [len(rows[i][2]) for i in examples])
    weight = np.concatenate([model.vector(rows[i][2], rows[i][3]) for i in examples]).astype(np.float32)
    order = np.lexsort((example, term))
    term, model.example, model.weight = term[order], example[order].astype(np.int32), weight[order]
    block = model.example // BLOCK
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    model.run_at, model.run_block = np.r_[first, len(term)], block[first]
    model.run_max = np.maximum.reduceat(model.weight, first)
    model.runs = np.searchsorted(term[first], np.arange(len(idf) + 1))
    model.ids = np.array([rows[i][0] for i in examples], np.int64)
    place = {i: k for k, i in enumerate(examples)}
    votes = [(model.vote(rows[i][2], rows[i][3], place.get(i, -1))[0], rows[i][1]) for i in range(len(rows))]
    # examples are balanced; weights give each label its share among all labelled rows
    seen = {y: max(1, sum(v[1] == y for v in votes)) for y in (0, 1)}
    share = {y: totals.get(y, 0) / seen[y] for y in (0, 1)}
    with_vote = [(v, y) for v, y in votes if v is not None]
    if with_vote:
        x, y = np.array([v for v, _ in with_vote]), np.array([float(y) for _, y in with_vote])
        model.steps, model.values = isotonic(x, y, np.array([share[int(k)] for k in y]))
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    none = [y for v, y in votes if v is None]
    mass = sum(share[y] for y in none)
    model.alone = sum(share[y] for y in none if y) / mass if mass else min(0.5, totals.get(1, 0) / max(1, sum(totals.values())))
    return model


def score(df: DataFrame, text_col: str, model: Model | None, prefix: str = "", keep_text: bool = False) -> DataFrame:
    """``df`` with score, evidence (ids of the nearest examples) and similarity, their names after ``prefix``.

    The text goes to Python once and comes back, as first column, only with
    ``keep_text``; rows come back in pieces of SLICE_BYTES of text.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    by_name = {f.name: f for f in df.schema.fields}
    others = [f for f in df.schema.fields if f.name != text_col]
    keep = ([by_name[text_col]] if keep_text else []) + others
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    first = 0 if keep_text else 1

    def run(batches):
        keep_only()
        m = shared.value
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(0)):
                size = hi - lo
                out, near, sims = np.zeros(size), [None] * size, [None] * size
                if m is not None:
                    row, slot, n = _counted(*m.vocabulary.slots(*terms(data, off)), len(m.vocabulary.hashes))
                    edge = np.searchsorted(row, np.arange(size + 1))
                    for i in range(size):
                        vote, at, sim = m.vote(slot[edge[i]:edge[i + 1]], n[edge[i]:edge[i + 1]])
                        out[i], near[i], sims[i] = m.score(vote), m.ids[at].tolist(), sim.astype(float).tolist()
                rows = batch.slice(lo, size)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(first, batch.num_columns)]
                    + [pa.array(out), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))],
                    names=[f.name for f in keep] + [prefix + x for x in ("score", "evidence", "similarity")])

    return df.select(F.col(f"`{text_col}`"), *[F.col(f"`{f.name}`") for f in others]).mapInArrow(
        run, ddl + f"{prefix}score double, {prefix}evidence array<long>, {prefix}similarity array<double>")
