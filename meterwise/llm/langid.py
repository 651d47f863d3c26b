"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte n-grams of the lower-cased text (other bytes than
letters read as blanks), hashed into 2**BITS buckets.  A text's vector is the
mean of its subwords' embeddings; a linear softmax gives the language.  Both
are trained by stochastic gradient descent in numpy on a bounded sample: of
each language the ``rows_per_lang`` labelled rows with the smallest digests of
id and text (the languages themselves are taken to be few).  A
fifth of the sample is kept aside to calibrate: one temperature for the scores
and, for the ``rejected`` column, the score from which predictions reach the
wanted precision.  For prediction the product of embeddings and softmax is
folded into one table of buckets x languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; if nothing can be learnt (no labelled row) every text is
``und``; repeated rows keep their own result and are learnt from once, texts
of one id or one text in two languages are rows of their own; texts of any
length count whole (a text's vector is a mean); other columns are kept under
their names, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import LOWER, slices
from ._tables import cut, text_key

BITS, ORDERS, DIM, EPOCHS, RATE, SEED = 16, (2, 3, 4), 16, 12, 0.5, 7
ROWS_PER_LANG, RANGE_BITS = 1500, 10
PRECISION = 0.995
_NORM = LOWER.copy()
_NORM[[c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]] = 0x20


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray   # (buckets + 1, languages); the last row is zero
    bias: np.ndarray
    temperature: float
    accept: float


def _buckets(data: np.ndarray, off: np.ndarray):
    """For each n-gram order the bucket at every byte; 2**BITS where the n-gram would leave its text."""
    d = _NORM[data].astype(np.uint32)
    gram, ends = d, off[1:]
    for n in range(2, max(ORDERS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | d[n - 1:] if len(gram) > 1 else gram[:0]
        if n not in ORDERS:
            continue
        out = np.full(len(d), 1 << BITS, np.uint32)
        out[:len(gram)] = ((gram + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        tail = (ends[:, None] - np.arange(1, n)[None, :]).ravel()
        out[tail[tail >= 0]] = 1 << BITS
        yield n, out


def _collect(batches):
    """Sparse subword counts of the sampled texts."""
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, hi, data, off in slices(batch.column(0)):
            parts = [b for _, b in _buckets(data, off)]
            rows = []
            for i in range(hi - lo):
                x = np.concatenate([b[off[i]:off[i + 1]] for b in parts])
                idx, n = np.unique(x[x < 1 << BITS], return_counts=True)
                rows.append({"lang": lang[lo + i], "idx": idx.astype(np.int32).tobytes(), "n": n.astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("idx", pa.binary()), ("n", pa.binary())]))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """examples: (language, buckets, counts)."""
    examples = [x for x in examples if len(x[1])]
    langs = sorted({x[0] for x in examples})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    y = np.array([langs.index(x[0]) for x in examples])
    order = rng.permutation(len(examples))
    fifth = -(-len(order) // 5)
    aside, learn = order[:fifth], order[fifth:] if len(order) > 1 else order
    emb = rng.normal(0, 1 / DIM, ((1 << BITS) + 1, DIM))
    emb[-1] = 0
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    weights = [n / n.sum() for _, _, n in examples]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            idx, w = examples[i][1], weights[i]
            h = w @ emb[idx]
            g = _softmax(h @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= rate * 0.05 * g
            emb[idx] -= (rate * min(len(idx), 50)) * w[:, None] * back[None, :]
    table = (emb @ out).astype(np.float32)
    logits = np.array([weights[i] @ table[examples[i][1]] + bias for i in aside])

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(aside)), y[aside]], 1e-12)).mean()

    temperature = min(np.geomspace(0.05, 10, 60), key=loss)
    p = _softmax(logits / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[aside]
    at = np.argsort(-best, kind="stable")
    precise = np.cumsum(right[at]) / np.arange(1, len(at) + 1) >= PRECISION
    accept = float(best[at][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(langs, table, bias, float(temperature), accept)


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(h, lang) of the ``most`` smallest digests of each language: ranks inside digest ranges plus the counts of the ranges before."""
    named = rows.groupBy("lang", "h").agg(F.lit(1).alias("one")).withColumn("rng", F.shiftright("h", 64 - RANGE_BITS))
    sums = named.groupBy("lang", "rng").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("rng")) - F.col("n")  # at most 2**RANGE_BITS rows a language
    used = sums.withColumn("before", before).filter(F.col("before") < most).select("lang", "rng", "before")
    place = F.col("before") + F.row_number().over(Window.partitionBy("lang", "rng").orderBy("h"))
    return named.join(used, ["lang", "rng"]).withColumn("place", place).filter(F.col("place") <= most).select("lang", "h")


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """Train on at most ``rows_per_lang`` different labelled texts of each language among the rows where ``learn`` holds."""
    rows = (df.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                    F.xxhash64(F.col(id_col), text_key(F.col(text_col)), F.col(lang_col)).alias("h")))
    chosen = cut(_sample(rows, rows_per_lang), "language-sample")  # at most rows_per_lang rows a language
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = sample.select("text", "lang").mapInArrow(_collect, "lang string, idx binary, n binary").collect()
    found = sorted(found, key=lambda r: (r.lang, bytes(r.idx), bytes(r.n)))
    return train([(r.lang, np.frombuffer(r.idx, np.int32), np.frombuffer(r.n, np.int32)) for r in found])


def predict(df: DataFrame, text_col: str, model: Model | None) -> DataFrame:
    """``df`` with lang_pred, score and rejected."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [f for f in df.schema.fields if f.name != text_col]
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches):
        m = shared.value
        for batch in batches:
            spoken = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if m is not None:
                for lo, hi, data, off in slices(batch.column(0)):
                    total, size = np.zeros((hi - lo, len(m.langs))), np.zeros(hi - lo)
                    full = np.flatnonzero(np.diff(off) > 0)
                    for order, b in _buckets(data, off):
                        if len(full):
                            total[full] += np.add.reduceat(m.table[b], off[full], axis=0, dtype=np.float64)
                        size += np.maximum(0, np.diff(off) - order + 1)
                    p = _softmax((total / np.maximum(size, 1)[:, None] + m.bias) / m.temperature)
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            known = spoken & (m is not None)
            names = np.array(m.langs if m is not None else ["und"], object)
            cols = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.where(known, names[best], "und"), pa.string()), pa.array(np.where(known, score, 0.0)),
                        pa.array(~known | (score < (m.accept if m else 1)))],
                names=[f.name for f in keep] + ["lang_pred", "score", "rejected"])

    return df.select(F.col(text_col), letter.alias("_letter"), *[F.col(f"`{f.name}`") for f in keep]).mapInArrow(
        run, (ddl + ", " if ddl else "") + "lang_pred string, score double, rejected boolean")
