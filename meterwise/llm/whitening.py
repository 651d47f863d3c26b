"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Every entry c becomes the integer x = floor(scale * c) + shift.  Tasks add up
outer products exactly (float64 products while they are exact integers, Python
integers beyond), Spark sums them, and M = n * sum(x x') - S S' is n squared
times the covariance, without rounding.

Polynomial.  det(tI - M) modulo a prime comes from Hessenberg reduction; one
Spark row for each prime, as many primes as the largest coefficient needs
(Maclaurin's bound from the trace), joined by Chinese remaindering.

Roots.  All roots are real, so by Descartes' rule the sign changes of the
polynomial shifted to a count the roots above a exactly, with multiplicity:
bisection on integers isolates the largest roots, and goes on (by the sign of
the polynomial for a simple root) until they are known to BITS bits.

Components.  For each root (or group of roots that agree to BITS bits) one
Spark row: inverse iteration on M - root * I in DIGITS decimal digits finds its
null space, which is made orthonormal before it is rounded to double.

The driver holds numbers of the dimension only: d(d + 1)/2 sums, d + 1
coefficients, at most ``most`` components.

Defined cases: vectors that are null or hold null or non-finite entries take no
part, nor do vectors of another length than the most frequent one (the longest
of equally frequent ones); entries beyond the range of a long stay at its end;
null and repeated ids keep their own rows.  Components with eigenvalue 0 have
no whitened value and are left out, so an empty table, or equal vectors only,
give no rows.  ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, ship

SCALE, SHIFT, MOST = 64, 1_000_000, 32
BITS, DIGITS, STEPS = 110, 60, 4
LIMB = 48
EXACT = 1 << 53


# --- integers of the vectors


def integers(values: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """x of every entry; int64, or Python integers if a product of two could leave 2**53."""
    with np.errstate(over="ignore"):
        f = np.floor(values.astype(np.float64) * scale)
    if not len(f) or np.abs(f).max() < 1 << 26:
        return f.astype(np.int64) + shift
    low, high = -(1 << 63), (1 << 63) - 1
    flat = [(high if v > 0 else low) if math.isinf(v) else min(max(int(v) + shift, low), high) for v in f.ravel().tolist()]
    return np.array(flat, object).reshape(f.shape)


def products(x: np.ndarray) -> np.ndarray:
    """x'x without rounding, as Python integers."""
    if x.dtype == object:
        return x.T @ x
    top = max(1, int(np.abs(x).max(initial=0)))
    rows = max(1, EXACT // (top * top))
    f = x.astype(np.float64)
    total = np.zeros((x.shape[1],) * 2, object)
    for lo in range(0, len(f), rows):
        total += (f[lo:lo + rows].T @ f[lo:lo + rows]).astype(np.int64).astype(object)
    return total


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, d)


def _limbs(value: int):
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


def scatter(vectors: DataFrame, d: int, scale: int, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, sum of outer products) of x - shift, exact."""
    def run(batches):
        n, s, m = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(_matrix(batch, 0, d), scale, shift) - shift
            n, s, m = n + len(x), s + x.sum(axis=0).astype(object), m + products(x)
        rows = [(-1, -1, n)] + [(-1, i, s[i]) for i in range(d)] + [(i, j, m[i, j]) for i in range(d) for j in range(i, d)]
        rows = [(i, j, k, v) for i, j, total in rows for k, v in _limbs(int(total))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["i", "j", "k", "v"])

    sums = (vectors.select("vec").mapInArrow(run, "i long, j long, k long, v long")
            .groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    n, s, m = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in sums:
        value = int(r.v) << (LIMB * r.k) if r.v >= 0 else -(-int(r.v) << (LIMB * r.k))
        if r.i >= 0:
            m[r.i][r.j] += value
            m[r.j][r.i] = m[r.i][r.j]
        elif r.j >= 0:
            s[r.j] += value
        else:
            n += value
    return n, s, m


# --- the characteristic polynomial


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 2**31
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: float) -> list[int]:
    """Primes below 2**31 whose product has more than ``bits`` bits."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (lowest first) of det(tI - m) modulo p, by Hessenberg reduction."""
    h, d = m % p, len(m)
    for c in range(1, d - 1):
        at = np.flatnonzero(h[c:, c - 1])
        if not len(at):
            continue
        i = c + int(at[0])
        if i != c:
            h[[c, i]] = h[[i, c]]
            h[:, [c, i]] = h[:, [i, c]]
        u = h[c + 1:, c - 1] * pow(int(h[c, c - 1]), -1, p) % p
        h[c + 1:] = (h[c + 1:] - u[:, None] * h[c][None, :] % p) % p
        h[:, c] = (h[:, c] + (h[:, c + 1:] * u[None, :] % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = poly[k - 1, :-1]
        weights, t = np.zeros(k, np.int64), 1
        for i in range(k):  # weights of the earlier polynomials, from the last one down
            weights[k - 1 - i] = t * int(h[k - 1 - i, k - 1]) % p
            if i < k - 1:
                t = t * int(h[k - 1 - i, k - 2 - i]) % p
        poly[k] = (new - (weights[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d]


def characteristic(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients, lowest first, of det(tI - m) for a positive semidefinite m; a Spark row for each prime."""
    d = len(m)
    mean = max(1, -(-sum(m[i][i] for i in range(d)) // d))
    ps = primes(max(math.log2(math.comb(d, k)) + k * math.log2(mean) for k in range(d + 1)) + 2)
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            got = []
            for p in batch.column(0).to_pylist():
                residues = np.array([[x % p for x in row] for row in shared.value], np.int64)
                got.append(polynomial_mod(residues, p).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(ps), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in ps], "p long").repartition(tasks, "p").mapInArrow(run, "p long, c array<long>").collect()
    whole = math.prod(ps)
    total = [0] * (d + 1)
    for r in rows:
        rest = whole // r.p
        unit = rest * pow(rest % r.p, -1, r.p)
        total = [(a + c * unit) % whole for a, c in zip(total, r.c)]
    return [x - whole if 2 * x > whole else x for x in total]


# --- real roots


def above(c: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are above the integer a (with multiplicity)."""
    c = list(c)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _finer(c: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of c."""
    d = len(c) - 1
    return [x << (bits * (d - k)) for k, x in enumerate(c)]


def _value(c: list[int], a: int) -> int:
    out = 0
    for x in reversed(c):
        out = out * a + x
    return out


def largest_roots(c: list[int], most: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """The positive roots, largest first, as (numerator, binary exponent, multiplicity), relative error 2**-bits.

    Roots that agree to that precision count as one of their number.
    """
    while c and c[0] == 0:
        c = c[1:]  # the root 0
    if len(c) < 2:
        return []
    top = 1 << max(0, int(-c[-2]).bit_length())  # above the sum of the roots
    out, found = [], 0
    # (low, high, roots above low, roots above high, exponent): roots in (low, high] / 2**exponent
    todo = [(0, top, above(c, 0), 0, 0)]
    scaled = {0: c}
    while todo and found < most:
        low, high, more, less, e = todo.pop()
        if more == less:
            continue
        if e not in scaled:
            scaled[e] = _finer(c, e)
        if low and (high - low) << bits <= low:
            out.append((low + high, e + 1, more - less))
            found += more - less
            continue
        if more - less == 1 and low:
            low, high, e = _simple(c, low, high, e, bits)
            todo.append((low, high, more, less, e))
            continue
        if high - low == 1:
            step = 8
            low, high, e = low << step, high << step, e + step
            if e not in scaled:
                scaled[e] = _finer(c, e)
        mid = (low + high) // 2
        here = above(scaled[e], mid)
        todo.append((low, mid, more, here, e))
        todo.append((mid, high, here, less, e))
    return out


def _simple(c: list[int], low: int, high: int, e: int, bits: int) -> tuple[int, int, int]:
    """Bisect the one root in (low, high] by the sign of the polynomial."""
    more = max(0, bits + 2 - (low.bit_length() - 1))
    low, high, e = low << more, high << more, e + more
    c = _finer(c, e)
    at_high = _value(c, high)
    if at_high == 0:
        return high - 1, high, e
    while (high - low) << bits > low:
        mid = (low + high) // 2
        v = _value(c, mid)
        if v == 0:
            return mid - 1, mid, e
        if (v > 0) == (at_high > 0):
            high = mid
        else:
            low = mid
    return low, high, e


# --- null spaces


def null_space(m: list[list[int]], root: Decimal, size: int) -> list[list[float]]:
    """``size`` orthonormal vectors of the null space of m - root * I, by inverse iteration."""
    with localcontext(Context(prec=DIGITS, Emax=10 ** 9, Emin=-10 ** 9)):
        d = len(m)
        a = np.array([[Decimal(x) for x in row] for row in m], object)
        for i in range(d):
            a[i, i] -= root
        tiny = root * Decimal(10) ** (5 - DIGITS)
        order = np.arange(d)
        for k in range(d):
            i = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, i]], order[[k, i]] = a[[i, k]], order[[i, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1:, k] /= a[k, k]
            a[k + 1:, k + 1:] -= a[k + 1:, k][:, None] * a[k, k + 1:][None, :]
        rng = np.random.default_rng(5)
        basis = [np.array([Decimal(int(x)) for x in rng.integers(-1000, 1000, d)], object) for _ in range(size)]
        for _ in range(STEPS):
            done = []
            for v in basis:
                v = v[order]
                for k in range(d):
                    v[k + 1:] -= a[k + 1:, k] * v[k]
                for k in range(d - 1, -1, -1):
                    v[k] /= a[k, k]
                    v[:k] -= a[:k, k] * v[k]
                v = v / max(np.abs(v))
                for _ in (0, 1):
                    for w in done:
                        v = v - w * (w * v).sum()
                    v = v / (v * v).sum().sqrt()
                done.append(v)
            basis = done
        return [[float(x) for x in v] for v in basis]


@dataclass
class Whitener:
    """Fitted on n vectors: n times the means (``sums``), components, and the eigenvalues of n squared times the covariance."""
    n: int
    sums: list[int]
    values: list[float]         # square roots of those eigenvalues
    explained: list[float]
    components: list[list[float]]
    scale: int
    shift: int

    def apply(self, vectors: np.ndarray) -> tuple[list, np.ndarray]:
        """(deviation, whitened) of the rows."""
        z = integers(vectors, self.scale, self.shift)
        top = int(np.abs(z).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top * top * max(1, z.shape[1]) >= 1 << 63:
            z = z.astype(object)
        z = z * self.n - np.array(self.sums, z.dtype)
        squares = (z * z).sum(axis=1).tolist()
        white = z.astype(np.float64) @ (np.array(self.components) / np.array(self.values)[:, None]).T
        return [s if s < 1 << 63 else None for s in squares], white


def valid(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, and their dimension."""
    ship(df.sparkSession)
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0))
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.filter(F.size("vec") == size.d), size.d) if size else (rows, 0)


def fit(vectors: DataFrame, d: int, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> Whitener | None:
    """Learn from all rows (id, vec)."""
    spark = vectors.sparkSession
    n, s, outer = scatter(vectors, d, scale, shift)
    m = [[n * outer[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return None
    roots = largest_roots(characteristic(spark, m), most)
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            out = []
            for at, num, exp, size in rows:
                with localcontext(Context(prec=DIGITS + 20, Emax=10 ** 9, Emin=-10 ** 9)):
                    root = Decimal(num) / Decimal(2) ** exp
                out += [(at, v) for v in null_space(shared.value, root, size)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.float64()))],
                                             names=["at", "v"])

    jobs = spark.createDataFrame([(i, str(num), e, k) for i, (num, e, k) in enumerate(roots)], "at int, num string, exp int, size int")
    tasks = min(len(roots), spark.sparkContext.defaultParallelism)
    found = jobs.repartition(tasks, "at").mapInArrow(run, "at int, v array<double>").collect()
    vectors_of: dict[int, list] = {}
    for r in found:
        vectors_of.setdefault(r["at"], []).append(r["v"])
    values, explained, components = [], [], []
    for i, (num, e, _) in enumerate(roots):
        with localcontext(Context(prec=DIGITS, Emax=10 ** 9, Emin=-10 ** 9)):
            root = Decimal(num) / Decimal(2) ** e
            value, share = float(root.sqrt()), float(root / Decimal(trace))
        for v in sorted(vectors_of[i]):
            values.append(value)
            explained.append(share)
            components.append(v)
    sums = [x + n * shift for x in s]
    return Whitener(n, sums, values[:most], explained[:most], components[:most], scale, shift)


def identity_error(vectors: DataFrame, d: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    spark, k = vectors.sparkSession, len(w.values)
    shared = spark.sparkContext.broadcast(w)

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = shared.value.apply(_matrix(batch, 0, d))[1]
            one, two = one + x.sum(axis=0), two + x.T @ x
        rows = [(-1, i, one[i]) for i in range(k)] + [(i, j, two[i, j]) for i in range(k) for j in range(i, k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([float(r[2]) for r in rows])],
                                         names=["i", "j", "v"])

    sums = {(r.i, r.j): r.v / w.n for r in vectors.select("vec").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    # whitened values are centred already; what their mean is off by rounding is taken out too
    return max(abs(sums[i, j] - sums[-1, i] * sums[-1, j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(df: DataFrame, id_col: str, vec_col: str, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error for every row and component."""
    spark = df.sparkSession
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = valid(df, id_col, vec_col)
    w = fit(rows, d, most, scale, shift) if d else None
    if w is None or not w.values:
        return spark.createDataFrame([], schema)
    error, k = identity_error(rows, d, w), len(w.values)
    shared = spark.sparkContext.broadcast(w)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                size = part.num_rows
                deviation, white = m.apply(_matrix(part, 0, d))
                at = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n)),
                     pa.array(deviation, pa.int64()).take(at), pa.array(white.ravel()), pa.array(np.tile(m.explained, size)), pa.array(np.full(size * k, error))],
                    names=[f.split()[0] for f in schema.split(", ")])

    return rows.select("vec", "id").mapInArrow(run, schema)


def save(w: Whitener, spark, name: str = "whitener") -> DataFrame:
    """The components as a table in the shared folder: component, value, explained, vector."""
    rows = [(i + 1, v, e, c) for i, (v, e, c) in enumerate(zip(w.values, w.explained, w.components))]
    return cut(spark.createDataFrame(rows, "component int, value double, explained double, vector array<double>"), name)
