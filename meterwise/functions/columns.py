"""Column expressions shared by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed date format of the invoice files.
INVOICE_DATE_FORMAT = "yyyy-MM-dd"
# Formats tried, in order, for the creation date (written without a format in
# the source data; the first one that parses wins).
CREATION_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")

# Fixed unit factors of the frequency features.
DAYS_PER_MONTH = 30.44
DAYS_PER_YEAR = 365.25
# Fixed smoothing constant added to the denominator of the '/' combination.
DIVISION_SMOOTHING = 0.1


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den``, NULL when ``den`` is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def non_blank(c) -> Column:
    """True when the value is not NULL and holds a non-white-space character.

    Equivalent to ``str(x).strip() != ''`` for a non-null value.
    """
    x = col_of(c)
    return x.isNotNull() & x.rlike(r"\S")


def parse_date(c, formats=(INVOICE_DATE_FORMAT,)) -> Column:
    """Parse a string (or pass a date through); unparsable → NULL."""
    x = col_of(c)
    parsed = [F.try_to_date(x.cast("string"), fmt) for fmt in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def ensure_date(df, name: str, formats=(INVOICE_DATE_FORMAT,)):
    """Return ``df`` with column ``name`` as DATE (strings parsed, bad → NULL)."""
    dtype = dict(df.dtypes).get(name)
    if dtype == "date":
        return df
    if dtype == "timestamp":
        return df.withColumn(name, F.to_date(name))
    return df.withColumn(name, parse_date(name, formats))


def mode_smallest(value, count) -> Column:
    """Aggregate: the value with the largest count, smallest value on ties.

    Works on pre-aggregated (value, count) rows, so the state of each group
    is one struct, not a map of all values.
    """
    v = col_of(value)
    return F.max_by(v, F.struct(col_of(count), -v))


# Fixed coefficients of the asymptotic series of the digamma function
# ψ(y) ≈ ln y − 1/(2y) − Σ B_2k / (2k y^2k), Bernoulli numbers B_2 … B_12.
_DIGAMMA_SERIES = [(2, 1 / 12), (4, -1 / 120), (6, 1 / 252), (8, -1 / 240), (10, 1 / 132), (12, -691 / 32760)]
_DIGAMMA_SHIFT = 10


def digamma(x) -> Column:
    """ψ(x) for x ≥ 1 as a Spark expression: recurrence
    ψ(x) = ψ(x + 10) − Σ_{i<10} 1/(x+i), then the asymptotic series at
    y = x + 10 ≥ 11 (error below 1e-14)."""
    x = col_of(x).cast("double")
    y = x + F.lit(float(_DIGAMMA_SHIFT))
    series = F.log(y) - 1.0 / (2.0 * y)
    for power, coef in _DIGAMMA_SERIES:
        series = series - F.lit(coef) / F.pow(y, float(power))
    rec = sum((1.0 / (x + F.lit(float(i))) for i in range(_DIGAMMA_SHIFT)), F.lit(0.0))
    return series - rec


def digamma_py(x: float) -> float:
    """Python twin of :func:`digamma` for driver-side constants and tests."""
    acc = 0.0
    for i in range(_DIGAMMA_SHIFT):
        acc -= 1.0 / (x + i)
    y = x + _DIGAMMA_SHIFT
    out = math.log(y) - 1 / (2 * y)
    for power, coef in _DIGAMMA_SERIES:
        out -= coef / y ** power
    return acc + out


def scalar_of(one_row_df, column: str):
    """A column of a one-row aggregate as a scalar subquery (no join).

    Catalyst merges several scalar subqueries over the same aggregate into
    one, so each one-row statistic is computed once.
    """
    return one_row_df.select(column).scalar()
