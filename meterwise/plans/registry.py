"""Registry of named queries and of their SQL oracles.

Every query takes ``(spark, sf_dir)``, reads the driver tables (through the
fixture views) and returns a DataFrame.  Its output is normalised the same
way as the oracle's: integers as BIGINT, floating values as DOUBLE rounded
to 6 digits, so an order-insensitive hash of both results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, ShortType)

ROUND_DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
            cols.append(c.cast("bigint").alias(f.name))
        elif isinstance(t, (FloatType, DoubleType, DecimalType)):
            cols.append(F.round(c.cast("double"), ROUND_DIGITS).alias(f.name))
        elif isinstance(t, BooleanType):
            cols.append(c.cast("int").cast("bigint").alias(f.name))
        else:
            cols.append(c.alias(f.name))
    return df.select(*cols)


def norm_sql(inner: str, columns: str) -> str:
    """Wrap an oracle query with the same normalisation as :func:`normalize`.

    ``columns`` is "name:kind, ..." with kind i (integer), f (float),
    s (string), d (date) or b (boolean → 0/1).
    """
    out = []
    for item in columns.split(","):
        name, kind = (x.strip() for x in item.rsplit(":", 1))
        q = f'"{name}"'
        if kind == "i":
            out.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "f":
            out.append(f"round(CAST({q} AS DOUBLE), {ROUND_DIGITS}) AS {q}")
        elif kind == "b":
            out.append(f"CAST(CAST({q} AS INTEGER) AS BIGINT) AS {q}")
        else:
            out.append(q)
    return f"SELECT {', '.join(out)} FROM (\n{inner}\n) AS q"


def register(name: str, oracle: str | None = None):
    """Decorator: register a query (and optionally its oracle SQL)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
