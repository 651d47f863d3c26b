"""Projections, null handling, recoding and feature combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.columns import DIVISION_SMOOTHING

BASE_COLUMNS = ["client_id", "disrict", "region", "client_catg"]

# Fixed label codes of the meter type.
COUNTER_TYPE_CODES = {"ELEC": 0, "GAZ": 1}

# Fixed feature combinations (name, left feature, operator, right feature).
COMBINATIONS = [
    ("f_combi1", "avg_remarque_length", "*", "f_counter_number_nunique"),
    ("f_combi2", "remarque_frequency", "*", "f_tarif_change_count"),
    ("f_combi3", "f_total_consumption_std", "/", "f_counter_statue_error_occured"),
    ("f_combi4", "f_region_std_deviation_consumption_level_3", "*", "f_index_diff_mean"),
    ("f_combi5", "f_counter_number_nunique", "*", "remarque_frequency"),
    ("f_combi6", "f_counter_statue_error_occured", "*", "remarque_frequency"),
    ("f_combi7", "f_index_diff_mean", "*", "remarque_frequency"),
]


def base_columns(client: DataFrame, with_target: bool | None = None) -> DataFrame:
    """client_id, [target], disrict, region, client_catg."""
    cols = list(BASE_COLUMNS)
    if with_target is None:
        with_target = "target" in client.columns
    if with_target:
        cols.insert(1, "target")
    missing = [c for c in cols if c not in client.columns]
    if missing:
        raise KeyError(f"the client table lacks {missing}")
    return client.select(*cols)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop id / target / date / chosen columns (absent names ignored)."""
    return df.drop(*names)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    """Keep the numeric columns, in order."""
    return df.select(*numeric_columns(df))


def select_features(df: DataFrame, names: list[str], keep=("client_id", "target")) -> DataFrame:
    """Keep id / target (when present) and the named features."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"features not found: {missing}")
    front = [k for k in keep if k in df.columns and k not in names]
    return df.select(*front, *names)


def fill_zero(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P5: NULL → 0 in all numeric columns (NaN too)."""
    cols = subset or numeric_columns(df)
    return df.fillna(0, subset=cols).fillna(0.0, subset=cols)


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """NULL → given constant per column."""
    return df.fillna(values)


def impute_mean(train: DataFrame, *others: DataFrame, columns: list[str]):
    """Fill NULL with the training mean; the same means fill the other
    frames.  Fitting is one aggregate row (one number per column, as Spark
    ML's Imputer); applying it is a projection."""
    means = train.agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns]).first()

    def fill(df):
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[f"__mean_{c}"]).cast("double"))
                               for c in columns})

    filled = [fill(train)] + [fill(o) for o in others]
    return filled[0] if not others else tuple(filled)


def combine_features(df: DataFrame, feature1: str, feature2: str, operation: str, name: str) -> DataFrame:
    """New column from two features, appended last.

    '/' divides by (feature2 + 0.1); a zero denominator gives NULL.
    """
    return _with_combinations(df, [(name, feature1, operation, feature2)])


# arithmetic of P11 by symbol, on two double columns
_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b + F.lit(DIVISION_SMOOTHING)),
}


def _with_combinations(df: DataFrame, specs) -> DataFrame:
    """All combined columns (name, left, symbol, right) in one projection, appended in order."""
    unknown = sorted({s for _, _, s, _ in specs} - set(_ARITHMETIC))
    absent = sorted({c for _, a, _, b in specs for c in (a, b)} - set(df.columns))
    if unknown or absent:
        raise ValueError(f"cannot combine: unknown symbols {unknown}, absent columns {absent}")
    made = [_ARITHMETIC[s](F.col(a).cast("double"), F.col(b).cast("double")).alias(n) for n, a, s, b in specs]
    names = {n for n, *_ in specs}
    return df.select(*[c for c in df.columns if c not in names], *made)


def add_combinations(df: DataFrame) -> DataFrame:
    """The seven fixed combinations, in one projection."""
    return _with_combinations(df, COMBINATIONS)


def encode_counter_type(df: DataFrame, column: str = "counter_type") -> DataFrame:
    """ELEC → 0, GAZ → 1, anything else → NULL."""
    mapping = F.create_map(*[x for k, v in COUNTER_TYPE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(column, F.element_at(mapping, F.col(column)))


def cast_categoricals(df: DataFrame, columns=("client_catg", "disrict")) -> DataFrame:
    """Cast to int (ANSI cast: a bad value raises, as the reference)."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("int"))
    return df


def log_transform(df: DataFrame, columns: list[str], prefix: str = "log_") -> DataFrame:
    """Natural log of each column (≤ 0 → NULL), source dropped."""
    for c in columns:
        df = df.withColumn(f"{prefix}{c}", F.ln(F.col(c).cast("double"))).drop(c)
    return df


def apply_threshold(df: DataFrame, threshold: float, score: str = "score",
                    name: str = "prediction") -> DataFrame:
    """label = score ≥ threshold."""
    return df.withColumn(name, (F.col(score) >= F.lit(threshold)).cast("int"))


def null_to_zero_features(df: DataFrame, exclude=("client_id", "target")) -> DataFrame:
    """Model input preparation: every feature column as double, NULL → 0."""
    cols = [c for c in df.columns if c not in exclude]
    return df.select(*[c for c in exclude if c in df.columns],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
