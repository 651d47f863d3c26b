"""Model pipelines that can be saved whole and score another file later.

The preparation steps of the feature tables as Spark ML stages: they keep what
they learn (means, rates) in the saved folder, so a loaded pipeline needs
nothing but the file to score.
"""

from __future__ import annotations

import json
import posixpath

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling as R
from .joins import merge_on

from .projections import _with_combinations, add_combinations

#: samplers that a saved estimator can name
SAMPLERS = {
    "random_oversample": lambda df, seed: R.random_oversample(df, seed=seed).drop("copy"),
    "random_oversample_drawn": lambda df, seed: R.random_oversample_drawn(df, seed=seed).drop("copy"),
    "none": lambda df, seed: df,
}


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters as attributes' JSON-able values."""

    def _given(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class NullFill(Transformer, _Stage):
    """Nulls of the columns (as double) become a value."""

    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)
    value = Param(Params._dummy(), "value", "the value", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns=None, value=None):
        super().__init__()
        self._setDefault(value=0.0)
        self._given(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        value = F.lit(self.getOrDefault(self.value))
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), value) for c in self.getOrDefault(self.columns)})


class DropColumns(Transformer, _Stage):
    """Without the columns; absent ones are ignored."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.columns))


class Combinations(Transformer, _Stage):
    """Combined columns [name, left, symbol, right]; the fixed seven where none are given."""

    specs = Param(Params._dummy(), "specs", "JSON list of [name, left, symbol, right]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, specs=None):
        super().__init__()
        if specs is not None:
            self._set(specs=specs if isinstance(specs, str) else json.dumps(specs))

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.isSet(self.specs):
            return add_combinations(df)
        return _with_combinations(df, [tuple(x) for x in json.loads(self.getOrDefault(self.specs))])


class _Learnt(Params):
    columns = Param(Params._dummy(), "columns", "columns", TypeConverters.toListString)


class MeanFill(Estimator, _Learnt, _Stage):
    """Learns the columns' means; its model puts them in place of nulls."""

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> MeanFillModel:
        columns = self.getOrDefault(self.columns)
        row = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return MeanFillModel(columns=columns, values=[float("nan") if v is None else float(v) for v in row])


class MeanFillModel(Model, _Learnt, _Stage):
    values = Param(Params._dummy(), "values", "means of the columns; NaN leaves nulls", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, values=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.columns), self.getOrDefault(self.values))
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) for c, v in pairs if v == v})


class Standardizer(Estimator, _Learnt, _Stage):
    """Learns mean and population deviation of the columns (L1)."""

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> StandardizerModel:
        columns = self.getOrDefault(self.columns)
        row = df.agg(*[F.avg(f"`{c}`") for c in columns], *[F.stddev_pop(f"`{c}`") for c in columns]).first()
        n = len(columns)
        return StandardizerModel(columns=columns, means=[float(v or 0) for v in row[:n]], deviations=[float(v or 0) for v in row[n:]])


class StandardizerModel(Model, _Learnt, _Stage):
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviations; 0 makes the column 0", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, means=None, deviations=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        of = zip(self.getOrDefault(self.columns), self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return df.withColumns({c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for c, m, s in of})


class RateTransfer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns (key, rate) pairs of the training table; its model attaches them to other tables."""

    pairs = Param(Params._dummy(), "pairs", "JSON list of [key, rate column]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, pairs=None):
        super().__init__()
        if pairs is not None:
            self._set(pairs=pairs if isinstance(pairs, str) else json.dumps(pairs))

    def _fit(self, df: DataFrame) -> RateTransferModel:
        pairs = [tuple(p) for p in json.loads(self.getOrDefault(self.pairs))]
        return RateTransferModel({rate: (key, df.select(key, rate).distinct()) for key, rate in pairs})


class RateTransferModel(Model, MLReadable, MLWritable):
    """Holds a table of distinct (key, rate) for each rate; saved as Parquet beside the metadata."""

    def __init__(self, rates: dict[str, tuple[str, DataFrame]]):
        super().__init__()
        self.rates = rates

    def _transform(self, df: DataFrame) -> DataFrame:
        for rate, (key, table) in self.rates.items():
            df = merge_on(df, table, key, rate)
        return df

    def write(self) -> MLWriter:
        return _RateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RateReader(cls)


class _RateWriter(MLWriter):
    def __init__(self, model: RateTransferModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        order = [[rate, key] for rate, (key, _) in self.model.rates.items()]
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"rates": order})
        for i, (_, table) in enumerate(self.model.rates.values()):
            table.write.mode("overwrite").parquet(posixpath.join(path, "rates", str(i)))


class _RateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> RateTransferModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark, self.cls.__module__ + "." + self.cls.__name__)
        model = self.cls({rate: (key, spark.read.parquet(posixpath.join(path, "rates", str(i)))) for i, (rate, key) in enumerate(meta["rates"])})
        model._resetUid(meta["uid"])
        return model


class Resampled(Estimator, MLReadable, MLWritable):
    """L7, writable: re-sample by a named sampler, then fit the inner estimator; the fitted model only scores."""

    sampler = Param(Params._dummy(), "sampler", "a name in SAMPLERS", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    def __init__(self, inner, sampler: str = "none", seed: int = 42):
        super().__init__()
        if sampler not in SAMPLERS:
            raise ValueError(f"unknown sampler {sampler!r}, known: {sorted(SAMPLERS)}")
        self.inner = inner
        self._set(sampler=sampler, seed=seed)

    def _fit(self, df: DataFrame):
        return self.inner.fit(SAMPLERS[self.getOrDefault(self.sampler)](df, self.getOrDefault(self.seed)))

    def copy(self, extra=None):
        return Resampled(self.inner.copy(extra), self.getOrDefault(self.sampler), self.getOrDefault(self.seed))

    def write(self) -> MLWriter:
        return _ResampledWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ResampledReader(cls)


class _ResampledWriter(MLWriter):
    def __init__(self, estimator: Resampled):
        super().__init__()
        self.estimator = estimator

    def saveImpl(self, path: str) -> None:
        inner = self.estimator.inner
        kind = [type(inner).__module__, type(inner).__name__]
        DefaultParamsWriter.saveMetadata(self.estimator, path, self.sparkSession, extraMetadata={"inner": kind})
        inner.write().overwrite().save(posixpath.join(path, "inner"))


class _ResampledReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Resampled:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession, self.cls.__module__ + "." + self.cls.__name__)
        inner = DefaultParamsReader.loadParamsInstance(posixpath.join(path, "inner"), self.sparkSession)
        params = meta["paramMap"]
        out = self.cls(inner, params["sampler"], params["seed"])
        out._resetUid(meta["uid"])
        return out
