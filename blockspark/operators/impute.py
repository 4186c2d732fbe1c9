"""The most frequent value in place of a missing one, as a stage of a pipeline that can be saved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _ModeParams(HasInputCols, HasOutputCols):
    modes = Param(Params._dummy(), "modes", "the value for each input column", typeConverter=TypeConverters.toListString)


class ModeImputer(Estimator, _ModeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Text columns; ties go to the least value, and a column without any value gets an empty text."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        names = self.getInputCols()
        # one pass: a row a value of each column
        long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("value")) for k, c in enumerate(names)])).alias("x")).where("x.value is not null")
        counts = long.groupBy("x.k", "x.value").agg(F.count("*").alias("n"))
        best = {r["k"]: r["value"] for r in counts.groupBy("k").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")).collect()}  # a row a column
        out = ModeImputerModel()
        out._set(inputCols=names, outputCols=self.getOutputCols(), modes=[best.get(k, "") for k in range(len(names))])
        return out


class ModeImputerModel(Model, _ModeParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        filled = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("modes"), strict=True)
        return df.withColumns({to: F.coalesce(F.col(c).cast("string"), F.lit(mode)) for c, to, mode in filled})
