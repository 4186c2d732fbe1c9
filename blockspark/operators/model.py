"""The utility regressor: preprocessing, boosted trees, recommendation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impute import ModeImputer
from .tuning import ranked, recommend_inputs, regression_metrics


def with_missing_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric})


def pipeline(numeric: list[str], categorical: list[str], label: str = "utility", trees: int = 600, depth: int = 6, rate: float = 0.04, subsample: float = 0.9, columns: str = "0.9", seed: int = 7) -> Pipeline:
    """Median imputation with missing flags and scaling; most frequent category, one-hot, unknown ones kept apart; boosted trees."""
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__filled" for c in numeric]), VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="numbers"), StandardScaler(withMean=True, inputCol="numbers", outputCol="scaled")]
    parts = ["scaled", *[f"{c}__missing" for c in numeric]]
    if categorical:
        named = [f"{c}__named" for c in categorical]
        stages += [ModeImputer(inputCols=categorical, outputCols=named), StringIndexer(inputCols=named, outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical])]
        parts += [f"{c}__hot" for c in categorical]
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns, seed=seed)]
    return Pipeline(stages=stages)


def train(df: DataFrame, numeric: list[str], categorical: list[str], **settings) -> PipelineModel:
    return pipeline(numeric, categorical, **settings).fit(with_missing_flags(df, numeric))


def predict(model: PipelineModel, df: DataFrame, numeric: list[str]) -> DataFrame:
    return model.transform(with_missing_flags(df, numeric))


def validate(model: PipelineModel, df: DataFrame, numeric: list[str], label: str = "utility") -> DataFrame:
    return regression_metrics(predict(model, df, numeric), label, "prediction")


def recommend(model: PipelineModel, graphs: DataFrame, conf: DataFrame, alphas: list[float], numeric: list[str]) -> DataFrame:
    """Each graph's and alpha's configurations by predicted utility."""
    return ranked(predict(model, recommend_inputs(graphs, conf, alphas), numeric), "prediction").select("graph", "alpha", "config", "prediction", "rank")
