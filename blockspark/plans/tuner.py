"""Train, save, load, evaluate and recommend: the tuner's drivers around a bundle.

A bundle is a folder: the fitted pipeline, the split of graphs, the training priors, and last a manifest that names the features with
their kinds, the settings, and a fingerprint of all that.  A folder without a manifest is none; one whose manifest and fingerprint
differ, or whose features the data don't have, is an error.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as ml
from ..operators import tuning as tu
from ..operators.graph import checkpoint

VERSION = 1
LEAST_GRAPHS = 10
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
REQUIRED = ("version", "numeric", "categorical", "alphas", "weights", "seed", "random_repeats")
METHODS = ("model", "accuracy prior", "performance prior", "random")


@dataclass
class Bundle:
    model: PipelineModel
    split: DataFrame  # (graph, part)
    priors: DataFrame  # (kind, config, wins, prior_rank)
    manifest: dict

    @property
    def numeric(self) -> list[str]:
        return self.manifest["numeric"]


def fingerprint(manifest: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "fingerprint"}, sort_keys=True).encode()).hexdigest()


def features_in(df: DataFrame, manifest: dict) -> None:
    """An error if df lacks a feature, or has a text where a number is wanted."""
    kinds = dict(df.dtypes)
    missing = [c for c in [*manifest["numeric"], *manifest["categorical"]] if c not in kinds]
    if missing:
        raise ValueError(f"missing model inputs: {missing[:5]}")
    texts = [c for c in manifest["numeric"] if kinds[c] in ("string", "binary", "boolean")]
    if texts:
        raise ValueError(f"not numbers: {texts[:5]}")


def train(averaged: DataFrame, numeric: list[str], categorical: list[str] = (), alphas: tuple[float, ...] = ALPHAS, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3), shares: tuple[float, float, float] = (0.6, 0.1, 0.3), seed: int = 7, random_repeats: int = 100, **settings) -> tuple[Bundle, DataFrame, DataFrame]:
    """(bundle, the validation graphs' regression metrics, their ranking metrics by alpha).

    averaged: a row for each (graph, config) with inverse_hnorm, modularity, conductance, teps and the features, of which alpha is always
    one.  Graphs are split, at least ten.  settings go to the regressor, whose defaults are those of production.
    """
    if min(shares) <= 0 or abs(sum(shares) - 1) > 1e-9:
        raise ValueError(f"shares over 0 that add up to 1, not {shares}")
    averaged = checkpoint(averaged)
    split = checkpoint(tu.split_graphs(averaged, shares, seed))
    if split.count() < LEAST_GRAPHS:
        raise ValueError(f"at least {LEAST_GRAPHS} graphs are needed")
    numeric = [*dict.fromkeys([*numeric, "alpha"])]
    manifest = {"version": VERSION, "numeric": numeric, "categorical": list(categorical), "alphas": list(alphas), "weights": list(weights), "seed": seed, "random_repeats": random_repeats}
    of = lambda part: averaged.join(split.where(F.col("part") == part).select("graph"), "graph", "left_semi")
    data = checkpoint(tu.utility(of("train"), list(alphas), tuple(weights)))
    features_in(data, manifest)
    fitted = ml.train(data, numeric, list(categorical), seed=seed, **settings)
    manifest["fingerprint"] = fingerprint(manifest)
    bundle = Bundle(fitted, split, checkpoint(tu.priors(of("train"), tuple(weights))), manifest)
    seen = checkpoint(_predicted(bundle, of("validation"), list(alphas)))
    return bundle, tu.regression_metrics(seen, "utility", "prediction"), tu.by_alpha(tu.evaluate(tu.ranked(seen, "prediction")))


def _predicted(bundle: Bundle, averaged: DataFrame, alphas: list[float]) -> DataFrame:
    data = tu.utility(averaged, alphas, tuple(bundle.manifest["weights"]))
    features_in(data, bundle.manifest)
    return ml.predict(bundle.model, data, bundle.numeric).select(*data.columns, "prediction")


def save(bundle: Bundle, path: str) -> None:
    """The manifest comes last, so a folder that has one is complete."""
    spark = bundle.split.sparkSession
    bundle.model.write().overwrite().save(f"{path}/model")
    bundle.split.write.mode("overwrite").parquet(f"{path}/split")
    bundle.priors.write.mode("overwrite").parquet(f"{path}/priors")
    spark.createDataFrame([(json.dumps(bundle.manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Bundle:
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))  # one line
    missing = [k for k in (*REQUIRED, "fingerprint") if k not in manifest]
    if missing:
        raise ValueError(f"the bundle lacks {missing}")
    if manifest["version"] != VERSION:
        raise ValueError(f"a bundle of version {manifest['version']}; {VERSION} is read")
    if manifest["fingerprint"] != fingerprint(manifest):
        raise ValueError("the manifest isn't the one that was saved with the model")
    return Bundle(PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/split"), spark.read.parquet(f"{path}/priors"), manifest)


def _by_prior(data: DataFrame, priors: DataFrame, kind: str) -> DataFrame:
    """data with ``rank`` by one kind of prior; a configuration that the training graphs don't have is an error."""
    known = priors.where(F.col("kind") == kind).select("config", "prior_rank")
    unknown = F.raise_error(F.concat(F.lit("no prior rank of configuration "), F.col("config").cast("string"))).cast("int")
    x = data.join(known, "config", "left").withColumn("prior_rank", F.coalesce("prior_rank", unknown))
    return tu.ranked(x.withColumn("score", -F.col("prior_rank")), "score").drop("score", "prior_rank")


def evaluate(bundle: Bundle, averaged: DataFrame, part: str | None = "test", alphas: list[float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by method and alpha, selections, regression metrics) of the model, both priors and random orders.

    On the graphs of a part of the bundle's split, or all where part is None.  A part that the data has no graph of is an error.
    """
    alphas = alphas or bundle.manifest["alphas"]
    if part is not None:
        averaged = averaged.join(bundle.split.where(F.col("part") == part).select("graph"), "graph", "left_semi")
    data = checkpoint(_predicted(bundle, averaged, alphas))
    if data.isEmpty():
        raise ValueError(f"no graph of part {part}")
    rows = {"model": tu.ranked(data, "prediction")} | {f"{k} prior": _by_prior(data, bundle.priors, k) for k in ("accuracy", "performance")}
    marked = lambda df, name: df.withColumn("method", F.lit(name))
    single = {k: checkpoint(tu.evaluate(x)) for k, x in rows.items()}
    table = marked(tu.random_baseline(data, bundle.manifest["random_repeats"], bundle.manifest["seed"]), "random")
    chosen = None
    for name, x in single.items():
        table = table.unionByName(marked(tu.by_alpha(x), name))
        own = marked(x.select("graph", "alpha", "selected", "best"), name)
        chosen = own if chosen is None else chosen.unionByName(own)
    return table, chosen, tu.regression_metrics(data, "utility", "prediction")


def recommend(bundle: Bundle, graphs: DataFrame, configurations: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """(graph, alpha, config, prediction, rank) of graphs(graph, ...) with every configuration(config, ...); rank 1 is the winner."""
    x = tu.recommend_inputs(graphs, configurations, alphas or bundle.manifest["alphas"])
    features_in(x, bundle.manifest)
    return tu.ranked(ml.predict(bundle.model, x, bundle.numeric), "prediction").select("graph", "alpha", "config", "prediction", "rank")
