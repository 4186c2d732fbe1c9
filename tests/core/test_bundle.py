"""Train, save, load, evaluate, recommend; what doesn't fit the bundle is an error."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from blockspark.operators.impute import ModeImputer
from blockspark.operators.model import with_missing_flags
from blockspark.plans import tuner

SCHEMA = "graph string, config int, size double, kind string, inverse_hnorm double, modularity double, conductance double, teps double"


@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(14):
        size = float(rng.integers(1, 9))
        for c in range(5):
            q = 0.2 + 0.1 * c + 0.01 * rng.random()
            rows.append((f"g{g:02}", c, None if (g, c) == (3, 1) else size, [None, "fast", "slow"][(c + (g == 5)) % 3], q, q / 2, 1 - q, size * (6 - c)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def trained(measured):
    return tuner.train(measured, ["size", "config"], ["kind"], (0.0, 0.5, 1.0), random_repeats=3, trees=8, depth=3, rate=0.3)


def test_a_bundle_makes_the_round_trip(spark, measured, trained, tmp_path):
    bundle, regression, by_alpha = trained
    assert set(regression.columns) == {"rmse", "mae", "r2"} and {r["alpha"] for r in by_alpha.collect()} == {0.0, 0.5, 1.0}
    counts = {r["part"]: r["count"] for r in bundle.split.groupBy("part").count().collect()}
    assert counts == {"train": 8, "validation": 1, "test": 5}
    path = str(tmp_path / "bundle")
    tuner.save(bundle, path)
    again = tuner.load(spark, path)
    assert again.manifest == bundle.manifest and isinstance(again.model, PipelineModel)
    assert sorted(map(tuple, again.priors.collect())) == sorted(map(tuple, bundle.priors.collect()))
    graphs = spark.createDataFrame([("new1", 3.0), ("new2", None)], "graph string, size double")
    conf = spark.createDataFrame([(c, [None, "fast", "slow", "unseen"][c % 4]) for c in range(5)], "config int, kind string")
    one, two = (sorted(map(tuple, tuner.recommend(b, graphs, conf).collect())) for b in (bundle, again))
    assert one == two and len(one) == 2 * 5 * 3
    best = {(g, a): c for g, a, c, _, rank in one if rank == 1}
    assert best["new1", 1.0] == 4 and best["new1", 0.0] == 0  # quality rises and speed falls with the configuration

    table, chosen, regression = tuner.evaluate(again, measured)
    rows = table.collect()
    assert {(r["method"], r["alpha"]) for r in rows} == {(m, a) for m in tuner.METHODS for a in (0.0, 0.5, 1.0)}
    exact = {(r["method"], r["alpha"]): r for r in rows}
    assert exact["model", 1.0]["top_1"] == 1.0 and exact["accuracy prior", 1.0]["top_1"] == 1.0 and exact["performance prior", 0.0]["top_1"] == 1.0
    assert exact["performance prior", 1.0]["top_1"] == 0.0 and exact["model", 1.0]["pairs"] == 5
    assert chosen.count() == 3 * 5 * 3 and regression.first()["r2"] > 0.5


def test_what_does_not_fit_is_an_error(spark, measured, trained, tmp_path):
    bundle = trained[0]
    path = tmp_path / "bundle"
    tuner.save(bundle, str(path))

    def rewrite(**change):
        manifest = {k: v for k, v in (bundle.manifest | change).items() if v is not None}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(str(path / "manifest"))

    for change, match in (({"numeric": ["size"]}, "manifest"), ({"version": 2}, "version 2"), ({"alphas": None}, "lacks")):
        rewrite(**change)
        with pytest.raises(ValueError, match=match):
            tuner.load(spark, str(path))
    with pytest.raises(ValueError, match="missing model inputs"):
        tuner.evaluate(bundle, measured.drop("size"))
    with pytest.raises(ValueError, match="not numbers"):
        tuner.evaluate(bundle, measured.withColumn("size", F.lit("large")))
    with pytest.raises(ValueError, match="no graph"):
        tuner.evaluate(bundle, measured.withColumn("graph", F.concat(F.lit("other"), "graph")))
    with pytest.raises(ValueError, match="10 graphs"):
        tuner.train(measured.where("graph < 'g09'"), ["size"])
    with pytest.raises(ValueError, match="add up"):
        tuner.train(measured, ["size"], shares=(0.5, 0.1, 0.1))
    with pytest.raises(Exception, match="no prior rank"):
        tuner._by_prior(measured.withColumn("alpha", F.lit(0.5)).withColumn("config", F.col("config") + 50), bundle.priors, "accuracy").collect()


def test_the_most_frequent_value_is_filled_in(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 1.0), ("a", None, None), ("b", None, 2.0), ("a", None, 3.0), (None, None, 4.0)], "x string, y string, z double")
    fitted = Pipeline(stages=[ModeImputer(inputCols=["x", "y"], outputCols=["fx", "fy"])]).fit(df)
    fitted.write().save(str(tmp_path / "p"))
    got = PipelineModel.load(str(tmp_path / "p")).transform(df).collect()
    assert [r["fx"] for r in got] == ["b", "a", "b", "a", "a"] and {r["fy"] for r in got} == {""}
    assert [r["z__missing"] for r in with_missing_flags(df, ["z"]).collect()] == [0.0, 1.0, 0.0, 0.0, 0.0]
