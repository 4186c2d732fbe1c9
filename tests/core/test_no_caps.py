"""Layers and rounds go on until the target or a fixed point."""

from blockspark.operators import sampling
from blockspark.plans.sbp import SbpConfig, split_sides

EDGES = "src long, dst long, w double"


def path(spark, n):
    return spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], EDGES).coalesce(1), spark.range(n).withColumnRenamed("id", "v").coalesce(1)


def test_snowball_reaches_its_target_among_isolated_vertices(spark):
    e, v = spark.createDataFrame([], EDGES), spark.range(1000).withColumnRenamed("id", "v")
    out = [r["v"] for r in sampling.snowball(e, v, 0.5).collect()]
    assert len(out) == len(set(out)) == 500


def test_extend_passes_a_block_along_a_long_path(spark):
    e, v = path(spark, 56)
    out = {r["v"]: r["b"] for r in sampling.extend(e, v.where("v = 0").selectExpr("v", "7L as b"), v, 2).collect()}
    assert out == {i: 7 for i in range(56)}


def test_sides_of_a_long_path_are_connected(spark):
    e, v = path(spark, 60)
    sides = split_sides(e, v.selectExpr("v", "0L as b"), SbpConfig(proposals=1), "q")
    side = {r["v"]: r["side"] for r in sides.collect()}
    assert len(side) == 60 and sum(side[i] != side[i + 1] for i in range(59)) <= 2
