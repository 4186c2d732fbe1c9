"""Tasks of joins and sums hold a bounded number of rows, whatever the number of shuffle partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockspark.fixtures import Tables
from blockspark.operators import graph, profile

DATA = "/root/testdata/sf0.001"


def most_rows(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("table", ["g_pp", "g_cs"])
def test_tables_of_edges_lie_in_small_parts(spark, monkeypatch, table):
    before = getattr(Tables(spark, DATA), table)()
    monkeypatch.setattr(graph, "TASK_ROWS", 300)
    after = getattr(Tables(spark, DATA), table)()
    assert most_rows(after) < 4 * 300 and sorted(after.collect()) == sorted(before.collect())


def test_islands_join_each_end_once(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)] * 50 + [(2, 3, 1.0)] * 50, "src long, dst long, w double")
    left = graph.islands(edges, spark.range(6).withColumnRenamed("id", "v"))
    assert sorted(r["v"] for r in left.collect()) == [0, 4, 5]
    assert "Aggregate" in left._jdf.queryExecution().optimizedPlan().toString()


def test_degrees_at_both_ends_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 40)
    rng = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (300, 2)).tolist() if a != b})
    frame = spark.createDataFrame(pairs, "u long, v long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    x = np.array([(len(near[a]), len(near[b])) for a, b in pairs] + [(len(near[b]), len(near[a])) for a, b in pairs], float)
    assert profile.assortativity(frame).first()[0] == pytest.approx(np.corrcoef(x.T)[0, 1], abs=1e-9)
    assert {r["v"]: r["knn"] for r in profile.knn(frame).collect()} == pytest.approx({v: np.mean([len(near[n]) for n in ns]) for v, ns in near.items()})


def test_links_are_joined_in_tasks_before_any_round(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOREST_LINKS", 400, raising=False)
    rng = np.random.default_rng(8)
    links = [(int(a) * 10**11, int(b) * 10**11) for a, b in rng.integers(0, 120, (900, 2))] + [(k, k + 1) for k in range(300)] * 2
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    sizes, cut = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: sizes.append(cut(df)) or sizes[-1])
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, w double")
    got = {r["v"]: r["component"] for r in graph.connected_components(edges, graph.vertex_set(edges)).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert sizes[0].count() < 0.8 * len({(min(x), max(x)) for x in links if x[0] != x[1]})


def test_few_rows_take_few_ranges(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "64")
    ranked = graph.global_rank(wide.range(100).withColumnRenamed("id", "v"), [F.asc("v")])
    parts = graph.range_parts(wide.range(100).withColumnRenamed("id", "v"), [F.asc("v")], F.lit(1))
    assert [r["rank"] for r in ranked.orderBy("v").collect()] == list(range(1, 101))
    assert parts.select("_part").distinct().count() < 16
