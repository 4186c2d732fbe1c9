"""The auction against augmenting paths; weights against closed forms; draws and graphs against what was asked for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockspark.operators import generate, quality
from blockspark.operators.matching import best_matching


def cells_frame(spark, table):
    rows = [(int(p), int(t), int(n)) for (p, t), n in np.ndenumerate(table) if n]
    return spark.createDataFrame(rows, "p long, t long, n long")


@pytest.mark.parametrize("shape, density, top, seed", [((5, 5), 0.9, 3, 1), ((3, 6), 0.7, 9, 3)])
def test_the_auction_equals_augmenting_paths(spark, shape, density, top, seed):
    rng = np.random.default_rng(seed)
    table = np.where(rng.random(shape) < density, rng.integers(1, top + 1, shape), 0)
    size = max(shape)
    cost = np.zeros((size, size))
    cost[: shape[0], : shape[1]] = -table
    got = best_matching(cells_frame(spark, table)).collect()
    assert len({r["p"] for r in got}) == len({r["t"] for r in got}) == len(got)
    assert all(table[r["p"], r["t"]] == r["n"] for r in got)
    assert sum(r["n"] for r in got) == -quality.assignment_cost(cost)


def test_accuracy_is_the_same_both_ways(spark):
    rng = np.random.default_rng(7)
    truth = rng.integers(0, 4, 60)
    found = np.where(rng.random(60) < 0.8, (truth * 3 + 1) % 4, rng.integers(0, 4, 60))
    a = spark.createDataFrame([(v, f"x{b}") for v, b in enumerate(found.tolist())], "v long, b string")
    b = spark.createDataFrame([(v, b) for v, b in enumerate(truth.tolist())], "v long, b long")
    one, two = (quality.matching_accuracy(a, b, n).first()["accuracy"] for n in (1024, 0))
    assert one == pytest.approx(two) and 0.6 < one < 1


def test_blocks_that_match_alone_need_no_auction(spark):
    v = spark.range(6000)
    a, b = v.selectExpr("id as v", "id div 4 as b"), v.selectExpr("id as v", "1499 - id div 4 as b")
    assert quality.matching_accuracy(a, b).first()["accuracy"] == 1.0  # 1500 blocks a side
    assert quality.matching_accuracy(a.limit(0), b, 0).first()["accuracy"] is None


def normal(q):
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < q else (lo, mid)
    return lo


def test_weights_follow_their_distributions(spark):
    v = spark.range(40_000).withColumnRenamed("id", "v")
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    of = lambda mode, **more: np.quantile([r["weight"] for r in generate.vertex_weights(v, mode, 3, **more).collect()], q)
    assert np.allclose(of("uniform"), 1)
    assert np.allclose(np.log(of("lognormal", sigma=0.8)), [0.8 * normal(x) for x in q], atol=0.03)
    assert np.allclose(of("powerlaw", alpha=2.0), [(1 - x) ** -0.5 for x in q], rtol=0.03)
    bimodal = [r["weight"] for r in generate.vertex_weights(v, "bimodal", 3, share=0.2, weight=7.0).collect()]
    assert bimodal.count(7.0) == 8000 and bimodal.count(1.0) == 32_000
    for mode in generate.MODES:
        assert generate.parameters(mode, 5) == generate.parameters(mode, 5)
    assert 0.5 <= generate.parameters("lognormal", 5)["sigma"] <= 1.5
    with pytest.raises(ValueError):
        generate.parameters("other", 1)


def test_draws_take_the_vertex_whose_stretch_holds_the_point(spark):
    rng = np.random.default_rng(8)
    weights = [(f"g{k % 3}", k, float(rng.integers(0, 6))) for k in range(200)] + [("hub", 900, 1000.0), ("hub", 901, 1.0), ("none", 950, 0.0)]
    draws = [(i, f"g{i % 3}" if i % 4 else "hub", float(rng.random())) for i in range(4000)] + [(5000, "none", 0.5), (5001, "absent", 0.1), (5002, "g0", 0.0), (5003, "hub", 0.9999999)]
    got = generate.draw(spark.createDataFrame(weights, "group string, v long, weight double").repartition(3), spark.createDataFrame(draws, "i long, group string, u double").repartition(5))
    assert got.columns == ["i", "group", "u", "v"]
    found = {r["i"]: r["v"] for r in got.collect()}
    for i, g, u in draws:
        own = sorted((v, w) for h, v, w in weights if h == g and w > 0)
        want, run = None, 0.0
        for v, w in own:
            if run <= u * sum(x for _, x in own) < run + w:
                want = v
            run += w
        assert found[i] == want
    assert len(found) == len(draws)


@pytest.mark.parametrize("mode, pairs, mu", [("powerlaw", "neutral", 0.2), ("lognormal", "negative", 0.4)])
def test_graphs_have_the_edges_and_the_mixing_asked_for(spark, mode, pairs, mu):
    e, v = generate.community_graph(spark, [60, 40, 50], 900, mu, mode, pairs, seed=4)
    rows = [(r["src"], r["dst"]) for r in e.collect()]
    at = {r["v"]: (r["b"], r["weight"]) for r in v.collect()}
    assert len(rows) == len(set(rows)) == 900 and all(a < b for a, b in rows)
    assert abs(np.mean([at[a][0] != at[b][0] for a, b in rows]) - mu) <= 0.01
    half = {}
    for c in range(3):
        own = sorted((w, x) for x, (b, w) in at.items() if b == c)
        half |= {x: k >= len(own) // 2 for k, (_, x) in enumerate(own)}
    inside = [(a, b) for a, b in rows if at[a][0] == at[b][0]]
    if pairs == "negative":
        assert all(half[a] != half[b] for a, b in inside)
    degree = np.bincount(np.array(rows).ravel(), minlength=150)
    heavy = sorted(at, key=lambda x: -at[x][1])
    assert degree[heavy[:30]].mean() > 1.5 * degree[heavy[-30:]].mean()


def test_dense_graphs_are_filled_from_any_pair(spark):
    v = spark.createDataFrame([(k, k % 2, 1.0) for k in range(10)], "v long, b long, weight double")
    e = generate.community_edges(v, 43, 0.1, seed=2)  # 20 pairs inside, 25 between, 45 in all
    rows = {(r["src"], r["dst"]) for r in e.collect()}
    assert len(rows) == e.count() == 43
    with pytest.raises(ValueError):
        generate.community_edges(v, 46, 0.1)
    assert generate.community_edges(v.withColumn("b", F.lit(1)), 12, 0.5, "positive").count() == 12
