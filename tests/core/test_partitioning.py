"""The search: all ways to hold the state give the same moves, merges and result; planted partitions are found."""

from dataclasses import replace

import numpy as np
import pytest

from blockspark.operators import blockmodel as bm
from blockspark.operators import quality, synth
from blockspark.plans import sbp
from blockspark.plans.cells import Cells

EDGES = "src long, dst long, w double"


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(5)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 18, (70, 2))}
    rows = [(a, b, float(rng.integers(1, 4))) for a, b in sorted(e)]
    return spark.createDataFrame(rows, EDGES), spark.range(20).withColumnRenamed("id", "v")  # 18 and 19 have no edge


def ways(cfg):
    return [cfg, replace(cfg, broadcast_vertices=0), replace(cfg, broadcast_vertices=0, model_cells=0)]


def scored(edges, assign, cfg):
    g = sbp.Graph.of(edges, assign, cfg)
    got = sbp.score_moves(g, sbp.start_state(g, assign, cfg), cfg, "q", 3)
    rows = got.to_pylist() if hasattr(got, "to_pylist") else [r.asDict() for r in got.collect()]
    return {r["v"]: (r["was"], r["to"], round(r["delta"], 7), round(r["correction"], 7), r["x3"]) for r in rows}


@pytest.mark.parametrize("parametric", [False, True])
def test_moves_are_scored_alike(spark, graph, parametric):
    e, v = graph
    a = v.selectExpr("v", "v % 4 as b")
    one, two, three = (scored(e, a, c) for c in ways(sbp.SbpConfig(algorithm="async", parametric=parametric)))
    assert one == two == three and len(one) > 8
    assert ({r[3] for r in one.values()} != {1.0}) == parametric
    start = bm.mdl(e, a, parametric).first()["mdl"]
    for m, (_, to, delta, _, _) in list(one.items())[:3]:
        after = bm.mdl(e, a.selectExpr("v", f"case when v = {m} then {to}L else b end as b"), parametric).first()["mdl"]
        assert after - start == pytest.approx(delta, abs=1e-6)


def test_merges_are_alike(spark, graph):
    e, v = graph
    a = v.selectExpr("v", "v as b")
    one, three = ({r["v"]: r["b"] for r in sbp.merge_phase(e, a, 12, c, "m").collect()} for c in ways(sbp.SbpConfig())[::2])
    assert one == three and set(one.values()) == set(range(12))


def test_exact_merges_reach_their_target(spark, graph):
    e, v = graph
    got = sbp.merge_phase(e, v.selectExpr("v", "v as b"), 12, sbp.SbpConfig(exact_merges=True), "m")
    assert {r["b"] for r in got.collect()} == set(range(12))


def test_a_search_is_the_same_whatever_is_held(spark, graph):
    e, v = graph
    cfg = sbp.SbpConfig(max_sweeps=1, max_rounds=2, proposals=2, batches=1, algorithm="async")
    results = [sbp.bottom_up(e, v, c) for c in ways(cfg)[:2]]
    one, two = ({r["v"]: r["b"] for r in x.assign.collect()} for x in results)
    assert one == two
    assert bm.mdl(e, results[0].assign).first()["mdl"] == pytest.approx(results[0].mdl)


def test_merging_in_order_passes_over_cycles(spark):
    best = spark.createDataFrame([(0, 1, -3.0), (1, 2, -2.0), (2, 0, -1.0), (3, 0, -5.0), (4, 5, 1.0), (5, 4, 1.0)], "a long, b long, delta double")
    assert {r["a"] for r in sbp.forest(best, 6).collect()} == {0, 1, 3, 4}
    rows = sorted(best.collect(), key=lambda r: (r["delta"], r["a"]))
    assert sbp._roots_in_order(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]), 3, 6).tolist() == [0, 0, 0, 0, 4, 5]


def test_cells_hold_the_length(spark, graph):
    e, v = graph
    a = v.selectExpr("v", "v % 4 as b")
    got = bm.block_matrix(e, a).toPandas()
    for parametric in (False, True):
        c = Cells(got["r"].to_numpy(), got["s"].to_numpy(), got["m"].to_numpy(), np.full(4, 5), parametric)
        assert c.mdl() == pytest.approx(bm.mdl(e, a, parametric).first()["mdl"])


@pytest.mark.parametrize("split, seeds", [("random", "random"), ("connectivity", "degree_weighted"), ("snowball", "high_degree"), ("single_snowball", "random")])
def test_sides_cover_each_block_once(spark, graph, split, seeds):
    e, v = graph
    a = v.selectExpr("v", "v % 2 as b")
    got = sbp.split_sides(e, a, sbp.SbpConfig(split=split, seeds=seeds, proposals=2), "s").collect()
    assert len(got) == len({(r["trial"], r["v"]) for r in got}) == 40
    assert all({r["side"] for r in got if r["trial"] == t and r["b"] == b} == {0, 1} for t in (1, 2) for b in (0, 1))
    if split == "single_snowball":
        assert all(1 <= sum(r["side"] == 0 for r in got if r["trial"] == t and r["b"] == b) <= 8 for t in (1, 2) for b in (0, 1))


@pytest.mark.parametrize("run, seed", [(sbp.bottom_up, 1), (sbp.top_down, 2), (sbp.top_down, 3)])
def test_planted_partitions_are_found(spark, run, seed):
    e, truth = synth.planted(spark, synth.community_sizes(400, 4), 4000, 0.05, seed=seed)
    found = run(e, truth.select("v"))
    assert quality.agreement(found.assign, truth).first()["f1"] >= 0.95
    assert found.mdl < bm.mdl_null(e, truth).first()["mdl"]
