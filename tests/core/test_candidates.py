"""Metrics of many graphs at once equal those of each graph alone; triangles are the same however lists travel."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockspark.operators import adjacency, candidates, graph, profile


@pytest.fixture(scope="module")
def graphs():
    rng = np.random.default_rng(9)
    edges, vertices = [], []
    for name, n, m in (("a", 14, 30), ("b", 9, 9), ("none", 5, 0), ("full", 6, 400)):
        vertices += [(name, k, k % 3) for k in range(n)]
        edges += [(name, int(x), int(y)) for x, y in rng.integers(0, n, (m, 2))]
    return [*edges, ("a", 3, 3), ("a", 99, 1)], vertices


def test_many_graphs_equal_each_alone(spark, graphs):
    edges, vertices = graphs
    got = candidates.graph_metrics(spark.createDataFrame(edges, "graph string, src long, dst long"), spark.createDataFrame(vertices, "graph string, v long, b long")).collect()
    assert sorted(r["graph"] for r in got) == ["a", "b", "full", "none"]
    for r in (r.asDict() for r in got):
        own = [v for g, v, _ in vertices if g == r["graph"]]
        pairs = sorted({(min(a, b), max(a, b)) for g, a, b in edges if g == r["graph"] and a != b and a in own and b in own})
        assert (r["num_nodes"], r["num_edges"], r["num_communities"]) == (len(own), len(pairs), 3)
        if not pairs:
            assert all(x == 0 for k, x in r.items() if k not in ("graph", "num_nodes", "num_communities"))
            continue
        frame, vs = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(v,) for v in own], "v long")
        one = profile.moments(frame, vs).first().asDict()
        for mine, its in (("avg_degree", "degree_avg"), ("degree_std",) * 2, ("degree_min",) * 2, ("degree_max",) * 2, ("avg_clustering", "clustering_avg"), ("clustering_std",) * 2, ("density",) * 2, *((f"{k}_p{p}",) * 2 for k in ("degree", "clustering") for p in (25, 50, 75))):
            assert r[mine] == pytest.approx(one[its]), mine
        assert r["assortativity"] == pytest.approx(profile.assortativity(frame).first()[0], abs=1e-9)
        assert r["actual_mu"] == pytest.approx(np.mean([a % 3 != b % 3 for a, b in pairs]))
        edges_of = frame.select(F.col("u").alias("src"), F.col("v").alias("dst"))
        assert r["largest_cc_fraction"] == pytest.approx(profile.largest_component(edges_of, vs).first()["fraction"])


def test_triangles_by_lists(spark, graphs):
    edges, _ = graphs
    pairs = sorted({(min(a, b), max(a, b)) for _, a, b in edges if a != b})
    near = {frozenset(p) for p in pairs}
    names = sorted({x for p in pairs for x in p})
    want = {t for t in combinations(names, 3) if all(frozenset(p) in near for p in combinations(t, 2))}
    frame = graph.checkpoint(spark.createDataFrame(pairs, "u long, v long"))
    assert sorted(tuple(sorted(r)) for r in graph.triangles(frame).collect()) == sorted(want)
    for most in (1 << 22, 0):
        rows = graph.closed_pairs(frame, most).collect()
        assert sorted(tuple(sorted((r["a"], r["b"], c))) for r in rows for c in r["third"]) == sorted(want)
    counts = {r["v"]: r["triangles"] for r in graph.triangle_counts(frame).collect()}
    assert counts == {v: n for v in names if (n := sum(v in t for t in want))}


def test_quantiles_between_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3, k, float(rng.integers(0, 9))) for k in range(100)] + [(7, 200, 4.5)]
    got = candidates.quantiles(spark.createDataFrame(rows, "graph long, id long, x double"), "x", {"lo": 0.1, "mid": 0.5, "hi": 1.0}).collect()
    for r in got:
        own = [x for g, _, x in rows if g == r["graph"]]
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(own, [0.1, 0.5, 1.0]))
    assert len(got) == 4


def test_lists_go_to_blocks_not_along_edges(spark, monkeypatch):
    """Many blocks, small steps, ids far apart and a hub: every triangle once, and lists aren't joined with each edge."""
    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (400, 2)).tolist() if a != b} | {(k, 60) for k in range(60)}
    pairs = sorted((a * 10**12 - 7, b * 10**12 - 7) for a, b in pairs)
    near = {frozenset(p) for p in pairs}
    names = sorted({x for p in pairs for x in p})
    want = sorted(t for t in combinations(names, 3) if all(frozenset(p) in near for p in combinations(t, 2)))
    frame = graph.checkpoint(spark.createDataFrame(pairs, "u long, v long"))
    monkeypatch.setattr(graph, "BLOCK_ENDS", 100)
    monkeypatch.setattr(graph, "WEDGES", 7)
    closed = graph.closed_pairs(frame, 0)
    assert graph.pair_blocks(frame, len(pairs), 0) > 5
    assert sorted(tuple(sorted((r["a"], r["b"], c))) for r in closed.collect() for c in r["third"]) == want
    assert "Join" not in closed._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ends", [40, 1 << 22])
def test_graphs_of_groups_equal_graphs_of_edges(spark, monkeypatch, ends):
    """Repeated members, groups of one, vertices without a label or an edge, a graph without edges, components over many blocks."""
    monkeypatch.setattr(adjacency, "BLOCK_ENDS", ends)
    rng = np.random.default_rng(11)
    span, label = 90, lambda v: None if v % 17 == 0 else v % 4
    items = [(g, g * 100 + o, int(v)) for g in range(3) for o in range(30) for v in rng.integers(g, 30 * g + 20, rng.integers(1, 5))]
    items += items[:9] + [(7, 700 + o, o) for o in range(5)] + [(8, 800 + o, v) for o in range(60) for v in (o, o + 1)]
    vertices = sorted({(g, v) for g, _, v in items})
    edges = [(g, a, b) for g, o, a in items for h, q, b in items if o == q and a < b]
    want = candidates.graph_metrics(spark.createDataFrame(edges, "graph long, src long, dst long"), spark.createDataFrame([(*x, label(x[1])) for x in vertices], "graph long, v long, b long"))
    frame = spark.createDataFrame([(o, g * span + v, label(v)) for g, o, v in items], "o long, id long, b long")
    got = candidates.group_metrics(frame, len(items), span)
    assert got.columns == want.columns
    rows = [{r["graph"]: r.asDict() for r in x.collect()} for x in (got, want)]
    assert rows[0].keys() == rows[1].keys() == {0, 1, 2, 7, 8}
    for k, r in rows[1].items():
        assert rows[0][k] == pytest.approx(r, abs=1e-12), k


def test_nations_make_no_table_of_edges(spark, monkeypatch):
    from blockspark.plans.queries import QUERIES

    rows, cut = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: rows.append(set(df.columns)) or cut(df))
    assert QUERIES["graph_metrics_by_nation"](spark, "/root/testdata/sf0.001").count() == 25
    assert not [c for c in rows if {"u", "v"} <= c - {"n"} and "cross" in c] and not [c for c in rows if {"graph", "o", "v"} <= c]
