"""A corpus of graphs made in one job: each graph as asked for, whatever the partitioning; files whole."""

import json
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockspark.operators import candidates, corpus, generate

SIZES = [(k, 60, 150, 4) for k in range(12)] + [(20, 12, 30, 2), (30, 2, 1, 1), (31, 8, 0, 1)]


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame(SIZES, "graph long, nodes long, edges long, communities long").repartition(3)


@pytest.fixture(scope="module")
def made(graphs):
    return corpus.corpus(graphs, "t")


def test_numbers_in_chunks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 7), ("d", None)], "k string, n int")
    got = corpus.numbered(df, F.col("n"), "i", "k", chunk=3)
    assert sorted(map(tuple, got.select("k", "i").collect())) == [*(("a", i) for i in range(5)), *(("c", i) for i in range(7))]


def test_settings_have_one_graph_a_slice_and_balanced_categories(spark, graphs):
    plan = [r.asDict() for r in corpus.planned(graphs, "t").collect()]
    assert sorted(r["graph"] for r in plan) == sorted(s[0] for s in SIZES)
    big = sorted((r for r in plan if r["nodes"] == 60), key=lambda r: r["graph"])
    for name, (low, high) in corpus.RANGES.items():
        assert sorted(math.floor((r[name] - low) / (high - low) * 12) for r in big) == list(range(12))
    assert all(sorted(r["mode"] for r in big[k : k + 4]) == sorted(generate.MODES) for k in (0, 4, 8))
    assert all(sorted(r["pairs"] for r in big[k : k + 3]) == sorted(generate.PAIRS) for k in (0, 3, 6, 9))
    fixed = corpus.planned(graphs, "t", mode="powerlaw", mu=0.25).collect()
    assert {(r["mode"], r["mu"]) for r in fixed} == {("powerlaw", 0.25)}


@pytest.mark.parametrize("shape", [0.4, 1.0, 1.8])
def test_gamma_has_its_moments(spark, shape):
    x = np.array([r[0] for r in corpus.gamma(spark.range(20_000), F.lit(shape), "x", "g", "id").select("x").collect()])
    assert x.mean() == pytest.approx(shape, rel=0.04) and x.var() == pytest.approx(shape, rel=0.1) and (x > 0).all()


def test_communities_add_up(spark):
    plan = spark.createDataFrame([("even", 103, 4, 0.0), ("skew", 103, 4, 1.0), ("tight", 8, 4, 0.9), ("one", 5, 1, 0.5)], "graph string, nodes long, communities long, imbalance double")
    got = defaultdict(list)
    for r in corpus.communities(plan, 3).orderBy("b").collect():
        got[r["graph"]].append(r["size"])
    assert got["even"] == [25, 25, 25, 28] and got["tight"] == [2] * 4 and got["one"] == [5]
    assert sum(got["skew"]) == 103 and len(got["skew"]) == 4 and min(got["skew"]) >= 2 and max(got["skew"]) > 28
    with pytest.raises(Exception, match="two nodes a community"):
        corpus.communities(spark.createDataFrame([("x", 3, 2, 0.5)], plan.schema)).collect()


def test_each_graph_has_its_edges_and_mixing(spark, graphs, made):
    plan, v, _ = made
    at = {(r["graph"], r["v"]): (r["b"], r["weight"]) for r in v.collect()}
    settings = {r["graph"]: r for r in plan.collect()}
    rows = corpus.edges(v.repartition(7), plan.repartition(2), "t").collect()
    again = corpus.edges(v, plan, "t").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))  # not by partitioning
    for g, n, m, k in SIZES:
        own = [(r["src"], r["dst"]) for r in rows if r["graph"] == g]
        assert len(own) == len(set(own)) == m and all(0 <= a < b < n for a, b in own)
        assert sorted(x for h, x in at if h == g) == list(range(n)) and len({at[g, x][0] for x in range(n)}) == k
        if n == 60:
            cross = sum(at[g, a][0] != at[g, b][0] for a, b in own)
            assert cross == math.floor(m * settings[g]["mu"] + 0.5)
            if settings[g]["pairs"] == "negative":
                half = {}
                for c in range(k):
                    heavy = sorted((at[g, x][1], x) for x in range(n) if at[g, x][0] == c)
                    half |= {x: i >= len(heavy) // 2 for i, (_, x) in enumerate(heavy)}
                assert all(half[a] != half[b] for a, b in own if at[g, a][0] == at[g, b][0])
    for g, s in settings.items():
        w = [at[g, x][1] for x in range(s["nodes"])]
        if s["mode"] == "uniform":
            assert set(w) == {1.0}
        elif s["mode"] == "bimodal":
            high = Counter(w)
            assert len(high) == 2 or s["nodes"] == 1
            assert 5 <= max(w) <= 20 and max(1, math.floor(0.05 * len(w))) <= high[max(w)] <= max(1, 0.25 * len(w))
        elif s["mode"] == "powerlaw":
            assert min(w) >= 1


def test_too_many_edges_are_an_error_and_full_graphs_are_filled(spark):
    graphs = spark.createDataFrame([("full", 10, 45, 2), ("none", 10, 0, 2)], "graph string, nodes long, edges long, communities long")
    plan, v, e = corpus.corpus(graphs, 5)
    assert {tuple(r) for r in e.collect()} == {("full", a, b) for b in range(10) for a in range(b)}
    with pytest.raises(ValueError, match="45 pairs"):
        corpus.edges(v, plan.withColumn("edges", F.lit(46)), 5)
    empty = corpus.corpus(graphs.limit(0), 5)
    assert [x.count() for x in empty] == [0, 0, 0]


def test_closing_keeps_edges_and_makes_triangles(spark, made):
    plan, v, e = made
    counts = {r["graph"]: r["n"] for r in e.groupBy("graph").agg(F.count_distinct("src", "dst").alias("n")).collect()}
    assert counts == {g: m for g, _, m, _ in SIZES if m}
    open_edges = corpus.edges(v, plan, "t")
    before = {r["graph"]: r["avg_clustering"] for r in candidates.graph_metrics(open_edges, v).collect()}
    after = {r["graph"]: r["avg_clustering"] for r in candidates.graph_metrics(e, v).collect()}
    strong = [r["graph"] for r in plan.where("nodes = 60 and clustering > 0.5").collect()]
    assert len(strong) == 6 and np.mean([after[g] for g in strong]) > 1.5 * np.mean([before[g] for g in strong])
    still = corpus.closed(open_edges, v, plan.withColumn("clustering", F.lit(0.0)), "t")
    assert sorted(map(tuple, still.collect())) == sorted(map(tuple, open_edges.collect()))
    with pytest.raises(ValueError):
        corpus.closed(open_edges, v, plan, rounds=1)


def test_files_of_a_corpus(spark, made, tmp_path):
    _, v, e = made
    folder = str(tmp_path / "corpus")
    s = corpus.write(made, folder, 5).collect()
    assert sorted(r["output_id"] for r in s) == list(range(5)) and len({r["dataset"] for r in s}) == 5
    names = {r["dataset"]: r["graph"] for r in s}
    edges = spark.read.csv(f"{folder}/edges", sep="\t", schema="src long, dst long, w string, dataset string").collect()
    want = Counter((r["graph"], r["src"] + 1, r["dst"] + 1, "1.0") for r in e.collect() if r["graph"] in names.values())
    assert Counter((names[r["dataset"]], r["src"], r["dst"], r["w"]) for r in edges) == want
    truth = spark.read.csv(f"{folder}/truth", sep="\t", schema="v long, b long, dataset string").collect()
    assert Counter((names[r["dataset"]], r["v"], r["b"]) for r in truth) == Counter((r["graph"], r["v"] + 1, r["b"]) for r in v.collect() if r["graph"] in names.values())
    table = spark.read.csv(f"{folder}/candidates", header=True)
    assert table.count() == len(SIZES) and {"actual_mu", "mode", "imbalance"} <= set(table.columns)
    (part,) = [p for p in os.listdir(f"{folder}/coverage") if p.startswith("part-") and os.path.getsize(f"{folder}/coverage/{p}")]
    report = json.loads(open(f"{folder}/coverage/{part}").read())
    x = np.array([[r[c] for c in corpus.COVERED] for r in s], float)
    span = np.ptp(x, axis=0)
    x = np.clip(np.floor((x - x.min(axis=0)) / np.where(span > 0, span, 1) * 10), 0, 9)
    marginal = {c: len(set(x[:, k])) / 10 for k, c in enumerate(corpus.COVERED)}
    assert report["marginal_coverage"] == pytest.approx(marginal) and report["coverage_metrics"] == corpus.COVERED
    share = np.unique(x, axis=0, return_counts=True)[1] / 5
    entropy = -np.sum(share * np.log(share + 1e-12)) / (np.log(len(share)) if len(share) > 1 else 1)
    assert report["overall_coverage_score"] == pytest.approx(0.5 * np.mean(list(marginal.values())) + 0.3 * len(share) / 5 + 0.2 * entropy)
    with pytest.raises(FileExistsError):
        corpus.write(made, folder, 5)
