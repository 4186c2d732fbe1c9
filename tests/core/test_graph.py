"""Hand-computable graphs, invariants and readers."""

import math

import pytest

from blockspark.functions import mathx
from blockspark.operators import blockmodel as bm
from blockspark.operators import delta, graph, profile, quality, sampling, synth, tuning
from blockspark.plans.search import Bracket, Candidate, should_stop
from blockspark.sources import readers, writers


def edges(spark, *e):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in e], "src long, dst long, w double")


def assign(spark, blocks):
    return spark.createDataFrame(list(enumerate(blocks)), "v long, b long")


@pytest.fixture(scope="module")
def two_triangles(spark):
    return edges(spark, (0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (2, 3, 1)), assign(spark, [0, 0, 0, 1, 1, 1])


def test_two_triangles(spark, two_triangles):
    e, a = two_triangles
    v = graph.vertex_set(e)
    assert graph.triangles(graph.simple_pairs(e)).count() == 2
    assert {r["v"]: r["cc"] for r in profile.clustering(graph.simple_pairs(e), v).collect()} == pytest.approx({0: 1, 1: 1, 2: 1 / 3, 3: 1 / 3, 4: 1, 5: 1})
    assert quality.modularity(e, a).first()[0] == pytest.approx(6 / 7 - (4 * 3 + 3 * 4) / 49)
    assert quality.conductance(e, a).first()[0] == pytest.approx(1 / 8)
    assert {r["component"] for r in graph.connected_components(e, v).collect()} == {0}


def test_one_block_is_null(spark, two_triangles):
    e, _ = two_triangles
    one = assign(spark, [5] * 6)
    assert bm.mdl_normalized(e, one).first()["normalized"] == pytest.approx(1)
    lg = math.lgamma
    assert bm.mdl(e, one).first()["mdl"] == pytest.approx(-lg(8) + 14 * math.log(6) + lg(7) - lg(7) + math.log(6))


def test_special_functions(spark):
    d = spark.range(1, 400).select("id", mathx.lgamma(__import__("pyspark").sql.functions.col("id")).alias("x")).collect()
    assert all(abs(r["x"] - math.lgamma(r["id"])) < 1e-9 for r in d)
    assert mathx.spence(0.0) == pytest.approx(math.pi**2 / 6) and mathx.spence(1.0) == 0
    # partitions of 60 into at most 60 parts: 966467
    assert mathx.log_q_value(60, 60) == pytest.approx(math.log(966467), rel=0.02)


@pytest.mark.parametrize("loops", [False, True])
def test_deltas_equal_recomputation(spark, loops):
    e = edges(spark, (0, 1, 2), (1, 2, 3), (2, 0, 1), (3, 4, 5), (4, 3, 2), (2, 3, 1), (0, 4, 2), *([(1, 1, 3), (3, 3, 2)] if loops else []))
    a = assign(spark, [0, 0, 1, 2, 2])
    m = bm.block_matrix(e, a)
    t = bm.block_table(m, a)
    start = bm.mdl(e, a).first()["mdl"]
    for r in delta.merge_delta(m, t, spark.createDataFrame([(0, 1), (2, 0)], "a long, b long")).collect():
        after = a.selectExpr("v", f"case when b = {r['a']} then {r['b']} else b end as b")
        assert start + r["delta"] == pytest.approx(bm.mdl(e, after).first()["mdl"], abs=1e-7)
    for r in delta.move_delta(e, a, m, t, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "v long, to long")).collect():
        after = a.selectExpr("v", f"case when v = {r['v']} then {r['to']} else b end as b")
        assert start + r["delta"] == pytest.approx(bm.mdl(e, after).first()["mdl"], abs=1e-7)


def test_validate_finds_a_wrong_cell(spark, two_triangles):
    e, a = two_triangles
    m = bm.block_matrix(e, a)
    assert bm.validate(e, a, m).count() == 0
    assert bm.validate(e, a, m.selectExpr("r", "s", "m + 1 as m")).count() > 0


def test_agreement_and_matching(spark):
    a, b = assign(spark, [0, 0, 1, 1, 2, 2]), assign(spark, [7, 7, 8, 8, 9, 9])
    assert tuple(quality.agreement(a, b).first()) == pytest.approx((1, 1, 1, 1, 1))
    assert quality.matching_accuracy(a, b).first()[0] == 1
    assert quality.assignment_cost([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == 5
    assert quality.agreement(a, spark.createDataFrame([], "v long, b long")).first()["f1"] is None


def test_global_rank_is_total(spark):
    from pyspark.sql import functions as F

    d = spark.range(500).withColumn("x", F.col("id") % 7)
    got = [(r["x"], r["id"]) for r in graph.global_rank(d, [F.desc("x"), F.asc("id")]).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_extension_and_samples(spark, two_triangles):
    e, a = two_triangles
    out = {r["v"]: r["b"] for r in sampling.extend(e, a.where("v in (0, 5)"), a.select("v"), 2).collect()}
    assert len(out) == 6 and out[1] == 0 and out[4] == 1
    assert sampling.snowball(e, a.select("v"), 0.5, 3).count() == 3
    assert sampling.expansion_snowball(e, a.select("v"), 0.5, 3).count() == 3


def test_bracket_finds_the_least():
    for grow, rate, start in ((False, 0.5, 64), (True, 1.25, 1)):
        cost = lambda b: (b - 11) ** 2 + 5
        bracket = Bracket(grow=grow, rate=rate)
        bracket.add(Candidate(start, cost(start)))
        for _ in range(80):
            step = bracket.next()
            if step is None:
                break
            bracket.add(Candidate(step[1], cost(step[1])))
        assert bracket.best.blocks == 11
    assert should_stop([-1, -1, 0.0], 100, True) and not should_stop([-9, -9, -9], 100, True)


def test_planted_graph(spark):
    e, truth = synth.planted(spark, synth.community_sizes(40, 4), 800, 0.05, seed=1)
    assert e.where("src = dst").count() == 0 and truth.groupBy("b").count().count() == 4
    assert 0.02 < bm.edge_blocks(e, truth).selectExpr("sum(if(r <> s, w, 0)) / sum(w) as x").first()["x"] < 0.09


def test_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# c\n1\t2\t3\n2 3\n")
    assert sorted(map(tuple, readers.edge_list(spark, str(tmp_path / "e.tsv")).collect())) == [(0, 1, 3.0), (1, 2, 1.0)]
    (tmp_path / "bad.tsv").write_text("1\t2\t-3\n")
    with pytest.raises(Exception, match="not a weight"):
        readers.edge_list(spark, str(tmp_path / "bad.tsv")).collect()
    assert readers.edge_list(spark, str(tmp_path / "bad.tsv"), strict=False).count() == 1
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n3 3\n")
    e, header = readers.matrix_market(spark, str(tmp_path / "m.mtx"))
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [(0, 1), (1, 0), (2, 2)] and header["undirected"]
    (tmp_path / "r.json").write_text('{"Results": [9]}\n{"Results": [1, 0, 1], "Runtime (s)": 2.5}')
    p = readers.result_partition(readers.documents(spark, str(tmp_path / "r.json")), 1).collect()
    assert [(r["v"], r["b"]) for r in p] == [(1, 1), (2, 0), (3, 1)]
    logs = spark.createDataFrame([("Runtime: 3.5\nruntime = 4\niteration 3\niteration 9",)], "text string")
    assert tuple(readers.log_metrics(logs).select("runtime", "iterations").first()) == (4.0, 9)
    (tmp_path / "c.conf").write_text("# x\n" + "|".join(["1", "2", "2", "20000", "on", "random", "snowball", "0.1", "hybrid", "low", "1", "0", "0", "0", "1", "4"]) + "\n")
    assert readers.configurations(spark, str(tmp_path / "c.conf")).first()["MH_PERCENT"] == 0.1
    writers.edges(edges(spark, (0, 1, 2)), str(tmp_path / "out"))
    assert readers.edge_list(spark, str(tmp_path / "out")).first() == (0, 1, 2.0)


def test_switch_and_weights(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("TRUE",), ("0.0",)], "x string").select(tuning.switch(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in d] == ["on", "off"]
    with pytest.raises(ValueError):
        tuning.weights_or_error((0.5, 0.6, 0.1))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 60
