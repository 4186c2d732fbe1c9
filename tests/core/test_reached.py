"""Functions that no query reaches: readers of texts and usage, samples, generators' helpers, streams."""

import numpy as np
from pyspark.sql import functions as F

from blockspark.operators import sampling, synth, tuning
from blockspark.sources import readers
from blockspark.streaming.incremental import block_matrix_stream

EDGES = "src long, dst long, w double"


def test_texts_of_runs(spark):
    rows = [
        (1, '{"Runtime (s)": 2.5}', None, "Total runtime: 9", "Success"),
        (2, "{}", '{"runtime": 4}', "runtime = 8", None),
        (3, None, None, "Runtime: 1\nRuntime: 7", "job hit the TIME LIMIT"),
        (4, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, result string, perf string, log string, out string")
    got = df.select("k", readers.performance(F.col("result"), F.col("perf"), F.col("log")).alias("t"), readers.run_state(F.col("out"), F.col("result")).alias("s")).orderBy("k").collect()
    assert [(r["t"], r["s"]) for r in got] == [(2.5, "done"), (4.0, "pending"), (7.0, "oot"), (None, "pending")]
    pairs = spark.createDataFrame([("nodes = 4\nranks= 2",)], "x string").select(readers.key_values(F.col("x")).alias("m")).first()["m"]
    assert pairs == {"nodes": "4", "ranks": "2"}
    usage = spark.createDataFrame([("a", 10.0, 90.0, 5.0), ("a", 16.0, 50.0, 9.0), ("b", 3.0, 0.0, 1.0)], "run string, Timestamp double, CPU_Idle double, Mem_Used_MB double")
    assert sorted(map(tuple, readers.resource_usage(usage, "run").collect())) == [("a", 6.0, 30.0, 50.0, 9.0), ("b", 0.0, 100.0, 100.0, 1.0)]


def test_truth_and_names(spark):
    v = spark.range(3).withColumnRenamed("id", "v")
    truth = spark.createDataFrame([(0, 5), (2, 7)], "v long, b long")
    assert sorted(map(tuple, readers.with_truth(v, truth).collect())) == [(0, 5), (1, -1), (2, 7)]
    assert {r["b"] for r in readers.with_truth(v, None).collect()} == {0}
    df = spark.createDataFrame([(1, 2, 3)], "Graph int, Dataset int, `Result Batch` int")
    assert tuning.rename_aliases(df).columns == ["Graph Name", "Dataset", "Result Batch"]


def test_sweeps_in_the_order_of_numbers(spark, tmp_path):
    for theta, run in ((10, 1), (2, 2), (2, 10)):
        (tmp_path / f"theta_{theta}" / f"run_{run}").mkdir(parents=True)
        (tmp_path / f"theta_{theta}" / f"run_{run}" / "result.json").write_text("{}")
    got = readers.sweep_files(spark, str(tmp_path)).collect()
    assert sorted((int(r["theta"]), int(r["run"])) for r in got) == [(2, 2), (2, 10), (10, 1)]


def test_detached_vertices_and_snowballs(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 5, 1.0)], EDGES)
    v = spark.range(7).withColumnRenamed("id", "v")
    assign = spark.createDataFrame([(0, 4), (1, 4), (2, 3)], "v long, b long")
    got = {r["v"]: r["b"] for r in sampling.reattach(e, assign, v, 5).collect()}
    assert got[0] == got[1] == 4 and got[2] == 3 and got[3] == 4 and set(got) == set(range(7)) and all(0 <= b < 5 for b in got.values())
    for share in (0.3, 1.0):
        found = [r["v"] for r in sampling.degree_product_snowball(e, v, share).collect()]
        assert len(found) == len(set(found)) == int(7 * share)


def test_closing_triangles_keeps_edges(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (150, 2)) if a != b} | {(k, 99) for k in range(25)} | {(99, k) for k in range(40)})
    e = spark.createDataFrame([(a, b, 1.0) for a, b in rows], EDGES)
    out = synth.close_triangles(e, 0.5, 1)
    new = {(r["src"], r["dst"]): r["w"] for r in out.collect()}
    assert sum(new.values()) == len(rows) and all(a != b for a, b in new)
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
    turned = [p for p in new if p not in set(rows)]
    assert turned and all(any(c in near.get(b, ()) for b in near[a]) for a, c in turned)
    assert new == {(r["src"], r["dst"]): r["w"] for r in synth.close_triangles(e.repartition(7), 0.5, 1).collect()}
    same = {(r["src"], r["dst"]) for r in synth.close_triangles(e, 0.0).collect()}
    assert same == set(rows)


def test_a_hypercube_has_one_point_a_slice():
    x = synth.latin_hypercube(16, 3, seed=2)
    assert x.shape == (16, 3) and all(sorted((c * 16).astype(int)) == list(range(16)) for c in x.T)


def test_a_stream_of_edges(spark, tmp_path):
    spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 4.0)], EDGES).repartition(3).write.json(str(tmp_path / "in"))
    assign = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "v long, b long")
    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = block_matrix_stream(stream, assign).writeStream.format("memory").queryName("matrix").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("matrix").collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0)]
