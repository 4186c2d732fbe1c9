"""Matrix Market files, staged writes, repeated appends, run folders."""

import os

import pytest
from pyspark.sql import functions as F

from blockspark.sources import readers, runs, staged


def market(tmp_path, text, name="m.mtx"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


HEAD = "%%MatrixMarket matrix coordinate integer {}\n% a comment\n\n{}\n"


def test_matrix_market_counts_and_order(spark, tmp_path):
    body = "".join(f"{k % 50 + 1} {k * 7 % 50 + 1} {k % 9 + 1}\n" for k in range(4000))
    path = market(tmp_path, HEAD.format("general", "50 50 4000") + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits
        e, header = readers.matrix_market(spark, path)
        assert e.rdd.getNumPartitions() > 3 and header == {"vertices": 50, "entries": 4000, "found": 4000, "undirected": False}
        assert sorted(map(tuple, e.collect())) == sorted((k % 50, k * 7 % 50, float(k % 9 + 1)) for k in range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix_market_symmetric_and_faults(spark, tmp_path):
    path = market(tmp_path, HEAD.format("symmetric", "3 3 3") + "2 1 5\n3 3 2\n3\t1  4\n")
    e, header = readers.matrix_market(spark, path)
    assert header["undirected"] and sorted(map(tuple, e.collect())) == [(0, 1, 5.0), (0, 2, 4.0), (1, 0, 5.0), (2, 0, 4.0), (2, 2, 2.0)]
    for text, match in ((HEAD.format("general", "3 3 9") + "1 2 1\n", "9 entries declared, 1 found"), (HEAD.format("general", "3 4 1") + "1 2 1\n", "square"), ("%%Other\n3 3 0\n", "not a Matrix"), (HEAD.format("general", "x"), "size line")):
        with pytest.raises(ValueError, match=match):
            readers.matrix_market(spark, market(tmp_path, text))
    for bad in ("1 2 0\n", "1 2 0.5\n", "1 9 1\n", "1\n"):
        path = market(tmp_path, HEAD.format("general", "3 3 1") + bad)
        with pytest.raises(Exception, match="not an entry"):
            readers.matrix_market(spark, path)[0].collect()
    e, header = readers.matrix_market(spark, market(tmp_path, HEAD.format("pattern", "3 3 9") + "1 2\n2 3 0.5\n9 9 1\n"), strict=False)
    assert header["found"] == 3 and sorted(map(tuple, e.collect())) == [(0, 1, 1.0), (1, 2, 1.0)]


def test_numbers_as_g_prints_them(spark):
    values = [0.0, 1.0, -2.0, 1.5, 0.1, 123456.0, 1234567.0, 1e6, 1e-4, 1e-5, 0.123456789, -98765.4321, 9.999999, 999999.5, 3e300, 2.5e-300, 100.0, 1e15]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None)], "k int, v double").select("k", staged.general(F.col("v")).alias("g")).orderBy("k").collect()
    assert [r["g"] for r in got] == ["%g" % v for v in values] + [None]


def test_a_write_appears_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out" / "edges")
    broken = spark.range(20).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.when(F.col("id") < 19, 1.0).otherwise(F.raise_error(F.lit("killed")).cast("double")).alias("w"))
    with pytest.raises(Exception, match="killed"):
        staged.edges(broken.repartition(3), path)
    assert not os.path.exists(path)
    staged.edges(spark.createDataFrame([(0, 1, 2.0), (1, 2, 0.25)], "src long, dst long, w double").coalesce(1), path)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["1\t2\t2", "2\t3\t0.25"]
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == ["edges"]  # what the killed write left is cleared
    with pytest.raises(FileExistsError):
        staged.edges(broken, path)


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "measurements")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "graph string, runs int")
    assert staged.append(one, path, "job-1") and not staged.append(one, path, "job-1")
    broken = one.withColumn("runs", F.when(F.col("graph") == "a", F.col("runs")).otherwise(F.raise_error(F.lit("killed")).cast("int")))
    with pytest.raises(Exception, match="killed"):
        staged.append(broken, path, "job-2")
    assert staged.appended(spark, path).count() == 2
    assert staged.append(one, path, "job-2")
    assert sorted(tuple(r) for r in staged.appended(spark, path).collect()) == [(g, n, w) for g, n in (("a", "1"), ("b", "2")) for w in ("job-1", "job-2")]
    assert staged.columns(spark, path) == ["graph", "runs"] and not [f for f in os.listdir(path) if "staged" in f]
    with pytest.raises(ValueError, match="columns"):
        staged.append(one.select("runs", "graph"), path, "job-3")
    with pytest.raises(ValueError, match="name"):
        staged.append(one, path, "a/b")
    with pytest.raises(FileNotFoundError):
        staged.appended(spark, str(tmp_path / "absent"))


def test_run_folders(spark, tmp_path):
    def run(path, result=True, said=True):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "job.out").write_text("x\nJob completed successfully\n" if said else "x\n")
        if result:
            (tmp_path / path / "result.json").write_text("{}")

    run("d/td/g1/Param1/2024-01-01")
    run("d/td/g1/Param1/2024-02-01")
    run("d/td/g1/Param1/2024-03-01", said=False)
    run("d/td/g1/Param2/2024-01-01", result=False)
    run("d/td/g1/Param3/2024-01-01")
    run("d/td/g1/ParamX/2024-01-01")
    run("e/td/g2/Param9/2024-01-01")
    (tmp_path / "stray.txt").write_text("Job completed successfully")
    base = str(tmp_path)
    every = runs.runs(runs.files(spark, base), runs.finished(spark, base))
    assert every.count() == 7
    key = lambda df: sorted((r["graph"], r["param"], r["stamp"]) for r in df.collect())
    assert key(runs.latest(every)) == [("g1", "Param1", "2024-02-01"), ("g1", "Param3", "2024-01-01"), ("g1", "ParamX", "2024-01-01"), ("g2", "Param9", "2024-01-01")]
    limit = spark.createDataFrame(list(runs.limits(["g1:Param2, g3:4"]).items()), "graph string, most int")
    assert key(runs.latest(runs.within(every, limit))) == [("g1", "Param1", "2024-02-01"), ("g2", "Param9", "2024-01-01")]
    assert key(runs.latest(runs.within(every, None, ["Param3", "Param9"]))) == [("g1", "Param3", "2024-01-01"), ("g2", "Param9", "2024-01-01")]
    with pytest.raises(ValueError, match="limit"):
        runs.limits(["g1"])
    meta = spark.createDataFrame([("d", 5), ("d", 5)], "dataset string, vertices int")
    assert {r["vertices"] for r in runs.with_metadata(every, meta).collect()} == {5, None} and runs.with_metadata(every, meta).count() == 7
    assert runs.named(every, ["g1"]) == ["g1"]
    with pytest.raises(ValueError, match="unknown graph"):
        runs.named(every, ["g1", "g7"])
    parts = [runs.shard(spark.range(10), [F.asc("id")], 3, k).collect() for k in range(3)]
    assert [[r["id"] for r in sorted(p)] for p in parts] == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
