"""Reports of broken rows, column order, stored parts, constants of runs, and the evaluation of a partition."""

import pytest
from pyspark.sql import functions as F

from blockspark.operators import blockmodel as bm
from blockspark.operators import quality, validate


def test_reports_name_the_first_five(spark):
    df = spark.createDataFrame([(g, k, float(k) if k % 4 else None) for g in ("a", "b") for k in range(12)], "graph string, config int, x double").repartition(5)
    rules = {"large": F.col("x") > 2, "none": F.col("x") < 0, "missing": F.col("x").isNull()}
    got = {r["check"]: (r["violations"], r["examples"]) for r in validate.report(df, ["graph", "config"], rules).collect()}
    assert got == {"large": (14, "a::3, a::5, a::6, a::7, a::9"), "none": (0, ""), "missing": (6, "a::0, a::4, a::8, b::0, b::4")}
    assert validate.or_error(df, ["graph"], {"none": rules["none"]}) is df
    with pytest.raises(ValueError, match="missing: 6 rows, first a::0, a::4, a::8, b::0, b::4$"):
        validate.or_error(df, ["graph", "config"], rules | {"large": F.lit(False)})
    assert {r["violations"] for r in validate.report(df.limit(0), ["graph"], rules).collect()} == {0}


def test_columns_parts_and_constants(spark):
    df = spark.createDataFrame([("g1", 1, 2.0, "p", 7), ("g1", 1, 4.0, "p", 7), ("g2", 1, 1.0, None, 8), ("g2", 1, 3.0, None, 8)], "graph string, config int, score double, param string, extra int")
    assert validate.in_order(df, ["config", "graph"], ["param", "absent"]).columns == ["config", "graph", "param", "score", "extra"]
    with pytest.raises(ValueError, match="missing columns: .'other'"):
        validate.in_order(df, ["other"])
    split = spark.createDataFrame([("g1", "test"), ("g2", "train"), ("g9", "all"), ("g8", "all")], "graph string, part string")
    assert {r["graph"] for r in validate.stored_part(df, split, "test").collect()} == {"g1"}
    for part, match in (("all", "missing g8, g9"), ("absent", "no keys")):
        with pytest.raises(ValueError, match=match):
            validate.stored_part(df, split, part)
    got = sorted(map(tuple, validate.averaged_with_constants(df, ["score"], ["param", "extra"], expected=2).collect()))
    assert got == [("g1", 1, 3.0, "p", 7, 2), ("g2", 1, 2.0, None, 8, 2)]
    with pytest.raises(ValueError, match="not 3 runs: 2 rows, first g1::1, g2::1"):
        validate.averaged_with_constants(df, ["score"], ["param"], expected=3)
    with pytest.raises(ValueError, match="different constants: 1 rows, first g2::1"):
        validate.averaged_with_constants(df.union(df.limit(1).withColumn("graph", F.lit("g2"))), ["score"], ["param"])


def test_an_evaluation_holds_both_lengths(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a in range(8) for b in range(8) if a != b and (a // 4 == b // 4 or (a + b) % 7 == 0)], "src long, dst long, w double")
    v = spark.range(8).withColumnRenamed("id", "v")
    truth, found = v.selectExpr("v", "v div 4 as b"), v.selectExpr("v", "v div 2 as b")
    r = quality.evaluation(e, found, truth).first()
    want = quality.agreement(found, truth).first()
    assert (r["f1"], r["nmi"], r["blocks"], r["true_blocks"]) == (want["f1"], want["nmi"], 4, 2)
    assert r["mdl"] == bm.mdl(e, found).first()["mdl"] and r["true_mdl"] == bm.mdl(e, truth).first()["mdl"] and r["null_mdl"] == bm.mdl_null(e, truth).first()["mdl"]
