"""Toxicity: the same model under any partitioning; held-out accuracy; tables without labels or words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockspark.llm import queries, toxicity

from .test_whole_job import documents


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_scores_do_not_depend_on_partitions(spark, tables):
    docs, labels = tables
    one = toxicity.train(docs, labels)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("13", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        two = toxicity.train(docs.repartition(7, F.rand(3)), labels.repartition(5, F.rand(4)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (one.ordinary, one.toxic) == (two.ordinary, two.toxic) and np.allclose(one.weight, two.weight)
    assert len(one.ordinary) == len(one.toxic) > toxicity.BASE and one.ordinary != one.toxic


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    rank = got["score"].rank().to_numpy()
    bad = (got["toxic"] == 1).to_numpy()
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    print("AUC", auc, "recall", (got["score"][bad] >= 0.5).mean(), "false", (got["score"][~bad] >= 0.5).mean())
    assert len(got) == 825 and auc > 0.85 and (got["score"][bad] >= 0.5).mean() > 0.5 and (got["score"][~bad] >= 0.5).mean() < 0.03


def test_odd_tables(spark, tables):
    docs, labels = tables
    odd = documents(spark, [(None, None), (1, ""), (1, "  "), (2, "x" * 50000), (2, "x y")])
    none = toxicity.train(odd, labels.limit(0))
    assert [r["score"] for r in toxicity.score(odd, none).collect()] == [0.0] * 5
    few = toxicity.train(odd, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality long, toxic long"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, few).collect())


def test_templated_text_is_learned(spark):
    """Few families of near copies, or one text of a class, still give a model that scores."""
    calm = [f"report {i}: the {w} river ran past the old mill near town {i % 7}" for i, w in enumerate(["green", "quiet", "long"] * 80)]
    foul = [f"report {i}: the {w} river ran past you worthless scum near town {i % 7}" for i, w in enumerate(["green", "quiet", "long"] * 60)]
    for bad in (foul, foul[:30], foul[:1] * 5):
        docs = documents(spark, list(enumerate(calm + bad)))
        model = toxicity.train(docs, docs.selectExpr("doc_id", f"int(doc_id >= {len(calm)}) as toxic"))
        assert model.weight
        got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, [(0, calm[5]), (1, bad[0])]), model).collect()}
        # a segment is distinctive if two different texts hold it, so less than that tells nothing
        assert 0 < got[0] < got[1] if len(set(bad)) > 3 else 0 < got[0] <= got[1]
