"""Tables without labels, rows that share an id, dense regions."""

import numpy as np

from blockspark.llm import embed_dedup, langid

from .test_hot_groups import components
from .test_whole_job import documents


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")


def test_language_without_labels(spark):
    rows = [(1, "some text"), (2, None), (3, ""), (4, "123")]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "cast(null as string) as lang")
    f = langid.train(docs)
    assert sorted(tuple(r) for r in langid.predict(docs, f).collect()) == [(k, "und", 0.0) for k in (1, 2, 3, 4)]
    assert [r["doc_id"] for r in langid.keep(docs, f).collect()] == [1]


def test_the_language_stage_rejects_other_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    f = langid.train(docs)
    right = {r["doc_id"] for r in langid.keep(docs, f).collect()}
    assert len(right) > 900
    other = docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "'%s' as lang" % f.languages[0])
    got = {r["doc_id"] for r in langid.keep(other, f).collect()}
    own = {r["doc_id"] for r in docs.where(docs["lang"] == f.languages[0]).collect()}
    assert got and got <= own | {r["doc_id"] for r in docs.where("lang is null").collect()}


def test_dense_lists_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LONG", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(k, 1, (centre + rng.normal(size=16) * 0.2).tolist()) for k in range(80)] + [(100 + k, 1, rng.normal(size=16).tolist()) for k in range(40)]
    x = np.array([r[2] for r in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    root = components(len(rows), [(i, j) for i, j in zip(*np.nonzero(link), strict=True)])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    found = sum(got[rows[k][0]]["n_links"] for k in range(len(rows)))
    assert found <= link.sum() and found >= 0.9 * link.sum()
    assert sum(got[r[0]]["component_id"] == rows[root[k]][0] for k, r in enumerate(rows)) > 0.95 * len(rows)


def test_vectors_of_one_id_and_double_precision(spark):
    a, b = [1.0, 0.0, 0.0, 1e-9], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, 1, a), (1, 1, b), (2, 1, a), (3, 1, b), (4, None, a), (5, 1, None), (6, 1, [0.0, 0.0, 0.0, 0.0]), (7, 2, a), (7, 2, a), (8, 1, [1.0, 0.0, 0.0, 2e-9])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (7, 1, 7), (8, 2, 1)]


def test_vectors_of_extreme_scale(spark):
    big, small = [[1e200, 0.0], [1e200, 1e180], [3e300, 1e307]], [[1e-200, 0.0], [2e-200, 1e-220], [5e-324, 0.0], [1e-310, 1e-310]]
    rows = [(k, 1, v) for k, v in enumerate([*big, *small, [1.0, 0.0], [float("inf"), 0.0]])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    # 0, 1, 3, 4, 5 and 7 point along the first axis; 2 along the second, 6 between them
    assert got == {0: (5, 0), 1: (5, 0), 2: (0, 2), 3: (5, 0), 4: (5, 0), 5: (5, 0), 6: (0, 6), 7: (5, 0), 8: (0, 8)}
