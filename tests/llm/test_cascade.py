"""The cascade: the same verdict and reason in any order; the base inside it; every rule against plain Python."""

import re

from pyspark.sql import functions as F

from blockspark.llm import quality

from .test_whole_job import documents


def test_keep_equals_assess_and_reasons_are_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = documents(spark, [(None, None), (9001, ""), (9001, "a | b " * 60), (9002, "word " * 3000), (9003, "AB! CD! " * 40)])
    docs = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = quality.assess(docs)
    assert sorted(map(str, (r["doc_id"] for r in got.where("kept").collect()))) == sorted(map(str, (r["doc_id"] for r in quality.keep(docs).collect())))
    again = quality.assess(docs, tuple(quality.RULES), sample_rows=5)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_rules_against_python(spark):
    rows = [(k, t) for k, t in enumerate(["plain words of a good text " * 20, "x # y * z " * 20, "a | b c d e " * 12, "12 34 56 ab " * 30, "SHOUT LOUD " * 40, "no! no! no! yes " * 20, "aline of words\n" * 30, "a b c d " * 20, "q" * 40 + " " + ("longwordlongword" * 2 + " ") * 60])]
    got = {r["doc_id"]: [n for n in (x.name for x in quality.RULES) if r[n]] for r in quality.features(documents(spark, rows)).select("doc_id", *[x.reject().alias(x.name) for x in quality.RULES]).collect()}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars, letters = sum(map(len, w)), sum(c.isalpha() for c in t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = {
            "symbols": 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w),
            "bars": 20 * t.count("|") > len(w),
            "letters": 10 * letters < 8 * chars,
            "duplicate_lines": 2 * (len(lines) - len(set(lines))) > len(lines),
            "word_length": chars < 2 * len(w) or chars > 15 * len(w),
            "exclamation": 5 * t.count("!") > len(w),
            "capitals": 2 * sum(c.isupper() for c in t) > letters,
        }
        assert got[k] == [n for n, v in want.items() if v], t
    assert {n for v in got.values() for n in v} == {x.name for x in quality.RULES}


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for plan in (quality.assess(docs), quality.keep(docs)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and plan.select(F.count("*")).first()[0] > 0
