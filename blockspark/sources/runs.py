"""Which runs there are: keys from the paths of result files, limits, the latest complete run of each configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import global_rank

#: Text of a finished run's output; fixed value.
SUCCESS_MARKER = "Job completed successfully"

KEYS = ("dataset", "algorithm", "graph", "param")
_RUN = r"([^/]+)/([^/]+)/([^/]+)/(Param[^/]*)/([^/]+)/([^/]+)$"


def files(spark: SparkSession, base: str) -> DataFrame:
    """(path) of every file under base; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")


def finished(spark: SparkSession, base: str, marker: str = SUCCESS_MARKER) -> DataFrame:
    """(path) of the output files (*.out) under base that hold the marker."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.out").text(base)
    return lines.where(F.col("value").contains(marker)).select(F.col("_metadata.file_path").alias("path")).distinct()


def param_number(param: Column) -> Column:
    """12 of Param12; null of others."""
    return F.regexp_extract(param, r"^Param(\d+)$", 1).try_cast("int")


def runs(paths: DataFrame, done: DataFrame) -> DataFrame:
    """(dataset, algorithm, graph, param, number, stamp, has_result, complete) of each run folder .../dataset/algorithm/graph/Param../stamp.

    complete: it has a result.json, and an output file of it is in done(path).
    """
    keys = [F.regexp_extract("path", _RUN, k + 1).alias(c) for k, c in enumerate((*KEYS, "stamp", "file"))]
    own = paths.where(F.col("path").rlike(_RUN)).select(*keys).groupBy(*KEYS, "stamp").agg(F.max(F.col("file") == "result.json").alias("has_result"))
    good = done.where(F.col("path").rlike(_RUN)).select(*keys).select(*KEYS, "stamp", F.lit(True).alias("said")).distinct()
    x = own.join(good, [*KEYS, "stamp"], "left")
    return x.select(*KEYS, param_number(F.col("param")).alias("number"), "stamp", "has_result", (F.col("has_result") & F.coalesce("said", F.lit(False))).alias("complete"))


def limits(items: list[str]) -> dict[str, int]:
    """{graph: largest number} of texts like ``graph:12,other:Param3``; a text without a number is an error."""
    out = {}
    for item in (x.strip() for text in items for x in text.split(",") if x.strip()):
        graph, colon, most = item.partition(":")
        most = most.strip().removeprefix("Param")
        if not colon or not most.isdigit():
            raise ValueError(f"not a limit like GRAPH:NUMBER: {item}")
        out[graph.strip()] = int(most)
    return out


def within(all_runs: DataFrame, limit: DataFrame | None = None, params: list[str] | None = None) -> DataFrame:
    """The runs of the named params (all where none is named) whose number isn't over their graph's limit(graph, most).

    A graph without a limit keeps all; under one, params without a number go.
    """
    x = all_runs if params is None else all_runs.where(F.col("param").isin(*params))
    if limit is None:
        return x
    x = x.join(limit.select("graph", "most"), "graph", "left")
    return x.where(F.col("most").isNull() | F.coalesce(F.col("number") <= F.col("most"), F.lit(False))).select(all_runs.columns)


def latest(all_runs: DataFrame) -> DataFrame:
    """The complete run of the greatest stamp of each configuration: a partial maximum, so many runs of one never meet in a task."""
    own = F.struct(*[c for c in all_runs.columns if c not in KEYS])
    x = all_runs.where("complete").groupBy(*KEYS).agg(F.max_by(own, "stamp").alias("x"))
    return x.select(*KEYS, "x.*")


def with_metadata(all_runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """all_runs with the columns of metadata(dataset, ...), of which a dataset has one row; null where it has none."""
    return all_runs.join(metadata.dropDuplicates(["dataset"]), "dataset", "left")


def named(known: DataFrame, requested: list[str], column: str = "graph") -> list[str]:
    """The requested names, each of which must be among known's."""
    found = {r[column] for r in known.where(F.col(column).isin(*requested)).select(column).distinct().collect()}  # no more than were requested
    missing = [x for x in requested if x not in found]
    if missing:
        raise ValueError(f"unknown {column}: {missing[:5]}")
    return requested


def shard(df: DataFrame, order: list[Column], count: int, index: int) -> DataFrame:
    """Each count-th row in the (total) order, from the index-th on."""
    return global_rank(df, order, "__at").where(F.pmod(F.col("__at") - 1, F.lit(count)) == index).drop("__at")
