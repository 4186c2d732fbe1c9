"""Writers of edges, partitions, results, profiles and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staged import append, edges


def graph_with_truth(edge_df: DataFrame, assign: DataFrame, path: str, base: int = 1) -> None:
    edges(edge_df, f"{path}/edges", base)
    assign.select((F.col("v") + base).alias("v"), "b").write.csv(f"{path}/truth", sep="\t")


def results(df: DataFrame, path: str) -> None:
    """One JSON document a row; a run's rows are appended."""
    df.write.mode("append").json(path)


def profile(df: DataFrame, path: str) -> None:
    """Per-iteration rows, and row -1 with the totals of the timers."""
    timers = [c for c in df.columns if c.endswith("_time")]
    totals = df.where("iteration > -1").agg(*[F.sum(c).alias(c) for c in timers]).withColumn("iteration", F.lit(-1))
    df.where("iteration > -1").unionByName(totals, allowMissingColumns=True).write.mode("append").csv(path, header=True)


def measurements(df: DataFrame, path: str, writer: str) -> bool:
    """Appends a writer's rows once, under one header; False if they are there already."""
    return append(df, path, writer)
