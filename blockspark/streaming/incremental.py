"""An extension that the batch operators don't need: the block matrix of a stream of edges, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_matrix_stream(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(r, s, m) as a streaming aggregate of edges(src, dst, w) against a static assign; write it in update mode."""
    a = assign.select(F.col("v").alias("src"), F.col("b").alias("r"))
    b = assign.select(F.col("v").alias("dst"), F.col("b").alias("s"))
    return edges.join(a, "src").join(b, "dst").groupBy("r", "s").agg(F.sum("w").alias("m"))


def windowed_matrix(edges: DataFrame, assign: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """As above for each tumbling window of ``time``; rows later than ``late`` are dropped by the watermark."""
    a = assign.select(F.col("v").alias("src"), F.col("b").alias("r"))
    b = assign.select(F.col("v").alias("dst"), F.col("b").alias("s"))
    return edges.withWatermark(time, late).join(a, "src").join(b, "dst").groupBy(F.window(time, window).alias("window"), "r", "s").agg(F.sum("w").alias("m"))
