"""Planted-partition graphs, by hash uniforms: the same graph whatever the partitioning."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform
from .graph import checkpoint, global_rank


def community_sizes(vertices: int, communities: int, equal: bool = True, seed: int = 0, concentration: float = 1.0) -> list[int]:
    """Sizes of at least 2 that add up to ``vertices``: equal up to one, or by Dirichlet shares."""
    if vertices < 2 * communities:
        raise ValueError("a community has two vertices at least")
    shares = np.full(communities, 1 / communities) if equal else np.random.default_rng(seed).dirichlet(np.full(communities, concentration))
    sizes = 2 + np.floor(shares * (vertices - 2 * communities)).astype(int)
    for k in range(vertices - int(sizes.sum())):
        sizes[k % communities] += 1
    return sizes.tolist()


def planted(spark: SparkSession, sizes: list[int], edges: int, mu: float = 0.1, seed: int = 0, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst, w), truth(v, b)): ``edges`` draws without loops, a share ``mu`` between communities; repeats add up in w.

    An edge's ends are drawn by numbers that hash its index, so rows are made where they are needed.  A draw that would be a loop goes
    to the next vertex of the community.  All vertices are alike; ``generate`` has degree shapes and simple graphs.
    """
    k = len(sizes)
    starts = [0, *itertools.accumulate(sizes)]
    n, start, size = starts[-1], F.array(*map(F.lit, starts[:-1])), F.array(*map(F.lit, sizes))  # a few numbers for each community
    e = spark.range(0, edges, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "i")
    u = lambda name: hash_uniform(f"{seed}{name}", F.col("i"))
    at = F.floor(u("c") * n)
    of = F.size(F.filter(F.array(*map(F.lit, starts[1:])), lambda s: s <= at))
    e = e.withColumn("p", of.cast("int")).withColumn("cross", (u("m") < mu) & F.lit(k > 1))
    other = F.pmod(F.col("p") + 1 + F.floor(u("o") * (k - 1)), F.lit(k)).cast("int") if k > 1 else F.col("p")
    e = e.withColumn("q", F.when(F.col("cross"), other).otherwise(F.col("p")))
    within = lambda c, name: F.floor(u(name) * F.get(size, F.col(c)))
    e = e.withColumn("x", within("p", "s")).withColumn("y", within("q", "t"))
    y = F.when((F.col("p") == F.col("q")) & (F.col("x") == F.col("y")), F.pmod(F.col("y") + 1, F.get(size, F.col("q")))).otherwise(F.col("y"))
    e = e.select((F.get(start, F.col("p")) + F.col("x")).cast("long").alias("src"), (F.get(start, F.col("q")) + y).cast("long").alias("dst"))
    truth = spark.range(n).select(F.col("id").alias("v"), F.size(F.filter(F.array(*map(F.lit, starts[1:])), lambda s: s <= F.col("id"))).cast("long").alias("b"))
    return e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), truth


def corpus_plan(spark: SparkSession, scales: list[tuple[int, int]], communities: list[int], count: int) -> DataFrame:
    """(vertices, edges, communities, replica): scales x communities x replicas."""
    s = spark.createDataFrame(scales, "vertices long, edges long")
    return s.withColumn("communities", F.explode(F.array(*map(F.lit, communities)))).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def latin_hypercube(count: int, dimensions: int, seed: int = 0) -> np.ndarray:
    """count points of [0, 1)^dimensions, one in each of the count slices of every dimension."""
    rng = np.random.default_rng(seed)
    return (np.stack([rng.permutation(count) for _ in range(dimensions)], axis=1) + rng.random((count, dimensions))) / count


def close_triangles(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """edges with a share of them turned to close a wedge: (a, b) becomes (a, c) for a neighbour c of b other than a, drawn by hash.

    Neighbours are numbered, so an edge meets the two that its draw names and not all of a hub's.  An edge whose end leads nowhere else
    stays.
    """
    ranked = global_rank(edges.select("src", "dst").distinct(), [F.asc("src"), F.asc("dst")], "at")
    first = ranked.groupBy("src").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranked = ranked.select("at", F.col("dst").alias("c"))
    e = checkpoint(edges.withColumn("turn", hash_uniform(f"{seed}r", F.col("src"), F.col("dst")) < share))
    k = F.floor(hash_uniform(f"{seed}c", F.col("src"), F.col("dst")) * F.col("n"))
    two = e.where("turn").join(first.withColumnRenamed("src", "dst"), "dst").select("src", "dst", "first", "n", k.alias("k"))
    two = two.select("src", "dst", F.posexplode(F.array(F.col("first") + F.col("k"), F.col("first") + (F.col("k") + 1) % F.col("n"))).alias("turn", "at"))
    new = two.join(ranked, "at").where("c <> src").groupBy("src", "dst").agg(F.min_by("c", "turn").alias("c"))
    out = e.join(new, ["src", "dst"], "left").select("src", F.coalesce("c", "dst").alias("dst"), "w")
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))
