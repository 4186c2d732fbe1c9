"""Vertex samplers, orderings, load balance, and extension of a sample's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform
from .graph import checkpoint, global_rank, neighbors, range_parts, vertex_degree


def degree_product_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, product): edges with the product of their ends' degrees; order by product desc, src, dst."""
    d = checkpoint(vertex_degree(edges, vertices))
    e = edges.join(d.select(F.col("v").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("v").alias("dst"), F.col("degree").alias("b")), "dst")
    return e.select("src", "dst", (F.col("a") * F.col("b")).alias("product"))


def high_influence_vertices(edges: DataFrame, vertices: DataFrame, share: float = 0.1) -> DataFrame:
    """(v): ends of the edges with the largest degree product, edge by edge until at least floor(share * V) vertices are met."""
    by = [F.desc("product"), F.asc("src"), F.asc("dst")]
    ranked = global_rank(degree_product_edges(edges, vertices), by)
    first = ranked.select(F.explode(F.array("src", "dst")).alias("v"), "rank").groupBy("v").agg(F.min("rank").alias("first"))
    order = global_rank(first, [F.asc("first"), F.asc("v")], "place")
    target = vertices.agg(F.floor(F.count("*") * share).alias("target"))
    # the edge that reaches the target still adds both of its ends
    last = order.crossJoin(F.broadcast(target)).where("place = target").select(F.col("first").alias("last"))
    return order.crossJoin(F.broadcast(last)).where("first <= last").select("v")


def top_degree(edges: DataFrame, vertices: DataFrame, share: float) -> DataFrame:
    """(v, place): the floor(share * V) vertices of highest degree; ties by id; place from 1."""
    ranked = global_rank(vertex_degree(edges, vertices), [F.desc("degree"), F.asc("v")], "place")
    n = vertices.agg(F.floor(F.count("*") * share).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where("place <= n").select("v", F.col("place").cast("long").alias("place"))


def sample_random(vertices: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(v): the floor(share * V) vertices with the least hash."""
    ranked = global_rank(vertices.withColumn("u", hash_uniform(seed, F.col("v"))), [F.asc("u"), F.asc("v")], "place")
    n = vertices.agg(F.floor(F.count("*") * share).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where("place <= n").select("v")


def round_robin(vertices: DataFrame, parts: int, part: int) -> DataFrame:
    return vertices.where(F.pmod("v", F.lit(parts)) == part)


def detach(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v): vertices of degree over 1."""
    return vertex_degree(edges, vertices).where("degree > 1").select("v")


def snowball(edges: DataFrame, vertices: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(v, layer): breadth-first layers from one seed until floor(share * V) vertices; the last layer is cut by hash.

    Where a component ends early, the unvisited vertices of least hash start anew: one, then two, four and so on at each further end, so
    that many small components take few rounds.
    """
    target = int(vertices.count() * share)
    nbr = checkpoint(neighbors(edges).where("v <> nbr").select("v", "nbr").distinct())
    order = vertices.withColumn("u", hash_uniform(seed, F.col("v")))
    found = checkpoint(order.orderBy("u", "v").limit(min(1, target)).select("v", F.lit(0).alias("layer")))
    have = found.count()
    layer, seeds = 0, 1
    while have < target:
        layer += 1
        front = found.where(F.col("layer") == layer - 1).join(nbr, "v").select(F.col("nbr").alias("v")).distinct().join(found, "v", "left_anti")
        front = checkpoint(front.withColumn("u", hash_uniform(seed, F.col("v"))))
        if front.isEmpty():
            front = order.join(found, "v", "left_anti").orderBy("u", "v").limit(seeds)
            seeds *= 2
        new = checkpoint(front.orderBy("u", "v").limit(target - have).select("v", F.lit(layer).alias("layer")))
        n = new.count()
        if not n:  # no vertex is left
            break
        have += n
        found = checkpoint(found.union(new))
    return found


def expansion_snowball(edges: DataFrame, vertices: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(v): as snowball, each round adding the half of the frontier with the most neighbours outside the sample."""
    target = int(vertices.count() * share)
    nbr = checkpoint(neighbors(edges).where("v <> nbr").select("v", "nbr").distinct())
    found = checkpoint(vertices.withColumn("u", hash_uniform(seed, F.col("v"))).orderBy("u", "v").limit(min(1, target)).select("v"))
    have = found.count()
    while have < target:
        front = found.join(nbr, "v").select(F.col("nbr").alias("v")).distinct().join(found, "v", "left_anti")
        gain = front.join(nbr, "v").join(found.select(F.col("v").alias("nbr")), "nbr", "left_anti").groupBy("v").agg(F.count("*").alias("gain"))
        front = checkpoint(front.join(gain, "v", "left").select("v", F.coalesce("gain", F.lit(0)).alias("gain")))
        n = front.count()
        if not n:
            front, n = vertices.join(found, "v", "left_anti").withColumn("gain", F.lit(0)), 1
        new = checkpoint(front.orderBy(F.desc("gain"), "v").limit(min(target - have, (n + 1) // 2)).select("v"))
        have += new.count()
        found = checkpoint(found.union(new))
    return found


def degree_product_snowball(edges: DataFrame, vertices: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(v): as snowball, each round adding the ends of the best half of the frontier's edges by the product of their ends' degrees."""
    target = int(vertices.count() * share)
    d = checkpoint(vertex_degree(edges, vertices))
    nbr = neighbors(edges).where("v <> nbr").select("v", "nbr").distinct()
    at = lambda key, name: d.select(F.col("v").alias(key), F.col("degree").alias(name))
    nbr = checkpoint(nbr.join(at("v", "p"), "v").join(at("nbr", "q"), "nbr").select("v", "nbr", (F.col("p") * F.col("q")).alias("product")))
    order = vertices.withColumn("u", hash_uniform(seed, F.col("v")))
    found = checkpoint(order.orderBy("u", "v").limit(min(1, target)).select("v"))
    have, seeds = found.count(), 1
    while have < target:
        front = found.join(nbr, "v").groupBy(F.col("nbr").alias("v")).agg(F.max("product").alias("product")).join(found, "v", "left_anti")
        front = checkpoint(front)
        n = front.count()
        if n:
            new = front.orderBy(F.desc("product"), "v").limit(min(target - have, (n + 1) // 2)).select("v")
        else:
            new = order.join(found, "v", "left_anti").orderBy("u", "v").limit(min(target - have, seeds)).select("v")
            seeds *= 2
        new = checkpoint(new)
        got = new.count()
        if not got:
            break
        have += got
        found = checkpoint(found.union(new))
    return found


def majority_round(edges: DataFrame, assign: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, b) of unassigned vertices with an assigned neighbour: the block with most weight to it, the smallest of equals."""
    near = neighbors(edges).where("v <> nbr").join(vertices, "v", "left_semi").join(assign, "v", "left_anti")
    votes = near.join(assign.select(F.col("v").alias("nbr"), "b"), "nbr").groupBy("v", "b").agg(F.sum("w").alias("w"))
    return votes.groupBy("v").agg(F.max(F.struct("w", (-F.col("b")).alias("minus"))).alias("x")).select("v", (-F.col("x.minus")).alias("b"))


def extend(edges: DataFrame, assign: DataFrame, vertices: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """(v, b) of all vertices: synchronous majority rounds until nothing changes; the rest, that no path reaches, by hash."""
    assign = checkpoint(assign.select("v", "b"))
    while True:
        new = checkpoint(majority_round(edges, assign, vertices))
        if new.isEmpty():
            break
        assign = checkpoint(assign.union(new))
    rest = vertices.join(assign, "v", "left_anti").select("v", F.floor(hash_uniform(seed, F.col("v")) * blocks).cast("long").alias("b"))
    return assign.union(rest)


def reattach(edges: DataFrame, assign: DataFrame, vertices: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """(v, b): detached vertices take their single neighbour's block, else a block by hash."""
    return assign.select("v", "b").union(_rest(edges, assign, vertices, blocks, seed))


def _rest(edges: DataFrame, assign: DataFrame, vertices: DataFrame, blocks: int, seed: int) -> DataFrame:
    got = majority_round(edges, assign, vertices)
    return vertices.join(assign, "v", "left_anti").join(got, "v", "left").select("v", F.coalesce("b", F.floor(hash_uniform(seed, F.col("v")) * blocks).cast("long")).alias("b"))


def serpentine(ranked: DataFrame, threads: int) -> DataFrame:
    """ranked with ``thread``: places 0.. are dealt forth and back over the threads."""
    i = F.pmod(F.col("place") - 1, F.lit(2 * threads))
    return ranked.withColumn("thread", F.when(i >= threads, 2 * threads - 1 - i).otherwise(i).cast("long"))


def contiguous(loads: DataFrame, order: str, load: str, threads: int) -> DataFrame:
    """loads with ``thread``: consecutive rows share a thread while their running load is within its share of the total."""
    parts = range_parts(loads, [F.asc(order)], F.col(load))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(load).over(w), F.lit(0))
    out = parts.crossJoin(F.broadcast(loads.agg(F.sum(load).alias("_total"))))
    return out.withColumn("thread", F.least(F.floor(before * threads / F.col("_total")), F.lit(threads - 1)).cast("long")).drop("_part", "_before", "_total")


def early_stop(profile: DataFrame, threshold: float, run: str = "run", iteration: str = "iteration", delta: str = "delta", start: str = "start_mdl") -> DataFrame:
    """profile with ``average`` (minus the mean change of the last three iterations) and ``stop``."""
    w = Window.partitionBy(run).orderBy(iteration)
    mean: Column = -F.sum(delta).over(w.rowsBetween(-2, 0)) / 3
    stop = (F.col(delta) == 0) | ((F.col(iteration) >= 3) & (F.col("average") < threshold * F.col(start)))
    return profile.withColumn("average", mean).withColumn("stop", stop)
