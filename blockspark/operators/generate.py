"""Graphs of planted communities with a degree shape, a share of edges between communities and assortative pairs.

Everything is drawn by hash uniforms of names and numbers, so a graph is the same whatever the partitioning and executors.  Vertices,
weights and edges are rows throughout.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform
from .graph import checkpoint, global_rank, range_parts

MODES = ("uniform", "lognormal", "powerlaw", "bimodal")
PAIRS = ("neutral", "positive", "negative")

#: Ranges that a graph's own parameters are drawn from; fixed values.
SIGMA, ALPHA, HIGH_SHARE, HIGH_WEIGHT = (0.5, 1.5), (1.5, 3.0), (0.05, 0.25), (5.0, 20.0)


def _between(range_: tuple[float, float], seed: object, name: str) -> float:
    u = int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:8], 16) / 2**32
    return range_[0] + (range_[1] - range_[0]) * u


def parameters(mode: str, seed: object) -> dict[str, float]:
    """The parameters of a graph's weights: sigma, alpha, or the share and weight of high vertices."""
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    names = {"lognormal": {"sigma": SIGMA}, "powerlaw": {"alpha": ALPHA}, "bimodal": {"share": HIGH_SHARE, "weight": HIGH_WEIGHT}}.get(mode, {})
    return {k: _between(r, seed, k) for k, r in names.items()}


def vertex_weights(vertices: DataFrame, mode: str, seed: object = 0, **given: float) -> DataFrame:
    """vertices (v, ...) with ``weight``, not normalised; ``given`` parameters take the place of drawn ones.

    uniform: 1.  lognormal: exp(sigma z), z standard normal.  powerlaw: the inverse of 1 - x ** -alpha, x >= 1.  bimodal: the high weight
    for max(1, floor(share * vertices)) vertices of least hash, 1 for the others.
    """
    p = parameters(mode, seed) | given
    u = lambda name: hash_uniform(f"{seed}{name}", F.col("v"))
    if mode == "lognormal":
        z = F.sqrt(-2 * F.log(1 - u("r"))) * F.cos(2 * math.pi * u("a"))
        return vertices.withColumn("weight", F.exp(p["sigma"] * z))
    if mode == "powerlaw":
        return vertices.withColumn("weight", F.pow(1 - u("x"), F.lit(-1 / p["alpha"])))
    if mode == "bimodal":
        count = max(1, int(p["share"] * vertices.count()))
        ranked = global_rank(vertices.withColumn("__u", u("h")), [F.asc("__u"), F.asc("v")], "__at")
        return ranked.withColumn("weight", F.when(F.col("__at") <= count, p["weight"]).otherwise(1.0)).drop("__u", "__at")
    return vertices.withColumn("weight", F.lit(1.0))


def draw(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """draws(group, u, ...) with ``v``: a vertex of weights(group, v, weight) of the same group, in proportion to weight, by uniform u.

    Weights are summed in the order of group and vertex over a range partitioning, so each vertex has a stretch of one line and each
    group a stretch of its vertices.  Draws are points of that line; vertices and points are sorted together, and a point takes the last
    vertex that begins before it, in its own range or else in one before.  So no group, however large, meets its draws in one task.
    Draws of a group without weight get a null v; vertices without weight are never drawn.
    """
    return draw_from(stretches(weights), draws)


def stretches(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The line of weights(group, v, weight), for any number of draws: vertices with their place, groups with their ends."""
    w = range_parts(weights.where("weight > 0").select("group", "v", "weight"), [F.asc("group"), F.asc("v")], F.col("weight"))
    run = Window.partitionBy("_part").orderBy("group", "v").rowsBetween(Window.unboundedPreceding, -1)
    w = checkpoint(w.select("group", "v", "weight", (F.col("_before") + F.coalesce(F.sum("weight").over(run), F.lit(0.0))).alias("pos")))
    return w, w.groupBy("group").agg(F.min("pos").alias("__from"), F.sum("weight").alias("__all"), F.max("pos").alias("__last"))


def draw_from(prepared: tuple[DataFrame, DataFrame], draws: DataFrame) -> DataFrame:
    """What ``draw`` gives, from weights laid out by ``stretches``."""
    w, groups = prepared
    d = checkpoint(draws.withColumn("__id", F.monotonically_increasing_id()))
    # a sum's last digit can lead over the end: the group's last vertex is the last point
    x = d.join(groups, "group").select(F.least(F.col("__from") + F.col("u") * F.col("__all"), F.col("__last")).alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("v"), "__id")
    line = w.select("pos", F.lit(0).alias("kind"), F.col("v").cast("long").alias("v"), F.lit(None).cast("long").alias("__id")).union(x.select("pos", "kind", "v", "__id"))
    line = range_parts(line, [F.asc("pos"), F.asc("kind"), F.asc("v"), F.asc("__id")], F.lit(1)).drop("_before")
    line = checkpoint(line)
    up = Window.partitionBy("_part").orderBy("pos", "kind", "v", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = line.groupBy("_part").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("pos", "kind", "v"))).alias("__end"))
    carry = ends.select("_part", F.last("__end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))  # a row a partition
    hit = line.withColumn("__own", F.last("v", ignorenulls=True).over(up)).where("kind = 1").join(F.broadcast(carry), "_part")
    return d.join(hit.select("__id", F.coalesce("__own", "__carry").alias("v")), "__id", "left").drop("__id")


def halves(vertices: DataFrame) -> DataFrame:
    """vertices(v, b, weight) with ``half``: low for the lighter half of each community (rounded down), high for the others."""
    ranked = global_rank(vertices, [F.asc("b"), F.asc("weight"), F.asc("v")], "__at")
    groups = ranked.groupBy("b").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    low = F.col("__at") - F.col("__first") < F.floor(F.col("__n") / 2)
    return ranked.join(groups, "b").withColumn("half", F.when(low, "low").otherwise("high")).drop("__at", "__first", "__n")


def _groups(vertices: DataFrame, pairs: str) -> tuple[DataFrame, DataFrame]:
    """(weights(group, v, weight), communities(b, size)): a community is a group, and each of its halves if pairs are assortative."""
    v = halves(vertices) if pairs != "neutral" else vertices.withColumn("half", F.lit(None).cast("string"))
    v = checkpoint(v)
    whole = v.select(F.col("b").cast("string").alias("group"), "v", "weight")
    if pairs != "neutral":
        whole = whole.union(v.select(F.concat_ws("|", F.col("b").cast("string"), "half"), "v", "weight"))
    return checkpoint(whole), checkpoint(v.groupBy("b").agg(F.count("*").alias("size")))


def _ends(kind: str, count: int, seed: str, communities: DataFrame, number: int, pairs: str) -> DataFrame:
    """(i, gu, gv): the groups that ``count`` draws of an edge take their ends from, inside a community or between two."""
    spark = communities.sparkSession
    at = global_rank(communities, [F.asc("b")], "k").select((F.col("k") - 1).alias("k"), "b", "size")
    at = F.broadcast(at) if number <= 1 << 16 else at
    u = lambda name: hash_uniform(f"{seed}{name}", F.col("i"))
    e = spark.range(count).withColumnRenamed("id", "i").withColumn("k", F.floor(u("c") * number))
    if kind == "between":
        e = e.withColumn("k2", F.pmod(F.col("k") + 1 + F.floor(u("d") * (number - 1)), F.lit(number)))
        e = e.join(at.select("k", F.col("b").cast("string").alias("gu")), "k")
        return e.join(at.select(F.col("k").alias("k2"), F.col("b").cast("string").alias("gv")), "k2").select("i", "gu", "gv")
    e = e.join(at, "k")
    whole, half = F.col("b").cast("string"), lambda h: F.concat_ws("|", F.col("b").cast("string"), h)
    if pairs == "positive":  # both ends of one half, if it has two vertices
        high = u("h") < 0.5
        enough = F.when(high, F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)) >= 2
        group = F.when(enough, half(F.when(high, F.lit("high")).otherwise(F.lit("low")))).otherwise(whole)
        return e.select("i", group.alias("gu"), group.alias("gv"))
    if pairs == "negative":
        two = F.col("size") >= 2
        return e.select("i", F.when(two, half(F.lit("high"))).otherwise(whole).alias("gu"), F.when(two, half(F.lit("low"))).otherwise(whole).alias("gv"))
    return e.select("i", whole.alias("gu"), whole.alias("gv"))


def _fresh(drawn: DataFrame, have: DataFrame, need: int) -> DataFrame:
    """At most ``need`` of the pairs drawn(i, a, b), each once, that aren't in have(src, dst); the first by i."""
    new = drawn.where("a is not null and b is not null and a <> b").select("i", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    new = checkpoint(new.groupBy("src", "dst").agg(F.min("i").alias("i")).join(have, ["src", "dst"], "left_anti"))
    if new.count() <= need:
        return new.select("src", "dst")
    return global_rank(new, [F.asc("i")], "__at").where(F.col("__at") <= need).select("src", "dst")


def community_edges(vertices: DataFrame, edges: int, mu: float, pairs: str = "neutral", seed: object = 0) -> DataFrame:
    """(src, dst), src < dst: exactly ``edges`` different edges of vertices(v, b, weight), a share mu of them between communities.

    Edges inside a community (any one alike) and between two (any two alike) are drawn until there are as many as mu asks for, in rounds
    of hashed draws of which only new pairs stay.  Where a kind runs dry, the rest are pairs of any two vertices.  More edges than
    pairs are an error.
    """
    if pairs not in PAIRS:
        raise ValueError(f"{pairs} is none of {PAIRS}")
    n = vertices.count()
    if edges > n * (n - 1) // 2:
        raise ValueError(f"{n} vertices have {n * (n - 1) // 2} pairs, not {edges}")
    spark = vertices.sparkSession
    weights, communities = _groups(vertices.select("v", "b", "weight"), pairs)
    number = communities.count()
    have = spark.createDataFrame([], "src long, dst long")
    total = 0
    between = round(edges * mu) if number > 1 else 0
    for kind, want in (("within", edges - between), ("between", between)):
        need, idle, turn = want, 0, 0
        while need > 0 and idle < 3:
            turn += 1
            name = f"{seed}|{kind}|{turn}|"
            e = _ends(kind, need + need // 4 + 16, name, communities, number, pairs)
            for g, end in (("gu", "a"), ("gv", "b")):
                e = draw(weights, e.withColumn("group", F.col(g)).withColumn("u", hash_uniform(f"{name}{end}", F.col("i")))).drop("group", "u").withColumnRenamed("v", end)
            got = checkpoint(_fresh(e, have, need))
            have = checkpoint(have.union(got))
            now = have.count()
            idle = idle + 1 if now - total < max(1, need // 50) else 0
            need, total = need - (now - total), now
    turn = 0
    order = checkpoint(global_rank(vertices.select("v"), [F.asc("v")], "k")) if total < edges else None
    while total < edges:
        turn += 1
        room = n * (n - 1) // 2 - total
        count = int((edges - total) * (n * (n - 1) / 2) / room * 1.5) + 16
        u = lambda name: 1 + F.floor(hash_uniform(f"{seed}|any|{turn}{name}", F.col("i")) * n)  # noqa: B023, E731
        e = spark.range(count).withColumnRenamed("id", "i").select("i", u("a").alias("ka"), u("b").alias("kb"))
        e = e.join(order.select(F.col("k").alias("ka"), F.col("v").alias("a")), "ka").join(order.select(F.col("k").alias("kb"), F.col("v").alias("b")), "kb")
        have = checkpoint(have.union(_fresh(e, have, edges - total)))
        total = have.count()
    return have


def community_graph(spark: SparkSession, sizes: list[int], edges: int, mu: float, mode: str = "uniform", pairs: str = "neutral", seed: object = 0) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst), vertices(v, b, weight)) of communities of the given sizes."""
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    blocks = spark.createDataFrame([(k, a, n) for k, (a, n) in enumerate(zip(starts, sizes, strict=True))], "b long, start long, n long")
    v = blocks.select("b", F.explode(F.expr("sequence(start, start + n - 1)")).alias("v")).select("v", "b")
    v = checkpoint(vertex_weights(v, mode, seed))
    return community_edges(v, edges, mu, pairs, seed), v
