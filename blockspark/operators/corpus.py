"""A corpus of planted graphs made in one job: settings, communities, weights, edges, closed triangles, metrics, choice and files.

Every step has all graphs' rows in one plan with the graph as a column, so thousands of small graphs cost as many jobs as one, and a
large one among them is spread over the tasks like any other.  All draws are hash uniforms of names and numbers: a graph doesn't depend
on partitioning, and a lost executor's part is made again alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform
from ..sources import staged
from . import tuning
from .candidates import graph_metrics
from .generate import ALPHA, HIGH_SHARE, HIGH_WEIGHT, MODES, PAIRS, SIGMA, draw_from, stretches
from .graph import checkpoint, global_rank, range_parts

#: Ranges of the settings, and the metrics that a corpus should cover; fixed values.
RANGES = {"mu": (0.02, 0.90), "imbalance": (0.0, 1.0), "clustering": (0.0, 1.0)}
COVERED = ["actual_mu", "degree_std", "degree_p25", "degree_p50", "degree_p75", "degree_max", "avg_clustering", "clustering_std", "clustering_p25", "clustering_p50", "clustering_p75", "assortativity", "largest_cc_fraction"]
STRATUM = ("nodes", "edges", "communities")


def numbered(df: DataFrame, count: Column, name: str, *keys: str, chunk: int = 1 << 14) -> DataFrame:
    """Each row of df ``count`` times, numbered from 0 in ``name``; ``keys`` tell rows apart.

    Numbers come in chunks that are put over all tasks, so that no row's numbers are one array or one task.
    """
    x = df.withColumn("__n", count.cast("long")).where("__n > 0")
    x = x.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk)))).repartition(*keys, "__k")
    start = F.col("__k") * chunk
    return x.withColumn(name, F.explode(F.sequence(start, F.least(start + chunk, F.col("__n")) - 1))).drop("__n", "__k")


def _balanced(options: tuple[str, ...], seed: object, name: str, place: Column, *stratum: Column) -> Column:
    """Each run of len(options) places takes every option once, in an order of its own."""
    m = len(options)
    block, slot = F.floor(place / m), F.pmod(place, F.lit(m))
    key = lambda j: F.struct(hash_uniform(f"{seed}|{name}", *stratum, block, j), j.cast("long"))
    before = sum(((key(F.lit(j)) < key(slot)).cast("int") for j in range(m)), F.lit(0))
    return F.get(F.array(*map(F.lit, options)), before)


def planned(graphs: DataFrame, seed: object = 0, mode: str | None = None, mu: float | None = None) -> DataFrame:
    """graphs(graph, nodes, edges, communities) with the settings ``mu``, ``imbalance``, ``clustering``, ``mode``, ``pairs``.

    Graphs of one size are a stratum.  In it each number's range is cut into as many slices as there are graphs, and each slice has one
    graph; of modes, and of pairs, each run of graphs has all once.  ``mode`` and ``mu`` fix a setting for all.
    """
    stratum = [F.col(c) for c in STRATUM]
    x = global_rank(graphs, [*stratum, F.col("graph")], "__at")
    groups = x.groupBy(*STRATUM).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    x = x.join(groups, list(STRATUM))
    for name, (low, high) in RANGES.items():
        x = global_rank(x.withColumn("__u", hash_uniform(f"{seed}|{name}", F.col("graph"))), [*stratum, F.col("__u"), F.col("graph")], "__slice")
        inside = hash_uniform(f"{seed}|{name}|in", F.col("graph"))
        x = x.withColumn(name, low + (high - low) * (F.col("__slice") - F.col("__first") + inside) / F.col("__n")).drop("__u", "__slice")
    place = F.col("__at") - F.col("__first")
    x = x.withColumn("mode", F.lit(mode) if mode else _balanced(MODES, seed, "mode", place, *stratum)).withColumn("pairs", _balanced(PAIRS, seed, "pairs", place, *stratum))
    return (x if mu is None else x.withColumn("mu", F.lit(float(mu)))).drop("__at", "__first", "__n")


#: Tries at a gamma variate, each good in over 95 % of cases; 16 failures in a row (less than 1e-20) give the middle of the distribution.
_TRIES = 16


def gamma(df: DataFrame, shape: Column, name: str, seed: object, *keys: str) -> DataFrame:
    """df with ``name``: a gamma variate of the shape (over 0) and scale 1, drawn by the keys, which tell rows apart.

    The first good one of some tries by squeezed normal cubes, each a row; below a shape of 1 from the next with a power.
    """
    key = [F.col(k) for k in keys]
    u = lambda name, *more: hash_uniform(f"{seed}|{name}", *key, *more)
    x = df.withColumn("__s", shape.cast("double")).withColumn("__d", F.when(F.col("__s") < 1, F.col("__s") + 1).otherwise(F.col("__s")) - 1 / 3)
    x = x.withColumn("__t", F.explode(F.sequence(F.lit(1), F.lit(_TRIES))))
    d, z, cube = F.col("__d"), F.col("__z"), F.col("__c")
    x = x.withColumn("__z", F.sqrt(-2 * F.log(1 - u("r", F.col("__t")))) * F.cos(2 * math.pi * u("a", F.col("__t"))))
    x = x.withColumn("__c", F.pow(1 + z / F.sqrt(9 * d), F.lit(3)))
    good = (cube > 0) & (F.log(1 - u("t", F.col("__t"))) < z * z / 2 + d - d * cube + d * F.log(cube))
    x = x.groupBy(*df.columns, "__s", "__d").agg(F.min_by("__c", F.when(good, F.col("__t"))).alias("__c"))
    out = F.coalesce(cube, F.lit(1.0)) * d * F.when(F.col("__s") < 1, F.pow(1 - u("p"), 1 / F.col("__s"))).otherwise(1.0)
    return x.withColumn(name, out).drop("__s", "__d", "__c")


def communities(plan: DataFrame, seed: object = 0) -> DataFrame:
    """(graph, b, size) for plan(graph, nodes, communities, imbalance): sizes of at least 2 that add up to the graph's nodes.

    Up to an imbalance of 0.05 all are alike but for the last, which takes what is left over; beyond it shares are Dirichlet with
    max(0.2, 2 - imbalance).  Fewer than two nodes a community are an error.
    """
    n, k, b = F.col("nodes"), F.col("communities"), F.col("b")
    enough = F.when((n >= 2 * k) & (k > 0), k).otherwise(F.raise_error(F.concat(F.lit("two nodes a community at least: "), F.col("graph").cast("string"))).cast("long"))
    x = numbered(plan.select("graph", "nodes", "communities", "imbalance"), enough, "b", "graph")
    x = checkpoint(gamma(x, F.greatest(F.lit(0.2), 2 - F.col("imbalance")), "g", f"{seed}|size", "graph", "b"))
    x = x.join(x.groupBy("graph").agg(F.sum("g").alias("all")), "graph")
    x = checkpoint(x.withColumn("size", (2 + F.floor(F.col("g") / F.col("all") * (n - 2 * k))).cast("long")))
    x = x.join(x.groupBy("graph").agg(F.sum("size").alias("total")), "graph")
    alike = F.floor(n / k) + F.when(b == k - 1, n - k * F.floor(n / k)).otherwise(0)
    return x.select("graph", "b", F.when(F.col("imbalance") <= 0.05, alike).otherwise(F.col("size") + (b < n - F.col("total")).cast("long")).cast("long").alias("size"))


def vertices(plan: DataFrame, seed: object = 0) -> DataFrame:
    """(graph, v, b, weight) for plan(graph, nodes, communities, imbalance, mode): v from 0 on, community by community.

    Weights as in ``generate.vertex_weights``, each graph with parameters of its own from the same ranges.
    """
    c = range_parts(communities(plan, seed), [F.asc("graph"), F.asc("b")], F.col("size"))
    run = Window.partitionBy("_part").orderBy("graph", "b").rowsBetween(Window.unboundedPreceding, -1)
    c = checkpoint(c.select("graph", "b", "size", (F.col("_before") + F.coalesce(F.sum("size").over(run), F.lit(0))).alias("start")))
    c = c.join(c.groupBy("graph").agg(F.min("start").alias("first")), "graph").join(plan.select("graph", "mode", "nodes"), "graph")
    v = checkpoint(numbered(c, F.col("size"), "j", "graph", "b").select("graph", (F.col("start") - F.col("first") + F.col("j")).alias("v"), "b", "mode", "nodes"))
    own = lambda name, r: r[0] + (r[1] - r[0]) * hash_uniform(f"{seed}|{name}", F.col("graph"))
    u = lambda name: hash_uniform(f"{seed}|{name}", F.col("graph"), F.col("v"))
    z = F.sqrt(-2 * F.log(1 - u("r"))) * F.cos(2 * math.pi * u("a"))
    two = global_rank(v.where("mode = 'bimodal'").withColumn("__u", u("h")), [F.asc("graph"), F.asc("__u"), F.asc("v")], "__at")
    two = two.join(two.groupBy("graph").agg(F.min("__at").alias("__first")), "graph")
    high = F.col("__at") - F.col("__first") < F.greatest(F.lit(1).cast("long"), F.floor(own("share", HIGH_SHARE) * F.col("nodes")))
    two = two.withColumn("weight", F.when(high, own("high", HIGH_WEIGHT)).otherwise(1.0))
    shaped = F.when(F.col("mode") == "lognormal", F.exp(own("sigma", SIGMA) * z)).when(F.col("mode") == "powerlaw", F.pow(1 - u("x"), -1 / own("alpha", ALPHA))).otherwise(1.0)
    columns = ["graph", "v", "b", "weight"]
    return v.where("mode <> 'bimodal'").withColumn("weight", shaped).select(columns).union(two.select(columns))


def _with_ids(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices with ``id``, graphs(graph, first, nodes)): ids number all graphs' vertices through, each graph's from its first."""
    v = checkpoint(global_rank(vertices, [F.asc("graph"), F.asc("v")], "id"))
    return v, checkpoint(v.groupBy("graph").agg(F.min("id").alias("first"), F.count("*").alias("nodes")))


def _named(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(graph, src, dst) of pairs of ids."""
    at = lambda c: v.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    x = pairs.join(at("src"), "src").join(at("dst"), "dst")
    return x.select("graph", F.least("v_src", "v_dst").alias("src"), F.greatest("v_src", "v_dst").alias("dst"))


def _first_new(drawn: DataFrame, have: list[DataFrame], need: DataFrame) -> DataFrame:
    """Of drawn(graph, kind, i, a, b) the pairs that ``have`` doesn't hold, each once: the first by i, as many as need(graph, kind, need)."""
    new = drawn.where("a <> b").select("graph", "kind", "i", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    new = new.groupBy("graph", "kind", "src", "dst").agg(F.min("i").alias("i"))
    if have:
        new = new.join(reduce(DataFrame.union, have).select("src", "dst"), ["src", "dst"], "left_anti")
    new = global_rank(new, [F.asc("graph"), F.asc("kind"), F.asc("i")], "at")
    start = new.groupBy("graph", "kind").agg(F.min("at").alias("start")).join(need, ["graph", "kind"])
    return checkpoint(new.join(start, ["graph", "kind"]).where("at - start < need").select("graph", "kind", "src", "dst"))


def _with_part(have: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """The pairs so far in two tables: those of the first round, which are nearly all, and the rest, written anew with each round."""
    return [*have, new] if len(have) < 2 else [have[0], checkpoint(have[1].union(new))]


def edges(vertices: DataFrame, plan: DataFrame, seed: object = 0) -> DataFrame:
    """(graph, src, dst), src < dst, for vertices(graph, v, b, weight) and plan(graph, edges, mu, pairs).

    Each graph has exactly its number of different edges, floor(edges * mu + 1/2) of them between communities.  Those inside a community
    (any one alike) and between two (any two alike) are drawn for all graphs in rounds of which only new pairs stay; ends by weight;
    ``positive`` pairs join one half of a community by weight, ``negative`` ones both.  Where a kind of a graph runs dry (three rounds
    with less than a fiftieth of what is missing), pairs of any two vertices fill up.  More edges than pairs are an error.
    """
    v, graphs = _with_ids(vertices.select("graph", "v", "b", "weight"))
    graphs = checkpoint(graphs.join(plan.select("graph", F.col("edges").cast("long").alias("edges"), "mu", "pairs"), "graph").withColumn("room", F.floor(F.col("nodes") * (F.col("nodes") - 1) / 2)))
    for r in graphs.where("edges > room").limit(1).collect():
        raise ValueError(f"graph {r['graph']} has {r['room']} pairs, not {r['edges']}")
    by_weight = checkpoint(global_rank(v, [F.asc("graph"), F.asc("b"), F.asc("weight"), F.asc("id")], "at"))
    c = global_rank(by_weight.groupBy("graph", "b").agg(F.min("at").alias("lightest"), F.count("*").alias("size")), [F.asc("graph"), F.asc("b")], "c")
    c = checkpoint(c)
    c = checkpoint(c.join(c.groupBy("graph").agg(F.min("c").alias("c0"), F.count("*").alias("number")), "graph").withColumn("k", F.col("c") - F.col("c0")))
    half = F.when(F.col("at") - F.col("lightest") < F.floor(F.col("size") / 2), 1).otherwise(2)
    w = by_weight.join(c, ["graph", "b"]).select("id", "weight", F.explode(F.array(F.col("c") * 3, F.col("c") * 3 + half)).alias("group"))
    line = stretches(w.select("group", F.col("id").alias("v"), "weight"))
    at = c.select("graph", "k", "c", "size")
    at = F.broadcast(at) if at.count() <= 1 << 16 else at
    between = F.when(F.col("number") > 1, F.floor(F.col("edges") * F.col("mu") + 0.5)).otherwise(0).cast("long")
    kinds = F.array(F.struct(F.lit("within").alias("kind"), (F.col("edges") - between).alias("want")), F.struct(F.lit("between").alias("kind"), between.alias("want")))
    state = graphs.join(c.groupBy("graph").agg(F.first("number").alias("number")), "graph").select("graph", "number", "pairs", F.inline(kinds))
    state = checkpoint(state.select("*", F.lit(0).cast("long").alias("got"), F.lit(0).alias("idle")))
    have: list[DataFrame] = []
    turn = 0
    while not (left := state.where("got < want and idle < 3")).isEmpty():
        turn += 1
        u = lambda name: hash_uniform(f"{seed}|{turn}|{name}", F.col("graph"), F.col("kind"), F.col("i"))  # noqa: B023, E731
        need = left.select("graph", "kind", (F.col("want") - F.col("got")).alias("need"))
        e = numbered(left.select("graph", "number", "pairs", "kind", (F.col("want") - F.col("got")).alias("need")), F.col("need") + F.floor(F.col("need") / 2) + 128, "i", "graph", "kind")
        e = e.withColumn("k", F.floor(u("c") * F.col("number")))
        e = e.withColumn("k2", F.when(F.col("kind") == "between", F.pmod(F.col("k") + 1 + F.floor(u("d") * (F.col("number") - 1)), F.col("number"))).otherwise(F.col("k")))
        e = e.join(at, ["graph", "k"]).join(at.select("graph", F.col("k").alias("k2"), F.col("c").alias("c2")), ["graph", "k2"])
        low, upper = F.floor(F.col("size") / 2), u("h") < 0.5
        one = F.when(F.when(upper, F.col("size") - low).otherwise(low) >= 2, F.when(upper, 2).otherwise(1)).otherwise(0)
        inside = F.col("kind") == "within"
        split = inside & (F.col("pairs") == "negative") & (F.col("size") >= 2)
        side = lambda h: F.when(inside & (F.col("pairs") == "positive"), one).when(split, h).otherwise(0)  # noqa: B023, E731
        ends = F.array(F.struct(F.lit("a").alias("end"), (F.col("c") * 3 + side(2)).alias("group")), F.struct(F.lit("b").alias("end"), (F.col("c2") * 3 + side(1)).alias("group")))
        d = e.select("graph", "kind", "i", F.inline(ends))
        d = draw_from(line, d.withColumn("u", hash_uniform(f"{seed}|{turn}|end", F.col("graph"), F.col("kind"), F.col("i"), F.col("end"))))
        d = d.groupBy("graph", "kind", "i").agg(*[F.max(F.when(F.col("end") == x, F.col("v"))).alias(x) for x in ("a", "b")])
        new = _first_new(d, have, need)
        have = _with_part(have, new)
        gain = new.groupBy("graph", "kind").agg(F.count("*").alias("gain"))
        missing, gained = F.col("want") - F.col("got"), F.coalesce("gain", F.lit(0))
        idle = F.when(gained < F.greatest(F.lit(1).cast("long"), F.floor(missing / 50)), F.col("idle") + 1).otherwise(0)
        state = checkpoint(state.join(gain, ["graph", "kind"], "left").select("graph", "number", "pairs", "kind", "want", (F.col("got") + gained).alias("got"), idle.alias("idle")))
    got = state.groupBy("graph").agg(F.sum("got").alias("got"))
    state = checkpoint(graphs.join(got, "graph").select("graph", "first", "nodes", "edges", "room", "got"))
    while not (left := state.where("got < edges")).isEmpty():
        turn += 1
        need = left.select("graph", F.lit("any").alias("kind"), (F.col("edges") - F.col("got")).alias("need"))
        count = F.floor((F.col("edges") - F.col("got")) * F.col("room") / (F.col("room") - F.col("got")) * 1.5) + 128
        e = numbered(left, count, "i", "graph")
        end = lambda name: F.col("first") + F.floor(hash_uniform(f"{seed}|{turn}|{name}", F.col("graph"), F.col("i")) * F.col("nodes"))  # noqa: B023, E731
        new = _first_new(e.select("graph", F.lit("any").alias("kind"), "i", end("a").alias("a"), end("b").alias("b")), have, need)
        have = _with_part(have, new)
        gain = new.groupBy("graph").agg(F.count("*").alias("gain"))
        state = checkpoint(state.join(gain, "graph", "left").select("graph", "first", "nodes", "edges", "room", (F.col("got") + F.coalesce("gain", F.lit(0))).alias("got")))
    if not have:
        return v.limit(0).select("graph", F.col("v").alias("src"), F.col("v").alias("dst"))
    return checkpoint(_named(reduce(DataFrame.union, have), v))


def closed(edges: DataFrame, vertices: DataFrame, plan: DataFrame, seed: object = 0, rounds: int = 4) -> DataFrame:
    """edges(graph, src, dst) with wedges closed, plan(graph, clustering) saying how many tries: 2 * clustering for an edge.

    A try takes a vertex of the graph and two of its neighbours; if they aren't joined they will be, and another edge, by lot, goes, so a
    graph keeps its number of edges.  Tries are made in rounds, those of one against the same state; at least two, so that a round takes
    no more edges than there are.
    """
    if rounds < 2:
        raise ValueError("two rounds at least")
    v, graphs = _with_ids(vertices.select("graph", "v"))
    at = lambda c: v.select("graph", F.col("v").alias(c), F.col("id").alias(f"i_{c}"))
    e = edges.join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"]).select("graph", F.least("i_src", "i_dst").alias("src"), F.greatest("i_src", "i_dst").alias("dst"))
    e = checkpoint(e)
    tries = F.floor(2 * F.col("clustering") * F.col("m") / rounds)
    todo = checkpoint(graphs.join(plan.select("graph", "clustering"), "graph").join(e.groupBy("graph").agg(F.count("*").alias("m")), "graph").select("graph", "first", "nodes", tries.alias("tries")))
    for turn in range(rounds):
        u = lambda name, *c: hash_uniform(f"{seed}|close|{turn}|{name}", *(map(F.col, c or ("graph", "i"))))  # noqa: B023, E731
        near = global_rank(e.select(F.inline(F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y"))))), [F.asc("x"), F.asc("y")], "at")
        near = checkpoint(near)
        t = numbered(todo, F.col("tries"), "i", "graph").select("graph", "i", (F.col("first") + F.floor(u("v") * F.col("nodes"))).alias("x"))
        t = t.join(near.groupBy("x").agg(F.min("at").alias("from"), F.count("*").alias("d")), "x").where("d >= 2")
        t = t.withColumn("k", F.floor(u("k") * F.col("d"))).withColumn("k2", F.pmod(F.col("k") + 1 + F.floor(u("l") * (F.col("d") - 1)), F.col("d")))
        t = t.select("graph", "i", F.explode(F.array(F.col("from") + F.col("k"), F.col("from") + F.col("k2"))).alias("at")).join(near.select("at", "y"), "at")
        t = t.groupBy("graph", "i").agg(F.min("y").alias("src"), F.max("y").alias("dst"))
        new = checkpoint(t.select("graph", "src", "dst").distinct().join(e.select("src", "dst"), ["src", "dst"], "left_anti").select("graph", "src", "dst"))
        lot = global_rank(e.withColumn("u", u("go", "src", "dst")), [F.asc("graph"), F.asc("u"), F.asc("src"), F.asc("dst")], "at")
        start = lot.groupBy("graph").agg(F.min("at").alias("start")).join(new.groupBy("graph").agg(F.count("*").alias("go")), "graph", "left")
        stay = lot.join(start, "graph").where("at - start >= coalesce(go, 0)")
        e = checkpoint(stay.select("graph", "src", "dst").union(new))
    return checkpoint(_named(e, v))


def corpus(graphs: DataFrame, seed: object = 0, mode: str | None = None, mu: float | None = None, rounds: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, vertices, edges) of graphs(graph, nodes, edges, communities), all in one job."""
    plan = checkpoint(planned(graphs, seed, mode, mu))
    v = checkpoint(vertices(plan, seed))
    return plan, v, closed(edges(v, plan, seed), v, plan, seed, rounds)


def coverage(metrics: DataFrame, columns: list[str] = COVERED, bins: int = 10) -> DataFrame:
    """One row, as the report is written: the scores, the share of bins that each metric fills, the bins and the metrics."""
    x = tuning.minmax(metrics.select(columns), columns)
    filled = x.agg(*[(F.count_distinct(F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))) / bins).alias(c) for c in columns])
    both = filled.select(F.struct(*columns).alias("marginal_coverage")).crossJoin(F.broadcast(tuning.coverage(metrics, columns, bins)))  # one row each
    return both.select(F.col("overall").alias("overall_coverage_score"), "marginal_coverage", F.col("joint").alias("joint_coverage"), F.col("entropy").alias("entropy_score"), F.lit(bins).alias("bins"), F.array(*map(F.lit, columns)).alias("coverage_metrics"))


def chosen(metrics: DataFrame, count: int, columns: list[str] = COVERED) -> DataFrame:
    """The ``count`` graphs that lie farthest apart, with ``output_id`` from 0 in the order of choice; all, by graph, if there are no more."""
    if metrics.count() <= count:
        return global_rank(metrics, [F.asc("graph")], "__at").withColumn("output_id", F.col("__at") - 1).drop("__at")
    return metrics.join(tuning.farthest_points(metrics, "graph", columns, count).select("graph", (F.col("place") - 1).cast("long").alias("output_id")), "graph")


def write(parts: tuple[DataFrame, DataFrame, DataFrame], folder: str, count: int, bins: int = 10) -> DataFrame:
    """Writes the corpus and returns the metrics of the graphs chosen.

    ``edges`` and ``truth`` hold a folder ``dataset=...`` a chosen graph, tab-separated, vertices from 1 on; ``candidates`` and ``selected``
    the metrics with the settings, as CSV with a header; ``coverage`` the report, as JSON.  Each appears whole or not at all.
    """
    plan, v, e = parts
    m = checkpoint(graph_metrics(e, v).join(plan.select("graph", "edges", "communities", "nodes", *RANGES, "mode", "pairs"), "graph"))
    name = F.format_string("N%d_M%d_K%d_id%d", "nodes", "edges", "communities", "output_id")
    s = checkpoint(chosen(m, count).withColumn("dataset", name))
    of = s.select("graph", "dataset")
    lines = e.join(of, "graph").select("dataset", (F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), F.lit("1.0").alias("w"))
    truth = v.join(of, "graph").select("dataset", (F.col("v") + 1).alias("v"), "b")
    for df, where in ((lines, "edges"), (truth, "truth")):
        order = [c for c in df.columns if c != "w"]
        staged.whole(df.repartitionByRange(*order).sortWithinPartitions(*order), f"{folder}/{where}", by=["dataset"], sep="\t")
    staged.whole(m, f"{folder}/candidates", header=True)
    staged.whole(s, f"{folder}/selected", header=True)
    staged.whole(coverage(s, COVERED, bins), f"{folder}/coverage", form="json")
    return s
