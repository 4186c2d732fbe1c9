"""Weighted directed graphs as DataFrames: edges(src, dst, w), vertices(v), assign(v, b).

An edge of weight w stands for w parallel unit edges; weights stay a column and are never expanded.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job in the folder named by spark.checkpoint.dir.

    A temporary folder is used only where that is unset and all runs on this machine (tests); else it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


#: Rows that a task sorts or sums, where their number is known beforehand.
TASK_ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about ``rows`` rows by the hash of keys in partitions of about TASK_ROWS; as it is if they fit one.

    So a task's memory doesn't grow with the table, whatever the number of shuffle partitions.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > 1 else df


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate on every row."""
    return df.crossJoin(F.broadcast(totals))  # one row by construction


def degrees(edges: DataFrame) -> DataFrame:
    """(v, k_out, k_in, loops): weighted degrees of every endpoint, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("w").alias("o"), F.lit(0.0).alias("i"), F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0).alias("l")), F.struct(F.col("dst").alias("v"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("l")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("o").alias("k_out"), F.sum("i").alias("k_in"), F.sum("l").alias("loops"))


def vertex_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, degree): out + in, a self loop once; 0 for vertices without edges."""
    d = degrees(edges)
    return vertices.join(d, "v", "left").select("v", F.coalesce(F.col("k_out") + F.col("k_in") - F.col("loops"), F.lit(0.0)).alias("degree"))


def islands(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices without an edge."""
    return vertices.join(vertex_set(edges), "v", "left_anti")


def vertex_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def neighbors(edges: DataFrame) -> DataFrame:
    """(v, nbr, w): each edge from both of its ends, a self loop twice."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("nbr"), "w"), F.struct(F.col("dst").alias("v"), F.col("src").alias("nbr"), "w"))).alias("e")).select("e.*")


def undirect(edges: DataFrame) -> DataFrame:
    """Every edge that isn't a self loop in both directions."""
    return edges.select("src", "dst", "w").unionAll(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def simple_pairs(edges: DataFrame) -> DataFrame:
    """(u, v) with u < v, once each: the undirected simple graph below."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedupe(edges: DataFrame, *order: str) -> DataFrame:
    """One row for each (src, dst): the weight that comes first by ``order``."""
    return edges.groupBy("src", "dst").agg(F.min_by("w", F.struct(*order)).alias("w"))


def weights_or_one(edges: DataFrame) -> DataFrame:
    """Weight 1 for all edges if any weight is null or all are 0."""
    flag = edges.agg(F.coalesce(F.bool_or(F.col("w").isNull()), F.lit(False)).alias("holes"), F.coalesce(F.bool_or(F.col("w") != 0), F.lit(False)).alias("some"))
    return with_totals(edges, flag).select("src", "dst", F.when(F.col("holes") | ~F.col("some"), 1.0).otherwise(F.col("w")).alias("w"))


def induced(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends in mapping(v, new_id), with the new ids."""
    a = mapping.select(F.col("v").alias("src"), F.col("new_id").alias("s"))
    b = mapping.select(F.col("v").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


#: Links that a task joins at a time.
FOREST_LINKS = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): of some links (u, v) at a time, each end but the least of what they join, with that least one."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if not n or (batch is not None and n < FOREST_LINKS):
            continue
        names, at = np.unique(np.concatenate([b.column(c).to_numpy() for c in range(2) for b in held]), return_inverse=True)
        x, y, root = at[:n], at[n:], np.arange(len(names))
        while True:
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(far := root[root], root):
                root = far
        own = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], names=["u", "v"])
        held, n = [], 0


def connected_components(edges: DataFrame, vertices: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component): the least vertex of each weakly connected component.

    Large-star and small-star rounds, O(log^2) of them; each shuffles the links once a step and none is collected.  Before any round
    the links, by range of their lower end, are joined in their tasks, FOREST_LINKS at a time, so no more than their ends are left.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"}:
        e = e.repartitionByRange("v").mapInArrow(_joined, "u long, v long")
    e, seen = checkpoint(e.distinct()), None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return vertices.join(e.withColumnRenamed("v", "root"), vertices["v"] == e["u"], "left").select(vertices["v"], F.coalesce("root", vertices["v"]).alias("component"))


#: Up to so many pairs, the lists of neighbours (8 bytes a pair) are broadcast; beyond, a task holds the lists of so many ends.
BROADCAST_PAIRS = 1 << 22
BLOCK_ENDS = 1 << 22
#: Wedges that a task looks up at a time.
WEDGES = 1 << 20


def end_degrees(pairs: DataFrame) -> DataFrame:
    """(v, d): the degrees of the ends of a simple graph (u, v)."""
    return pairs.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))


def vertex_blocks(loads: DataFrame, blocks: int) -> DataFrame:
    """loads(v, d) with ``block`` from 0 to blocks - 1: consecutive vertices share one while their running d is within its share."""
    part = range_parts(loads, [F.asc("v")], F.col("d"))
    total = loads.agg(F.sum("d").alias("_all"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    block = F.least(F.expr("_run * _blocks div _all"), F.lit(blocks - 1)).cast("int")
    return with_totals(part.withColumn("_run", before).withColumn("_blocks", F.lit(blocks).cast("long")), total).withColumn("block", block).select(*loads.columns, "block")


def out_lists(pairs: DataFrame, blocks: int = 1) -> DataFrame:
    """(a, d, block, own, ds, at) of a simple graph (u, v): the neighbours of higher (degree, id) in that order, their degrees and blocks.

    Only vertices that have some.  No list is longer than sqrt(2E), so a hub doesn't square.
    """
    deg = end_degrees(pairs)
    deg = vertex_blocks(deg, blocks) if blocks > 1 else deg.withColumn("block", F.lit(0))
    end = lambda v, d, b: deg.select(F.col("v").alias(v), F.col("d").cast("int").alias(d), F.col("block").alias(b))
    e = pairs.join(end("u", "du", "bu"), "u").join(end("v", "dv", "bv"), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    low, high = (F.struct(F.col(f"d{c}").alias("d"), F.col(c).alias("v"), F.col(f"b{c}").alias("block")) for c in "uv")
    e = e.select(F.when(up, low).otherwise(high).alias("x"), F.when(up, high).otherwise(low).alias("y"))
    lists = e.groupBy(F.col("x.v").alias("a"), F.col("x.d").alias("d"), F.col("x.block").alias("block")).agg(F.sort_array(F.collect_list("y")).alias("y"))
    return lists.select("a", "d", "block", F.col("y.v").alias("own"), F.col("y.d").alias("ds"), F.col("y.block").alias("at"))


def closed_pairs(pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(a, b, third): pairs of a checkpointed simple graph (u, v) with the vertices that close a triangle with them, every triangle once.

    Edges point from lower to higher (degree, id).  A triangle is where the list of a meets the list of one of its own neighbours.
    """
    n = pairs.count()
    return closed_lists(checkpoint(out_lists(pairs, pair_blocks(pairs, n, broadcast_pairs))), n <= broadcast_pairs)


def pair_blocks(pairs: DataFrame, n: int, broadcast_pairs: int = BROADCAST_PAIRS) -> int:
    """The number of blocks of vertices for ``n`` pairs: 1 where lists are broadcast, else as many as BLOCK_ENDS asks for or cores."""
    if n <= broadcast_pairs:
        return 1
    return max(-(-2 * n // BLOCK_ENDS), min(pairs.sparkSession.sparkContext.defaultParallelism, -(-8 * n // BLOCK_ENDS)))


def closed_lists(lists: DataFrame, held: bool) -> DataFrame:
    """closed_pairs of checkpointed out_lists: held, the lists of all are broadcast.

    Else a list goes once to each block of vertices in which it has members, not along with each of its edges, and no wedge is ever a
    row: the task of a block holds the block's lists (at most BLOCK_ENDS ends, or those of one vertex), and the others pass by.
    """
    if held:
        far = F.broadcast(lists.select(F.col("a").alias("b"), F.col("own").alias("far")))
        return lists.where(F.size("own") > 1).select("a", "own", F.explode("own").alias("b")).join(far, "b").select("a", "b", F.array_intersect("own", "far").alias("third"))
    blocks = lists.agg(F.max(F.greatest("block", F.array_max("at")))).first()[0]
    goes = F.array_union(F.array("block"), F.when(F.size("own") > 1, F.col("at")).otherwise(F.expr("cast(array() as array<int>)")))
    sent = lists.select("a", "own", F.col("block").alias("home"), F.explode(goes).alias("block")).withColumn("home", F.col("home") == F.col("block"))
    sent = sent.repartitionById((blocks or 0) + 1, "block").sortWithinPartitions(F.desc("home"), F.asc("a")).select("a", "own", "home")
    return sent.mapInArrow(_meet, "a long, b long, third array<long>")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, third) of the rows (a, own, home) of a block, those at home first: where own meets the list of a b at home."""
    first, rest = [], iter(())
    for batch in batches:
        first.append(batch)
        if not batch.column("home")[-1].as_py():
            rest = batches
            break
    home = [b.filter(b.column("home")) for b in first]
    if not sum(b.num_rows for b in home):
        return
    ids = np.concatenate([b.column("a").to_numpy() for b in home])  # in order of a
    sizes = np.concatenate([np.diff(b.column("own").offsets.to_numpy()) for b in home])
    flat = np.concatenate([b.column("own").flatten().to_numpy() for b in home])
    names = np.unique(flat)
    keys = np.sort(np.repeat(np.arange(len(ids)), sizes) * len(names) + np.searchsorted(names, flat))
    mask = (1 << max(16, int(len(keys) * 16 - 1).bit_length())) - 1
    maybe = np.zeros(mask + 1, bool)  # most wedges end here
    maybe[_mixed(keys) & mask] = True
    for batch in itertools.chain(first, rest):
        a, own = batch.column("a").to_numpy(), batch.column("own")
        members, ends = own.flatten().to_numpy(), np.cumsum(np.diff(own.offsets.to_numpy()))
        owner = np.repeat(np.arange(len(a)), np.diff(ends, prepend=0))
        left = ends[owner] - np.arange(len(members)) - 1  # members after this one
        place = np.minimum(np.searchsorted(ids, members), len(ids) - 1)
        name = np.minimum(np.searchsorted(names, members), len(names) - 1)
        known = names[name] == members
        asks = np.flatnonzero((ids[place] == members) & (left > 0))
        run = np.cumsum(left[asks])
        cuts = np.searchsorted(run, np.arange(WEDGES, run[-1] if len(run) else 0, WEDGES), side="right")
        for some in np.split(asks, np.unique(cuts)):
            if not len(some):
                continue
            count = left[some]
            from_ = np.repeat(some, count)
            to = np.arange(len(from_)) - np.repeat(np.cumsum(count) - count, count) + from_ + 1
            key = place[from_] * len(names) + name[to]
            hit = np.flatnonzero(maybe[_mixed(key) & mask])
            hit = hit[known[to[hit]]]
            key = place[from_[hit]] * len(names) + name[to[hit]]
            hit = hit[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key]
            if not len(hit):
                continue
            pair, at = np.unique(from_[hit], return_index=True)  # in order
            third = pa.ListArray.from_arrays(pa.array(np.append(at, len(hit)).astype(np.int32)), pa.array(members[to[hit]]))
            yield pa.RecordBatch.from_arrays([pa.array(a[owner[pair]]), pa.array(members[pair]), third], names=["a", "b", "third"])


def _mixed(key: np.ndarray) -> np.ndarray:
    """The key's bits spread, for a table of a power of two."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.int64)


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, c): every triangle of the simple graph (u, v) once, from lower to higher (degree, id)."""
    return closed_pairs(checkpoint(pairs.select("u", "v"))).select("a", "b", F.explode("third").alias("c"))


def triangle_counts(pairs: DataFrame) -> DataFrame:
    """(v, triangles) of the vertices in a triangle of a checkpointed simple graph (u, v)."""
    from .adjacency import of_edges, summed

    part = of_edges(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")), pairs.count())
    return summed(part.where("triangles > 0"), "triangles")


def range_parts(df: DataFrame, order: list[Column], amount: Column, buckets: int | None = None) -> DataFrame:
    """df in consecutive ranges of the order, with the range (_part) and the sum of ``amount`` over all ranges before it (_before).

    A range partitioning sorts the rows into consecutive partitions; each sums its rows, and a running sum over the partitions (one row
    each) gives every partition its start.
    """
    ranges = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)  # few rows: few partitions
    part = checkpoint(ranges.withColumn("_part", F.spark_partition_id()))
    sums = part.groupBy("_part").agg(F.sum(amount).alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return part.join(F.broadcast(before), "_part")  # a row a partition


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", buckets: int | None = None) -> DataFrame:
    """df with its 1-based place in the total order, without one task holding all rows.  The order must be total."""
    part = range_parts(df, order, F.lit(1), buckets)
    return part.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("long")).drop("_part", "_before")
