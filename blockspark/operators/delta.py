"""Changes of the description length, batched: all candidate merges or moves of a round in one DataFrame.

A candidate changes only the rows and columns of two blocks.  Its changed cells are made as signed differences, summed for each
candidate and cell, and scored against the present matrix; block terms are added from the block table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import lbinom, lgamma, safe_log
from .graph import degrees, neighbors


def merge_cells(bm: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, r, s, dm): cell changes of merging block a into block b, for all candidates (a, b); zero changes are left out."""
    row = bm.join(candidates.withColumn("r", F.col("a")), "r")
    col = bm.where("r <> s").join(candidates.withColumn("s", F.col("a")), "s")
    touched = row.select("a", "b", "r", "s", "m").union(col.select("a", "b", "r", "s", "m"))
    to = lambda c: F.when(F.col(c) == F.col("a"), F.col("b")).otherwise(F.col(c))
    change = F.explode(F.array(F.struct(F.col("r").alias("r"), F.col("s").alias("s"), (-F.col("m")).alias("d")), F.struct(to("r").alias("r"), to("s").alias("s"), F.col("m").alias("d"))))
    return touched.select("a", "b", change.alias("x")).groupBy("a", "b", "x.r", "x.s").agg(F.sum("x.d").alias("dm")).where("dm <> 0")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def _cell_gain(cells: DataFrame, bm: DataFrame, *keys: str, parametric: bool = False) -> DataFrame:
    """Sum of -lgamma(m + dm + 1) + lgamma(m + 1), or of -(m + dm) ln(m + dm) + m ln m, over a candidate's cells."""
    x = cells.join(bm, ["r", "s"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    after = F.col("m") + F.col("dm")
    change = _xlogx(F.col("m")) - _xlogx(after) if parametric else lgamma(F.col("m") + 1) - lgamma(after + 1)
    return x.groupBy(*keys).agg(F.sum(change).alias("cells"))


def _vterm(d: Column, n: Column) -> Column:
    return d * safe_log(n)


def _model_terms(blocks: DataFrame, bm: DataFrame) -> DataFrame:
    return blocks.agg(F.sum("n").alias("nv"), F.count_if(F.col("n") > 0).alias("nb")).crossJoin(bm.agg(F.sum("m").alias("e")))


def _block_dl(v: Column, b: Column, e: Column) -> Column:
    """The part of the length that depends on the number of blocks."""
    q = (b * b).cast("double")
    return lbinom(v - 1, b - 1) + lbinom(q + e - 1, e)


def merge_delta(bm: DataFrame, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, delta): the change of the nonparametric length when block a goes into block b."""
    gain = _cell_gain(merge_cells(bm, candidates), bm, "a", "b")
    x = blocks.select("b", "n", (F.col("d_out") + F.col("d_in")).alias("d"))
    y = candidates.join(gain, ["a", "b"], "left").join(x.select(F.col("b").alias("a"), F.col("n").alias("na"), F.col("d").alias("da")), "a").join(x.select("b", F.col("n").alias("n2"), F.col("d").alias("d2")), "b")
    y = y.crossJoin(F.broadcast(_model_terms(blocks, bm)))
    n = F.col("na") + F.col("n2")
    parts = _vterm(F.col("da") + F.col("d2"), n) - _vterm(F.col("da"), F.col("na")) - _vterm(F.col("d2"), F.col("n2"))
    sizes = lgamma(F.col("na") + 1) + lgamma(F.col("n2") + 1) - lgamma(n + 1)
    dl = _block_dl(F.col("nv"), F.col("nb") - 1, F.col("e")) - _block_dl(F.col("nv"), F.col("nb"), F.col("e"))
    return y.select("a", "b", (F.coalesce("cells", F.lit(0.0)) + parts + sizes + dl).alias("delta"))


def merge_delta_parametric(bm: DataFrame, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, delta): the change of minus the log posterior (the model term is the same for all merges of a round).

    The posterior sum m ln(m / d_out d_in) is sum m ln m - sum d_out ln d_out - sum d_in ln d_in, so only changed cells and the two
    blocks' degrees count.
    """
    gain = _cell_gain(merge_cells(bm, candidates), bm, "a", "b", parametric=True)
    d = blocks.select("b", "d_out", "d_in")
    y = candidates.join(gain, ["a", "b"], "left").join(d.select(F.col("b").alias("a"), F.col("d_out").alias("oa"), F.col("d_in").alias("ia")), "a").join(d, "b")
    parts = _xlogx(F.col("oa") + F.col("d_out")) - _xlogx(F.col("oa")) - _xlogx(F.col("d_out")) + _xlogx(F.col("ia") + F.col("d_in")) - _xlogx(F.col("ia")) - _xlogx(F.col("d_in"))
    return y.select("a", "b", (F.coalesce("cells", F.lit(0.0)) + parts).alias("delta"))


def best_merges(deltas: DataFrame) -> DataFrame:
    """(a, b, delta): for each block the merge with the least change; ties go to the smallest b."""
    return deltas.groupBy("a").agg(F.min(F.struct("delta", "b")).alias("x")).select("a", "x.b", "x.delta")


def move_cells(edges: DataFrame, assign: DataFrame, moves: DataFrame) -> DataFrame:
    """(v, to, r, s, dm): cell changes of moving vertex v from its block to block ``to``, for all moves (v, to)."""
    own = assign.select("v", F.col("b").alias("was"))
    m = moves.join(own, "v").where("to <> was")
    other = assign.select(F.col("v").alias("nbr"), F.col("b").alias("nb"))
    out = edges.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("nbr"), "w")
    into = edges.where("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("nbr"), "w")
    loops = edges.where("src = dst").select(F.col("src").alias("v"), "w")

    def signed(df: DataFrame, r: tuple[str, str], s: tuple[str, str]) -> DataFrame:
        x = F.explode(F.array(F.struct(F.col(r[0]).alias("r"), F.col(s[0]).alias("s"), (-F.col("w")).alias("d")), F.struct(F.col(r[1]).alias("r"), F.col(s[1]).alias("s"), F.col("w").alias("d"))))
        return df.select("v", "to", x.alias("x")).select("v", "to", "x.*")

    rows = signed(out.join(other, "nbr").join(m, "v"), ("was", "to"), ("nb", "nb"))
    rows = rows.union(signed(into.join(other, "nbr").join(m, "v"), ("nb", "nb"), ("was", "to")))
    rows = rows.union(signed(loops.join(m, "v"), ("was", "to"), ("was", "to")))
    return rows.groupBy("v", "to", "r", "s").agg(F.sum("d").alias("dm")).where("dm <> 0")


def move_delta(edges: DataFrame, assign: DataFrame, bm: DataFrame, blocks: DataFrame, moves: DataFrame, parametric: bool = False) -> DataFrame:
    """(v, to, delta): the exact change of the length of each move, each on its own; moves to the own block are left out.

    A move that empties its block is scored with one block less.
    """
    gain = _cell_gain(move_cells(edges, assign, moves), bm, "v", "to", parametric=parametric)
    k = neighbors_split(edges)
    x = blocks.select("b", "n", "d_out", "d_in")
    at = lambda key, i: x.select(F.col("b").alias(key), *[F.col(c).alias(f"{c}{i}") for c in ("n", "d_out", "d_in")])
    y = moves.join(assign.select("v", F.col("b").alias("was")), "v").where("to <> was").join(k, "v", "left").join(gain, ["v", "to"], "left")
    y = y.join(at("was", 1), "was").join(at("to", 2), "to").crossJoin(F.broadcast(_model_terms(blocks, bm))).fillna(0.0, ["k_out", "k_in"])
    n1, n2 = F.col("n1"), F.col("n2")
    if parametric:
        parts = sum((_xlogx(F.col(f"d_{e}1") - F.col(f"k_{e}")) - _xlogx(F.col(f"d_{e}1")) + _xlogx(F.col(f"d_{e}2") + F.col(f"k_{e}")) - _xlogx(F.col(f"d_{e}2")) for e in ("out", "in")), F.lit(0.0))
        sizes, term = F.lit(0.0), lambda b: _parametric_term(F.col("nv"), b, F.col("e"))
    else:
        k, d1, d2 = F.col("k_out") + F.col("k_in"), F.col("d_out1") + F.col("d_in1"), F.col("d_out2") + F.col("d_in2")
        parts = _vterm(d1 - k, n1 - 1) - _vterm(d1, n1) + _vterm(d2 + k, n2 + 1) - _vterm(d2, n2)
        sizes, term = lgamma(n1 + 1) - lgamma(n1) + lgamma(n2 + 1) - lgamma(n2 + 2), lambda b: _block_dl(F.col("nv"), b, F.col("e"))
    dl = F.when(n1 == 1, term(F.col("nb") - 1) - term(F.col("nb"))).otherwise(0.0)
    return y.select("v", "to", (F.coalesce("cells", F.lit(0.0)) + parts + sizes + dl).alias("delta"))


def _parametric_term(v: Column, b: Column, e: Column) -> Column:
    q = b * b / e
    return e * ((1 + q) * F.log(1 + q) - q * F.log(q)) + v * F.log(b)


def neighbors_split(edges: DataFrame) -> DataFrame:
    """(v, k_out, k_in): weighted degrees."""
    return degrees(edges).select("v", "k_out", "k_in")


def hastings(edges: DataFrame, assign: DataFrame, bm: DataFrame, blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """(v, to, correction): p(back) / p(forth) of every move (v, to) out of v's block; 1 without neighbours.

    p(forth) sums (cells between ``to`` and t, + 1) / (degree of t, + B) over the blocks t of v's neighbours; p(back) does so for v's
    present block in the state after the move.  A block's degree is its row and column less the diagonal.
    """
    own = assign.select("v", F.col("b").alias("was"))
    m = moves.join(own, "v").where("to <> was")
    near = neighbors(edges).where("v <> nbr").join(assign.select(F.col("v").alias("nbr"), F.col("b").alias("t")), "nbr")
    near = near.groupBy("v", "t").agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    cell = F.array(F.struct(F.col("r").alias("p"), F.col("s").alias("t"), "m"), F.struct(F.col("s").alias("p"), F.col("r").alias("t"), "m"))
    both = bm.select(F.explode(cell).alias("e")).groupBy("e.p", "e.t").agg(F.sum("e.m").alias("m"))  # the diagonal twice
    diagonal = bm.where("r = s").select(F.col("r").alias("b"), F.col("m").alias("dg"))
    deg = blocks.join(diagonal, "b", "left").select("b", (F.col("d_out") + F.col("d_in") - F.coalesce("dg", F.lit(0.0))).alias("deg"), F.coalesce("dg", F.lit(0.0)).alias("dg"))
    at = lambda key, i: deg.select(F.col("b").alias(key), F.col("deg").alias(f"deg_{i}"), F.col("dg").alias(f"dg_{i}"))
    loops = edges.where("src = dst").groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("loop"))
    part = lambda key, name: near.select("v", F.col("t").alias(key), F.col("w").alias(name))
    y = m.join(degrees(edges).select("v", (F.col("k_out") + F.col("k_in")).alias("k")), "v").join(loops, "v", "left").join(part("was", "w_was"), ["v", "was"], "left").join(part("to", "w_to"), ["v", "to"], "left")
    y = y.fillna(0.0, ["loop", "w_was", "w_to"]).join(at("was", "was"), "was").join(at("to", "to"), "to").join(near, "v").join(deg.select(F.col("b").alias("t"), F.col("deg").alias("deg_t")), "t")
    y = y.join(both.select(F.col("p").alias("to"), "t", F.col("m").alias("m_to")), ["to", "t"], "left").join(both.select(F.col("p").alias("was"), "t", F.col("m").alias("m_was")), ["was", "t"], "left").fillna(0.0, ["m_to", "m_was"])
    here, there = F.col("w_was") + F.col("loop"), F.col("w_to") + F.col("loop")
    is_was, is_to = F.col("t") == F.col("was"), F.col("t") == F.col("to")
    after = F.when(is_was, F.col("deg_was") - F.col("k") + here).when(is_to, F.col("deg_to") + F.col("k") - there).otherwise(F.col("deg_t"))
    back = F.when(is_was, 2 * (F.col("dg_was") - here)).otherwise(F.col("m_was") - F.col("w") + F.when(is_to, F.col("w_was")).otherwise(0.0)) + 1
    y = y.crossJoin(F.broadcast(blocks.agg(F.count("*").alias("nb"))))
    z = y.groupBy("v", "to").agg((F.sum(F.col("c") * back / (after + F.col("nb"))) / F.sum(F.col("c") * (F.col("m_to") + 1) / (F.col("deg_t") + F.col("nb")))).alias("correction"))
    return m.select("v", "to").join(z, ["v", "to"], "left").select("v", "to", F.coalesce("correction", F.lit(1.0)).alias("correction"))
