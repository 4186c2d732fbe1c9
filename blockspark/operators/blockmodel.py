"""Block models: the matrix of edge weight between blocks, and description lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import cell_entropy, lbinom, lgamma, log_q, safe_log
from .graph import with_totals


def edge_blocks(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(src, dst, w, r, s): edges with both ends' blocks; edges to unlabelled vertices vanish."""
    a = assign.select(F.col("v").alias("src"), F.col("b").alias("r"))
    b = assign.select(F.col("v").alias("dst"), F.col("b").alias("s"))
    return edges.join(a, "src").join(b, "dst")


def block_matrix(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(r, s, m): weight from block r to block s, non-zero cells."""
    return edge_blocks(edges, assign).groupBy("r", "s").agg(F.sum("w").alias("m"))


def block_table(bm: DataFrame, assign: DataFrame) -> DataFrame:
    """(b, n, d_out, d_in): size and weighted degrees of every block of assign."""
    sizes = assign.groupBy("b").agg(F.count("*").alias("n"))
    out = bm.groupBy(F.col("r").alias("b")).agg(F.sum("m").alias("d_out"))
    into = bm.groupBy(F.col("s").alias("b")).agg(F.sum("m").alias("d_in"))
    zero = F.lit(0.0)
    return sizes.join(out, "b", "left").join(into, "b", "left").select("b", "n", F.coalesce("d_out", zero).alias("d_out"), F.coalesce("d_in", zero).alias("d_in"))


def degree_histogram(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(b, k_out, k_in, n): vertices of a block by their pair of weighted degrees."""
    from .graph import degrees

    d = assign.join(degrees(edges), "v", "left").select("b", F.coalesce("k_out", F.lit(0.0)).alias("k_out"), F.coalesce("k_in", F.lit(0.0)).alias("k_in"))
    return d.groupBy("b", "k_out", "k_in").agg(F.count("*").alias("n"))


def matrix_summary(bm: DataFrame) -> DataFrame:
    """One row: edges (sum), trace, non-zero cells, greatest row and column sums."""
    rows = bm.groupBy("r").agg(F.sum("m").alias("x")).agg(F.max("x").alias("max_row"))
    cols = bm.groupBy("s").agg(F.sum("m").alias("x")).agg(F.max("x").alias("max_col"))
    total = bm.agg(F.sum("m").alias("edges"), F.sum(F.when(F.col("r") == F.col("s"), F.col("m")).otherwise(0.0)).alias("trace"), F.count_if(F.col("m") != 0).alias("nonzero"))
    return with_totals(with_totals(total, rows), cols)


def mdl_nonparametric(bm: DataFrame, blocks: DataFrame, directed: bool = True) -> DataFrame:
    """One row (mdl): the nonparametric description length of the microcanonical block model.

    Undirected: bm holds both directions of a pair and edges count once (pairs and loops); a block's degree is its row sum.
    """
    if directed:
        cells = bm.agg(F.sum("m").alias("e"), F.sum(-lgamma(F.col("m") + 1)).alias("cells"))
        vterm = (F.col("d_out") + F.col("d_in")) * safe_log(F.col("n"))
    else:
        upper = bm.where("r <= s").withColumn("m", F.when(F.col("r") == F.col("s"), F.col("m") / 2).otherwise(F.col("m")))
        cells = upper.agg(F.sum("m").alias("e"), F.sum(-lgamma(F.col("m") + 1) - F.when(F.col("r") == F.col("s"), F.col("m") * F.log(F.lit(2.0))).otherwise(0.0)).alias("cells"))
        vterm = F.col("d_out") * safe_log(F.col("n"))
    per_block = blocks.agg(F.sum("n").alias("v"), F.count_if(F.col("n") > 0).alias("b"), F.sum(vterm).alias("vterms"), F.sum(lgamma(F.col("n") + 1)).alias("sizes"))
    x = cells.crossJoin(per_block).withColumn("nb", (F.col("b") * F.col("b") if directed else F.col("b") * (F.col("b") + 1) / 2).cast("double"))
    partition = lbinom(F.col("v") - 1, F.col("b") - 1) + lgamma(F.col("v") + 1) - F.col("sizes") + F.log("v")
    return x.select((F.col("cells") + F.col("vterms") + partition + lbinom(F.col("nb") + F.col("e") - 1, F.col("e"))).alias("mdl"))


def log_posterior(bm: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (log_posterior): sum of m ln(m / (d_out d_in)) over the cells."""
    r = blocks.select(F.col("b").alias("r"), "d_out")
    s = blocks.select(F.col("b").alias("s"), "d_in")
    return bm.join(r, "r").join(s, "s").agg(F.sum(cell_entropy(F.col("m"), F.col("d_out"), F.col("d_in"))).alias("log_posterior"))


def mdl_parametric(bm: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (mdl): E h(B^2 / E) + V ln B - log posterior, h(x) = (1 + x) ln(1 + x) - x ln x."""
    x = bm.agg(F.sum("m").alias("e")).crossJoin(blocks.agg(F.sum("n").alias("v"), F.count("*").alias("b"))).crossJoin(log_posterior(bm, blocks))
    q = F.col("b") * F.col("b") / F.col("e")
    return x.select((F.col("e") * ((1 + q) * F.log(1 + q) - q * F.log(q)) + F.col("v") * F.log("b") - F.col("log_posterior")).alias("mdl"))


def one_block(assign: DataFrame) -> DataFrame:
    return assign.select("v", F.lit(0).cast("long").alias("b"))


def mdl(edges: DataFrame, assign: DataFrame, parametric: bool = False, directed: bool = True) -> DataFrame:
    """One row (mdl) of a partition; unlabelled vertices and their edges don't count.

    Directed, the block matrix is made once: each cell gives its own term and its weight to the blocks at its two ends.
    """
    bm = block_matrix(edges, assign)
    if not directed:
        return mdl_nonparametric(bm, block_table(bm, assign), directed)
    term, zero = (-_xlogx(F.col("m")) if parametric else -lgamma(F.col("m") + 1)), F.lit(0.0)
    ends = F.array(F.struct(F.col("r").alias("b"), F.col("m").alias("o"), zero.alias("i"), term.alias("x")), F.struct(F.col("s").alias("b"), zero.alias("o"), F.col("m").alias("i"), zero.alias("x")))
    own = bm.select(F.explode(ends).alias("e")).groupBy("e.b").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"), F.sum("e.x").alias("x"))
    y = assign.groupBy("b").agg(F.count("*").alias("n")).join(own, "b", "left").fillna(0.0)
    block = _xlogx(F.col("o")) + _xlogx(F.col("i")) if parametric else (F.col("o") + F.col("i")) * safe_log(F.col("n")) - lgamma(F.col("n") + 1)
    t = y.agg(F.sum("o").alias("e"), F.sum("n").alias("v"), F.count("*").alias("b"), (F.sum("x") + F.sum(block)).alias("sum"))
    e, v, b = F.col("e"), F.col("v"), F.col("b")
    if parametric:
        q = b * b / e
        return t.select((e * ((1 + q) * F.log(1 + q) - q * F.log(q)) + v * F.log(b) + F.col("sum")).alias("mdl"))
    return t.select((F.col("sum") + lbinom(v - 1, b - 1) + lgamma(v + 1) + F.log(v) + lbinom((b * b).cast("double") + e - 1, e)).alias("mdl"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def mdl_null(edges: DataFrame, assign: DataFrame, parametric: bool = False) -> DataFrame:
    """The description length of the one-block model: E h(1 / E) - E ln(1 / E) if parametric."""
    if not parametric:
        return mdl(edges, one_block(assign))
    q = 1 / F.col("e")
    return edges.agg(F.sum("w").alias("e")).select((F.col("e") * ((1 + q) * F.log(1 + q) - q * F.log(q)) - F.col("e") * F.log(q)).alias("mdl"))


def mdl_normalized(edges: DataFrame, assign: DataFrame) -> DataFrame:
    a, b = mdl(edges, assign), mdl_null(edges, assign).withColumnRenamed("mdl", "null_mdl")
    return a.crossJoin(b).select("mdl", "null_mdl", (F.col("mdl") / F.col("null_mdl")).alias("normalized"))


def mdl_degree_corrected(edges: DataFrame, assign: DataFrame, exact: bool = True) -> DataFrame:
    """One row (mdl) with degree correction: block degrees as factorials, vertex degrees and the degree prior.

    The prior of a block is the number of its degree sequences: ln q(d, n) for out and in, and the order of its histogram.
    """
    from .graph import degrees

    bm = block_matrix(edges, assign)
    blocks = block_table(bm, assign)
    base = bm.agg(F.sum("m").alias("e"), F.sum(-lgamma(F.col("m") + 1)).alias("cells"))
    q = (lambda n, k: log_q(n.cast("long"), k.cast("long"))) if exact else _approx
    per = blocks.withColumns({"q_out": q(F.col("d_out"), F.col("n")), "q_in": q(F.col("d_in"), F.col("n"))})
    per = per.agg(F.sum("n").alias("v"), F.count("*").alias("b"), F.sum(lgamma(F.col("d_out") + 1) + lgamma(F.col("d_in") + 1)).alias("vterms"), F.sum(lgamma(F.col("n") + 1)).alias("sizes"), F.sum(F.col("q_out") + F.col("q_in")).alias("prior"))
    own = assign.join(degrees(edges), "v").agg(F.sum(-lgamma(F.col("k_out") + 1) - lgamma(F.col("k_in") + 1)).alias("own"))
    hist = degree_histogram(edges, assign)
    order = hist.groupBy("b", "k_out").agg(F.sum("n").alias("n")).agg(F.sum(lgamma(F.col("n") + 1)).alias("h_out")).crossJoin(hist.groupBy("b", "k_in").agg(F.sum("n").alias("n")).agg(F.sum(lgamma(F.col("n") + 1)).alias("h_in")))
    x = base.crossJoin(per).crossJoin(own).crossJoin(order).withColumn("nb", (F.col("b") * F.col("b")).cast("double"))
    partition = lbinom(F.col("v") - 1, F.col("b") - 1) + lgamma(F.col("v") + 1) - F.col("sizes") + F.log("v")
    degree_prior = F.col("prior") + 2 * F.col("sizes") - F.col("h_out") - F.col("h_in")
    return x.select((F.col("cells") + F.col("vterms") + F.col("own") + partition + degree_prior + lbinom(F.col("nb") + F.col("e") - 1, F.col("e"))).alias("mdl"))


def _approx(n, k):
    from ..functions.mathx import log_q_approx

    return log_q_approx(n, k)


def relabel(assign: DataFrame) -> DataFrame:
    """(v, b): blocks numbered 0, 1, ... in order; empty numbers vanish.  No task holds all blocks."""
    from .graph import global_rank

    dense = global_rank(assign.select("b").distinct(), [F.asc("b")], "new")
    return assign.join(dense, "b").select("v", (F.col("new") - 1).cast("long").alias("b"))


def validate(edges: DataFrame, assign: DataFrame, bm: DataFrame) -> DataFrame:
    """Cells in which bm differs from the matrix made anew; none if it is right."""
    fresh = block_matrix(edges, assign).where("m <> 0")
    bm = bm.select("r", "s", "m").where("m <> 0")
    return fresh.exceptAll(bm).unionAll(bm.exceptAll(fresh))


def interblock_fraction(bm: DataFrame) -> DataFrame:
    return bm.agg((F.sum(F.when(F.col("r") != F.col("s"), F.col("m")).otherwise(0.0)) / F.sum("m")).alias("interblock"))


def block_size_variation(blocks: DataFrame) -> DataFrame:
    """Variance of block sizes over its bound (largest - smallest) (largest - mean) / 4; null if all are equal."""
    x = blocks.agg(F.var_pop("n").alias("var"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.avg("n").alias("mean"))
    bound = (F.col("hi") - F.col("lo")) * (F.col("hi") - F.col("mean")) / 4
    return x.select(F.when(bound > 0, F.col("var") / bound).alias("variation"))


def difficulty(bm: DataFrame, blocks: DataFrame) -> DataFrame:
    """The harmonic mean of interblock fraction and block size variation; 0 if both are."""
    x = interblock_fraction(bm).crossJoin(block_size_variation(blocks))
    a, b = F.col("interblock"), F.col("variation")
    return x.select("interblock", "variation", F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b)).alias("difficulty"))
