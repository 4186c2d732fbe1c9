"""Partition quality: modularity, conductance, H-norm, agreement with a known partition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import lbinom, lgamma, log_q_approx
from .blockmodel import block_matrix, edge_blocks, mdl, mdl_null
from .graph import checkpoint, degrees, global_rank, with_totals
from .matching import best_matching


def flows(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(b, k_out, k_in, internal) of every block that an edge touches, and of null, the unlabelled vertices: sum(k_out) is all weight.

    Edges are read once: they are summed to pairs of blocks, and each pair counts for the blocks at its two ends.
    """
    a = assign.select(F.col("v").alias("src"), F.col("b").alias("r"))
    b = assign.select(F.col("v").alias("dst"), F.col("b").alias("s"))
    pairs = edges.join(a, "src", "left").join(b, "dst", "left").groupBy("r", "s").agg(F.sum("w").alias("m"))
    zero, inner = F.lit(0.0), F.when(F.col("r") == F.col("s"), F.col("m")).otherwise(0.0)
    ends = F.array(F.struct(F.col("r").alias("b"), F.col("m").alias("o"), zero.alias("i"), inner.alias("x")), F.struct(F.col("s").alias("b"), zero.alias("o"), F.col("m").alias("i"), zero.alias("x")))
    return pairs.select(F.explode(ends).alias("e")).groupBy("e.b").agg(F.sum("e.o").alias("k_out"), F.sum("e.i").alias("k_in"), F.sum("e.x").alias("internal"))


def communities(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(b, n, k_out, k_in, internal) of every block; degrees count edges to unlabelled vertices too."""
    sizes, zero = assign.groupBy("b").agg(F.count("*").alias("n")), F.lit(0.0)
    return sizes.join(flows(edges, assign), "b", "left").select("b", "n", *[F.coalesce(c, zero).alias(c) for c in ("k_out", "k_in", "internal")])


def modularity(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (modularity): directed and weighted; 0 without edges."""
    own = F.col("b").isNotNull()
    x = flows(edges, assign).agg(F.sum("k_out").alias("m"), F.sum(F.when(own, F.col("internal"))).alias("inside"), F.sum(F.when(own, F.col("k_out") * F.col("k_in"))).alias("chance"))
    return x.select(F.when(F.col("m") > 0, F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.coalesce("chance", F.lit(0.0)) / (F.col("m") * F.col("m"))).otherwise(0.0).alias("modularity"))


def modularity_unweighted(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (modularity): an edge counts once for presence, its weight only in the degrees."""
    m = edges.agg(F.sum("w").alias("m"))
    present = edge_blocks(edges.select("src", "dst", "w").dropDuplicates(["src", "dst"]), assign).where("r = s").groupBy(F.col("r").alias("b")).agg(F.count("*").alias("pairs"))
    x = with_totals(communities(edges, assign).join(present, "b", "left"), m)
    return x.agg((F.sum(F.coalesce("pairs", F.lit(0)) - F.col("k_out") * F.col("k_in") / F.col("m")) / F.first("m")).alias("modularity"))


def conductance(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (conductance): the mean over all blocks of the share of out-weight that leaves; 0 for blocks without any."""
    c = communities(edges, assign)
    return c.agg(F.avg(F.when(F.col("k_out") > 0, (F.col("k_out") - F.col("internal")) / F.col("k_out")).otherwise(0.0)).alias("conductance"))


def inverse_hnorm(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (inverse_hnorm): 1 - sum of log_q(internal weight, size) over log_q(all weight, vertices); 0 if the latter is 0."""
    total = edges.agg(F.floor(F.sum("w")).alias("m")).crossJoin(assign.agg(F.count_distinct("v").alias("n")))
    parts = communities(edges, assign).agg(F.sum(log_q_approx(F.floor("internal"), F.col("n"))).alias("parts"))
    base = log_q_approx(F.col("m"), F.col("n"))
    return total.crossJoin(parts).select(F.when(base == 0, 0.0).otherwise(1 - F.col("parts") / base).alias("inverse_hnorm"))


def mdl_approx(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (mdl, null_mdl, inverse_hnorm): the degree-corrected length by the small-k prior, and 1 - mdl / null_mdl.

    The other quantity that goes by the name of inverse H-norm.
    """
    d = assign.join(degrees(edges), "v", "left").select("v", "b", F.coalesce("k_out", F.lit(0.0)).alias("k_out"), F.coalesce("k_in", F.lit(0.0)).alias("k_in"))
    own = d.agg(F.sum(lgamma(F.col("k_out") + 1) + lgamma(F.col("k_in") + 1)).alias("own"), F.count("*").alias("v"))
    c = d.groupBy("b").agg(F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"), F.count("*").alias("n"))
    per = c.agg(F.count("*").alias("b"), F.sum(lgamma(F.col("k_out") + 1) + lgamma(F.col("k_in") + 1)).alias("blocks"), F.sum(lgamma(F.col("n") + 1)).alias("sizes"), F.sum(log_q_approx(F.col("k_out"), F.col("n")) + log_q_approx(F.col("k_in"), F.col("n"))).alias("prior"))
    x = block_matrix(edges, assign).agg(F.sum(lgamma(F.col("m") + 1)).alias("cells")).crossJoin(edges.agg(F.floor(F.sum("w")).alias("e"))).crossJoin(own).crossJoin(per)
    e, v, b = F.col("e"), F.col("v"), F.col("b")
    mdl = F.col("cells") - F.col("blocks") + F.col("own") + lbinom(v - 1, b - 1) + lgamma(v + 1) - F.col("sizes") + F.log(v) + lbinom(b * b + e - 1, e) + F.col("prior")
    null = F.col("own") - lgamma(e + 1) + F.log(v) + lbinom(e, e) + 2 * log_q_approx(e, v)
    return x.select(mdl.alias("mdl"), null.alias("null_mdl"), (1 - mdl / null).alias("inverse_hnorm"))


def contingency(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(p, t, n, row, col): vertices that both partitions label, by their pair of labels, with the marginal counts."""
    x = predicted.select("v", F.col("b").alias("p")).join(truth.select("v", F.col("b").alias("t")), "v").groupBy("p", "t").agg(F.count("*").alias("n"))
    return x.withColumn("row", F.sum("n").over(Window.partitionBy("p"))).withColumn("col", F.sum("n").over(Window.partitionBy("t")))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(predicted: DataFrame, truth: DataFrame, vertices: int | Column | None = None) -> DataFrame:
    """One row (precision, recall, f1, nmi, rand): pairwise agreement and mutual information of two partitions.

    nmi uses the declared number of vertices (by default, those in both).  Values are null if no vertex is in both.  A row's marginal
    counts once: each cell carries its share n / row of it.
    """
    c = contingency(predicted, truth)
    n = F.col("total").cast("double") if vertices is None else (F.lit(vertices) if isinstance(vertices, int) else vertices).cast("double")
    x = with_totals(c, c.agg(F.sum("n").alias("total")))
    p, q, both = F.col("row") / n, F.col("col") / n, F.col("n") / n
    x = x.agg(
        F.sum(_pairs(F.col("n"))).alias("tp"),
        F.sum(_pairs(F.col("row")) * F.col("n") / F.col("row")).alias("rp"),
        F.sum(_pairs(F.col("col")) * F.col("n") / F.col("col")).alias("cp"),
        F.sum(both * F.log(both / (p * q))).alias("mi"),
        F.sum(-p * F.log(p) * F.col("n") / F.col("row")).alias("hp"),
        F.sum(-q * F.log(q) * F.col("n") / F.col("col")).alias("hq"),
        F.first("total").alias("total"),
    )
    precision = F.when(F.col("rp") > 0, F.col("tp") / F.col("rp")).otherwise(0.0)
    recall = F.when(F.col("cp") > 0, F.col("tp") / F.col("cp")).otherwise(0.0)
    x = x.withColumns({"precision": precision, "recall": recall})
    total = _pairs(F.col("total"))
    out = {
        "f1": F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
        "nmi": F.when(F.col("hp") * F.col("hq") > 0, F.col("mi") / F.sqrt(F.col("hp") * F.col("hq"))).otherwise(0.0),
        "rand": (total + 2 * F.col("tp") - F.col("rp") - F.col("cp")) / total,
    }
    return x.select(*[F.when(F.col("total").isNotNull(), c).alias(k) for k, c in ({"precision": F.col("precision"), "recall": F.col("recall")} | out).items()])


def evaluation(edges: DataFrame, predicted: DataFrame, truth: DataFrame, parametric: bool = False) -> DataFrame:
    """One row (f1, nmi, mdl, true_mdl, null_mdl, blocks, true_blocks): a partition against the known one, and the length of either.

    true_mdl is the description length that the known partition gives, null_mdl that of one block.
    """
    sizes = lambda a, name: a.agg(F.count_distinct("b").alias(name))
    length = lambda a, name: mdl(edges, a, parametric).select(F.col("mdl").alias(name))
    x = agreement(predicted, truth).select("f1", "nmi")
    for one in (length(predicted, "mdl"), length(truth, "true_mdl"), mdl_null(edges, truth, parametric).select(F.col("mdl").alias("null_mdl")), sizes(predicted, "blocks"), sizes(truth, "true_blocks")):
        x = x.crossJoin(F.broadcast(one))  # one row each
    return x


#: Blocks on either side of a contingency table that the driver matches (a square of this many is 8 MB).
MATCH_BLOCKS = 1024


def matching_accuracy(predicted: DataFrame, truth: DataFrame, match_blocks: int = MATCH_BLOCKS) -> DataFrame:
    """One row (accuracy): the share of vertices on the diagonal after the best one-to-one matching of blocks.

    A table of at most match_blocks blocks a side is matched by shortest augmenting paths, a larger one by an auction in Spark.
    """
    table = checkpoint(contingency(predicted, truth).select("p", "t", "n"))
    size = table.agg(F.count_distinct("p").alias("p"), F.count_distinct("t").alias("t")).first()
    if max(size["p"], size["t"]) > match_blocks:
        for c in ("p", "t"):  # labels of any type, numbered
            table = table.join(global_rank(table.select(c).distinct(), [F.asc(c)], "__n"), c).drop(c).withColumnRenamed("__n", c)
        best = best_matching(table).agg(F.sum("n").alias("best"))
        return table.agg(F.sum("n").alias("total")).crossJoin(best).select((F.col("best") / F.col("total")).alias("accuracy"))  # one row each
    cells = table.toPandas()
    p, t = (np.unique(cells[c].to_numpy(), return_inverse=True) for c in ("p", "t"))
    cost = np.zeros((max(size["p"], size["t"]),) * 2)
    cost[p[1], t[1]] = -cells["n"].to_numpy(float)
    total = float(cells["n"].sum())
    return predicted.sparkSession.createDataFrame([(-assignment_cost(cost) / total if total else None,)], "accuracy double")


def assignment_cost(cost) -> float:
    """The least total of a one-to-one assignment of a square matrix, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    n = len(cost)
    row_p, col_p, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], col = row, n
        best, via, free = np.full(n, np.inf), np.full(n, n), np.ones(n, bool)
        seen = []
        while owner[col] >= 0:
            seen.append(col)
            if col < n:
                free[col] = False
            r = owner[col]
            reduced = cost[r] - row_p[r] - col_p[:n]
            closer = free & (reduced < best)
            best[closer], via[closer] = reduced[closer], col
            nearest = int(np.argmin(np.where(free, best, np.inf)))
            step = best[nearest]
            row_p[owner[seen]] += step
            col_p[seen] -= step
            best[free] -= step
            col = nearest
        while col != n:
            owner[col], col = owner[via[col]], via[col]
    return float(sum(cost[owner[c]][c] for c in range(n)))
