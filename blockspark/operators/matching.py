"""The best one-to-one matching of two partitions' blocks, as an auction in rounds of DataFrame jobs.

Matching as much weight as possible, with blocks left alone where that is better, is a perfect matching of a doubled graph: every block p
of one side also has an object of its own, every block t of the other a bidder of its own; these are worth nothing, and t's bidder may
also take the objects of the blocks that t has cells with.  In a round every bidder without an object bids for the one that is worth most to it at
the present prices, by as much as it is better than the second, and eps more; an object goes to its highest bid.  When all have one, the
total is within (number of bidders) * eps of the best, so with weights multiplied by more than that number eps = 1 is exact.  Larger eps
come first and leave prices from which the last phase has little to do.

A round is a join of free bidders with their cells and the prices, a top two of each bidder and a maximum of each object.  Nothing is
held by the driver; each round's prices and owners are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoint

#: eps is divided by this from phase to phase.
SCALE = 6


def _split(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells(p, t, n) that are alone in row and column, which any best matching holds, and the others."""
    c = cells.withColumn("__row", F.count("*").over(Window.partitionBy("p"))).withColumn("__col", F.count("*").over(Window.partitionBy("t")))
    c = checkpoint(c)
    alone = (F.col("__row") == 1) & (F.col("__col") == 1)
    return c.where(alone).select("p", "t", "n"), c.where(~alone).select("p", "t", "n")


def _doubled(cells: DataFrame, factor: int) -> DataFrame:
    """(ps, pi, os, oi, worth): what each bidder may take; side 0 are the blocks p as bidders and t as objects, side 1 their doubles."""
    zero, worth = F.lit(0.0), (F.col("n") * factor).cast("double")
    end = lambda ps, pi, os, oi, w: F.struct(F.lit(ps).alias("ps"), F.col(pi).alias("pi"), F.lit(os).alias("os"), F.col(oi).alias("oi"), w.alias("worth"))
    both = cells.select(F.inline(F.array(end(0, "p", 0, "t", worth), end(1, "t", 1, "p", zero))))
    own_p = cells.select("p").distinct().select(F.inline(F.array(end(0, "p", 1, "p", zero))))
    own_t = cells.select("t").distinct().select(F.inline(F.array(end(1, "t", 0, "t", zero))))
    return checkpoint(both.union(own_p).union(own_t))


def _round(edges: DataFrame, bidders: DataFrame, objects: DataFrame, eps: float) -> DataFrame:
    """objects(os, oi, price, ws, wi) after all bidders without an object have bid."""
    owners = objects.where("ws is not null").select(F.col("ws").alias("ps"), F.col("wi").alias("pi"))
    free = bidders.join(owners, ["ps", "pi"], "left_anti")
    x = edges.join(free, ["ps", "pi"]).join(objects.select("os", "oi", "price"), ["os", "oi"]).withColumn("value", F.col("worth") - F.col("price"))
    two = x.withColumn("__at", F.row_number().over(Window.partitionBy("ps", "pi").orderBy(F.desc("value"), "os", "oi"))).where("__at <= 2")
    bids = two.groupBy("ps", "pi").agg(F.max_by(F.struct("os", "oi", "price", "value"), -F.col("__at")).alias("best"), F.min("value").alias("second"))
    bids = bids.select("ps", "pi", "best.os", "best.oi", (F.col("best.price") + F.col("best.value") - F.col("second") + eps).alias("bid"))
    won = bids.groupBy("os", "oi").agg(F.max(F.struct("bid", (-F.col("ps")).alias("s"), (-F.col("pi")).alias("i"))).alias("w")).select("os", "oi", "w.bid", (-F.col("w.s")).alias("s"), (-F.col("w.i")).alias("i"))
    y = objects.join(won, ["os", "oi"], "left")
    return checkpoint(y.select("os", "oi", F.coalesce("bid", "price").alias("price"), F.coalesce("s", "ws").alias("ws"), F.when(F.col("bid").isNotNull(), F.col("i")).otherwise(F.col("wi")).alias("wi")))


def best_matching(cells: DataFrame) -> DataFrame:
    """(p, t, n): the cells of cells(p, t, n), each p and each t at most once, with the largest sum of n (whole numbers over 0).

    p and t are whole numbers.  An empty table gives none.
    """
    sure, cells = _split(cells.select(F.col("p").cast("long").alias("p"), F.col("t").cast("long").alias("t"), "n"))
    size = cells.agg(F.count_distinct("p").alias("p"), F.count_distinct("t").alias("t"), F.max("n").alias("n")).first()
    total = size["p"] + size["t"]
    if not total:
        return sure
    factor = total + 1
    edges = _doubled(cells, factor)
    bidders = checkpoint(edges.select("ps", "pi").distinct())
    objects = checkpoint(edges.select("os", "oi").distinct().select("os", "oi", F.lit(0.0).alias("price"), F.lit(None).cast("int").alias("ws"), F.lit(None).cast("long").alias("wi")))
    eps = float(size["n"] * factor)
    while eps > 1:
        eps = float(max(1, int(eps / SCALE)))
        objects = objects.select("os", "oi", "price", F.lit(None).cast("int").alias("ws"), F.lit(None).cast("long").alias("wi"))
        while objects.where("ws is not null").count() < total:
            objects = _round(edges, bidders, objects, eps)
    taken = objects.where("os = 0 and ws = 0").select(F.col("wi").alias("p"), F.col("oi").alias("t"))
    return sure.union(cells.join(taken, ["p", "t"]).select("p", "t", "n"))
