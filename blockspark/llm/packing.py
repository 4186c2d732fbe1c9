"""Best-fit packing of tokenised documents into sequences of bounded size.

An item has three sizes: tokens, documents (1) and attention cost (tokens squared).  A bin keeps what is left of the three capacities.
Items are taken in decreasing length; each goes to the bin, among those where all three fit, whose residual vector has the largest
weighted dot product with the item (``dot``) or whose residual after placing has the least weighted norm (``norm``).

Items of equal length are interchangeable, and so are bins in equal state.  The choice is therefore made on counts: the histogram of
lengths (at most ``max_tokens`` numbers, whatever the corpus) is packed on the driver as *runs* - "the items of length l with ranks
r..r+k go to bins b..b+k at offset o".  Ranks are dealt without gathering a length in one task: each partition counts its own lengths,
a window over those counts gives each partition its first rank.  Every document thus finds its place by a join with the runs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, checkpoint

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "count", "bin", "offset")])


def pieces(docs: DataFrame, max_tokens: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most ``max_tokens``: (doc_id, piece, start, length, ids_crc32, part, rank).

    A document is its ids and then ``end_id``.  A longer one is cut so that only its first piece can be shorter.  Null text is empty
    (one piece, the end id alone).  rank counts the pieces of equal length within the partition ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encode

        part, seen = TaskContext.get().partitionId(), Counter()
        schema = arrow_schema(PIECES)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(own)
                cut = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)] if n > max_tokens else [0, n]
                for p, (a, b) in enumerate(zip(cut, cut[1:])):
                    for c, x in zip(cols, (doc_id, p, a, b - a, zlib.crc32(own[a:b].tobytes()), part, seen[b - a]), strict=True):
                        c.append(x)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan_runs(histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, offset) that place every item of the histogram {length: count}."""
    cap = np.array([max_tokens, max_docs, max_cost], float)
    weight = np.array(weights, float)
    slot: dict[tuple[int, ...], int] = {}  # state -> its row of states
    ranges: list[list[tuple[int, int]]] = []  # of bins (first, count) in that state
    states, live = np.zeros((64, 3), np.int64), np.zeros(64, bool)
    runs, bins = [], 0

    def put(state: tuple[int, ...], first: int, n: int) -> None:
        nonlocal states, live
        k = slot.setdefault(state, len(ranges))
        if k == len(ranges):
            ranges.append([])
            if k == len(states):
                states, live = np.concatenate([states, np.zeros_like(states)]), np.concatenate([live, np.zeros_like(live)])
            states[k] = state
        ranges[k].append((first, n))
        live[k] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        item = np.array([length, 1, length * length])
        if length > max_tokens or length * length > max_cost or max_docs < 1:
            raise ValueError(f"an item of {length} tokens fits no bin")
        while left:
            fits = np.flatnonzero(live[: len(ranges)] & (states[: len(ranges)] >= item).all(axis=1))
            if not len(fits):
                # as many new bins as these items fill when each takes the greatest number that fits
                n = -(-left // min(max_tokens // length, max_docs, max_cost // (length * length)))
                put((max_tokens, max_docs, max_cost), bins, n)
                bins += n
                continue
            ok = states[fits]
            score = ((ok / cap) * (item / cap) * weight).sum(axis=1) if rule == "dot" else -(weight * ((ok - item) / cap) ** 2).sum(axis=1)
            k = int(fits[np.lexsort((ok[:, 0], -score))[0]])
            state = states[k].copy()
            first, n = ranges[k].pop()
            take = min(n, left)
            if take < n:
                ranges[k].append((first + take, n - take))
            live[k] = bool(ranges[k])
            runs.append((length, rank, take, first, int(max_tokens - state[0])))
            put(tuple((state - item).tolist()), first, take)
            rank, left = rank + take, left - take
    return runs


def pack(pieces_df: DataFrame, max_tokens: int = 1024, max_docs: int = 1024, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to rows that have length, part and rank (see ``pieces``); in each sequence the offsets are gapless.

    Every row of ``pieces_df`` is packed; it must be materialised (a checkpoint or table), as ranks are read twice.
    """
    spark = pieces_df.sparkSession
    counts = checkpoint(pieces_df.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    runs = spark.createDataFrame(plan_runs(histogram, max_tokens, max_docs, max_cost or max_tokens**2, weights, rule), RUN)
    # runs of one (part, length): those that overlap its ranks; a run is cut at partitions, so each piece meets few
    own = (
        firsts.join(F.broadcast(runs), "length")  # runs: a few for each length, bounded by max_tokens
        .where("first < base + n and first + count > base")
        .groupBy("part", "length", "base")
        .agg(F.sort_array(F.collect_list(F.struct("first", "count", "bin", "offset"))).alias("runs"))
    )
    at = pieces_df.join(own, ["part", "length"]).withColumn("at", F.col("rank") + F.col("base"))
    at = at.withColumn("run", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("at")) & (F.col("at") < r["first"] + r["count"])), 1))
    return at.withColumn("sequence_id", F.col("run.bin") + F.col("at") - F.col("run.first")).withColumn("offset", F.col("run.offset")).drop("part", "rank", "base", "runs", "at", "run")


def pack_documents(docs: DataFrame, max_tokens: int = 1024, max_docs: int = 1024, max_cost: int | None = None) -> DataFrame:
    """Tokenise and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are one piece holding the end id; repeated rows are packed each; an empty table gives no rows; extra columns
    are ignored.  The default capacities bind on tokens alone: no 1024-token sequence can hold more than 1024 documents or a larger sum
    of squares than 1024 * 1024.
    """
    return pack(checkpoint(pieces(docs, max_tokens)), max_tokens, max_docs, max_cost).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
