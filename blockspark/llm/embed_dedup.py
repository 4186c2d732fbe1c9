"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors; every vector is described by its PREFIX nearest pivots in order.  It is
posted in the inverted lists of its POSTED nearest; two vectors of a list that share at least SHARED pivots of their prefixes are
candidates, and only for those the cosine in double precision is made, which decides.  A list of more than LONG vectors (a dense
region) is cut by the second pivot: a vector stands in the part of every other pivot of its prefix, and as candidates share further
pivots, each pair still meets.  A list is met in blocks: each pair of its blocks is one group, so no group grows with the data, and a
group answers with sums and spanning links, never with all of its pairs.  Equal vectors are one class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, checkpoint, connected_components, join_classes

PREFIX, POSTED, SHARED, BLOCK, LONG = 16, 8, 3, 512, 4096
MAX_PIVOTS = 8192


def _valid(df: DataFrame) -> DataFrame:
    """(vec_id, label, digest, dim, vector): the last three are null for vectors that link with nothing."""

    def run(batches):
        schema = arrow_schema("vec_id long, label long, digest binary, dim int, vector array<double>")
        for batch in batches:
            digest, dims, vectors = [], [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = None if v.as_py() is None or label is None or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                ok = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                x = _scaled(x) if ok else x
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
                dims.append(len(x) if ok else None)
                vectors.append(x if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], schema=schema)

    return df.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label long, digest binary, dim int, vector array<double>")


def _scaled(x: np.ndarray) -> np.ndarray:
    """x, times a power of two where its squared norm would over- or underflow; that changes no cosine."""
    top = float(np.abs(x).max())
    return x if 1e-100 < top < 1e100 else np.ldexp(x, -math.frexp(top)[1])


def pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit reference points by dimension: about 2 * sqrt(n) vectors, MAX_PIVOTS at most, those of least hash."""
    k = min(MAX_PIVOTS, 1 << max(5, math.ceil(math.log2(2 * math.sqrt(max(1, n))))))
    found: dict[int, list] = {}
    for r in classes.select("embedding").orderBy(F.xxhash64("embedding"), "rep").limit(k).collect():
        found.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {d: _unit(np.array(v, np.float64)) for d, v in found.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _describe(classes: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """(rep, label, dim, n, embedding, prefix): the PREFIX nearest pivots in order; -1 where a dimension has none."""
    shared = classes.sparkSession.sparkContext.broadcast(points)

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            prefix: list = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p = shared.value.get(d)
                if p is None:
                    for i in at.tolist():
                        prefix[i] = [-1]
                    continue
                for part in np.array_split(at, max(1, len(at) * len(p) // 4_000_000)):
                    x = np.array(batch.column(4).take(pa.array(part)).to_pylist(), np.float64)
                    near = _unit(x) @ p.T
                    k = min(PREFIX, len(p))
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                    for i, row in zip(part.tolist(), np.take_along_axis(top, order, 1).tolist(), strict=True):
                        prefix[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefix, pa.list_(pa.int32()))], names=[*batch.schema.names, "prefix"])

    return classes.select("rep", "label", "dim", "n", "embedding").mapInArrow(run, "rep long, label long, dim int, n long, embedding array<double>, prefix array<int>")


def _meet(group: pa.Table, least: float) -> pa.Table:
    """Of one list and one pair of its blocks: for each vector the number of vectors linked here, and the least vector joined with it."""
    key, second, i, j = (group[c][0].as_py() for c in ("pivot", "second", "i", "j"))
    rep, n, block = group["rep"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
    prefix = group["prefix"].to_pylist()
    size = max(map(len, prefix))
    prefix = np.array([p + [-2 - k] * (size - len(p)) for k, p in enumerate(prefix)])  # fillers differ, so they are never shared
    need = min(SHARED, int((prefix >= -1).sum(axis=1).min()))
    # candidates: how many pivots two prefixes share
    value, col, often = np.unique(prefix, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    has = np.zeros((len(rep), int((often > 1).sum())), np.float32)
    col = col.reshape(prefix.shape)
    owner = np.repeat(np.arange(len(rep)), size).reshape(prefix.shape)
    shown = often[col] > 1
    has[owner[shown], place[col[shown]]] = 1
    pair = (has @ has.T >= need) & (rep[:, None] != rep[None, :])
    if i != j:
        pair &= (block[:, None] == i) != (block[None, :] == i)
    u, v = np.nonzero(np.triu(pair))
    x = _unit(np.array(group["embedding"].to_pylist(), np.float64))
    near = np.zeros(len(u), bool)
    for s in range(0, len(u), 50_000):
        near[s : s + 50_000] = np.einsum("ij,ij->i", x[u[s : s + 50_000]], x[v[s : s + 50_000]]) >= least
    a, b = u[near], v[near]
    # a pair is counted in the first list that both are posted in, and there in the first part
    count = np.zeros(len(rep), np.int64)
    none = np.iinfo(np.int64).max
    posted = prefix[:, :POSTED]
    for s in range(0, len(a), 50_000):
        u, v = a[s : s + 50_000], b[s : s + 50_000]
        both = (posted[u][:, :, None] == posted[v][:, None, :]).any(axis=2)
        mine = np.where(both, posted[u], none).min(axis=1) == key
        if second is not None:
            shared = (prefix[u][:, :, None] == prefix[v][:, None, :]).any(axis=2) & (prefix[u] != key)
            mine &= np.where(shared, prefix[u], none).min(axis=1) == second
        np.add.at(count, u[mine], n[v[mine]])
        np.add.at(count, v[mine], n[u[mine]])
    label = rep.copy()
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    keep = (count > 0) | (label != rep)
    return pa.table({"rep": pa.array(rep[keep]), "links": pa.array(count[keep]), "least": pa.array(label[keep])}, schema=arrow_schema("rep long, links long, least long"))


def near_duplicates(df: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and their lengths are equal.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing: no links, their own component.  n_links counts other rows, equal vectors
    included.  Repeated rows get a row each, and rows of one vec_id with other vectors are linked each by its own vector; an empty table
    gives none; extra columns are ignored.
    """
    valid = checkpoint(_valid(df).withColumn("row", F.monotonically_increasing_id()))
    reps = valid.where("digest is not null and vec_id is not null").groupBy("label", "digest").agg(F.min(F.struct("vec_id", "row")).alias("k"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("embedding"))
    classes = checkpoint(reps.select("label", "digest", F.col("k.row").alias("rep"), F.col("k.vec_id").alias("least"), "n", "dim", "embedding"))
    points = pivots(classes, classes.count())
    posted = checkpoint(_describe(classes, points).withColumn("pivot", F.explode(F.slice("prefix", 1, POSTED))))
    lists = posted.groupBy("label", "dim", "pivot").agg(F.count("*").alias("size"))
    at = posted.join(lists, ["label", "dim", "pivot"])
    alone = F.array(F.lit(None).cast("int"))
    others = F.array_except("prefix", F.array("pivot"))
    at = at.withColumn("second", F.explode(F.when((F.col("size") > LONG) & (F.size(others) > 0), others).otherwise(alone)))
    list_ = ["label", "dim", "pivot", "second"]
    sizes = at.groupBy(list_).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in list_], "blocks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in list_]
    at = at.join(sizes, same).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    at = at.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*list_, "i", "j", "block", "rep", "n", "embedding", "prefix")
    met = checkpoint(at.groupBy(*list_, "i", "j").applyInArrow(lambda t: _meet(t, least), "rep long, links long, least long"))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(met, "rep", "least").withColumnRenamed("node", "rep")
    linked = classes.select("label", "digest", "rep", F.col("least").alias("vec"), "n").join(links, "rep", "left").join(found, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    tops = linked.groupBy("root").agg(F.min("vec").alias("component_id"))
    final = checkpoint(linked.join(tops, "root").select("label", "digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"))
    rows = valid.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_classes(rows, final, ["label", "digest"], ["n_links", "component_id"])
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
