"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  A set's elements are dealt to T bins by their hash; a bin keeps its least element.  Bins left empty get further rounds of
hashing, up to T of them, and then T rounds that each hold one bin fixed, so every coordinate is filled; a coordinate is equal in two
sketches exactly when the same element is least in the same round.  The share of equal coordinates estimates the Jaccard similarity
with the concentration of independent samples.

Banding.  Bands of ROWS coordinates, as many as miss a pair at the threshold with probability (1 - s**4)**bands < 1e-5: 16 at a
similarity of 0.85, 24 at 0.8.

Verification.  Documents with the same set are one class.  The classes of a bucket are tied to the bucket's leader; tied classes form
clusters, and every candidate pair lies inside one.  A cluster's texts meet in groups of bounded size with the cluster's leader in
each; a group compares full sets and skips pairs that are already connected, so a family of n copies costs n comparisons.

Clusters of several groups whose parts stay apart (documents from one template, which share buckets without being similar enough) are
cut further by a prefix filter, which loses no pair: with the elements of all sets in one order, two sets of the wanted similarity
share one of their first n - ceil(share * n) + 1 elements.  The order puts those first that a few sample sets of the cluster don't
have, so what a template repeats comes last and meets nobody.  Only parts that a shared prefix element connects meet again, group by
group; no link is lost and no group grows with the data.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bloom_words, checkpoint, connected_components, join_classes, key_of, map_texts, maybe_in, mix64, span_hashes, text_key

WORDS, BANDS, ROWS = 5, 16, 4
T = BANDS * ROWS
MISS = 1e-5
#: Classes in a verification group.
GROUP = 256
#: Sets of a cluster that tell which elements are common in it.
SAMPLE = 32


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; with fewer words the whole sequence is one; empty without words."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z alone change, ASCII white space alone splits
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = [w for p in parts for w in p]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last_word = np.cumsum(n)
    first = last_word - n
    windows = np.where(n == 0, 0, np.maximum(1, n - words + 1))
    w_ends = np.cumsum(windows)
    at = np.arange(int(w_ends[-1])) - np.repeat(w_ends - windows, windows) + np.repeat(first, windows)
    to = np.minimum(at + words, np.repeat(last_word, windows)) - 1
    h = span_hashes(np.frombuffer(b" ".join(flat), np.uint8), starts[at], ends[to])
    return [np.unique(h[e - k : e]) for e, k in zip(w_ends.tolist(), windows.tolist())]


def bands_for(percent: int) -> int:
    """The least multiple of 8 of bands that miss a pair of ``percent`` similarity with probability under MISS; BANDS at 85."""
    n = 8
    while (1 - (percent / 100) ** ROWS) ** n >= MISS:
        n += 8
    return n


@lru_cache
def _edges(t: int) -> np.ndarray:
    """The least word of each of t bins of equal width."""
    return np.array([-(-(i << 64) // t) for i in range(t)], np.uint64)


def sketch(elements: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty sorted set of 64-bit words.  A word's place among t equal ranges is its bin."""
    out = np.zeros(t, np.uint64)
    filled = np.zeros(t, bool)
    h = elements
    for i in range(2 * t):
        if i:
            h = mix64(elements ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))
        if i < t:
            h = np.sort(h) if i else h
            at = np.searchsorted(h, _edges(t))
            ends = np.append(at[1:], len(h))
            new = (at < ends) & ~filled
            out[new] = h[at[new]]
            filled |= new
        elif not filled[i - t]:
            out[i - t] = h.min()
            filled[i - t] = True
        if filled.all():
            break
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """(documents, bands) keys from (documents, bands * ROWS) coordinates; the band's number is part of a key."""
    x = sketches.reshape(len(sketches), -1, ROWS)
    key = mix64(np.broadcast_to(np.arange(1, x.shape[1] + 1, dtype=np.uint64), x.shape[:2]))
    for r in range(ROWS):
        key = mix64(key ^ x[:, :, r])
    return key


def describe(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, key) of every row; digest and bands are null where the set is empty; key is text_key."""

    def run(ids, texts):
        sets = shingles(texts)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = bands(np.array([sketch(sets[i], n_bands * ROWS) for i in full])).view(np.int64).tolist() if full else []
        own, digest = [None] * len(sets), [None] * len(sets)
        for i, k in zip(full, keys):
            own[i], digest[i] = k, _digest(sets[i])
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "digest": digest, "bands": own, "key": [key_of(t) for t in texts]}

    return map_texts(docs, run, "doc_id long, n_shingles long, digest binary, bands array<long>, key string")


def candidates(classes: DataFrame) -> DataFrame:
    """(rep, leader, weight) from (rep, bands): in each bucket of two classes or more, all classes with the bucket's leader.

    The leader is the class with the most neighbours over all its buckets: in a family, the text that the others were made from.
    weight is that number, the same for every row of a rep; a leader has a row with itself.
    """
    keys = classes.select("rep", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = checkpoint(keys.join(sizes, "key"))
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    shared = shared.select("rep", "key").join(weights, "rep")
    leaders = shared.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"))
    return checkpoint(shared.join(leaders, "key").select("rep", (-F.col("top.minus")).alias("leader"), "weight").distinct())


def _closure(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """Labels after joining all pairs with 100 * |A & B| >= percent * |A | B|; rows of equal label are already joined.

    In order, each set meets all those not yet joined with it, in one search over their elements; so pairs within a joined family are
    skipped and every other pair is compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    for i in range(len(sets)):
        rest = np.flatnonzero((label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if not len(rest):
            continue
        joined = np.concatenate([sets[j] for j in rest])
        at = np.searchsorted(sets[i], joined)
        hit = np.zeros(len(joined) + 1, np.int64)
        np.cumsum(sets[i][np.minimum(at, n[i] - 1)] == joined, out=hit[1:])
        ends = np.cumsum(n[rest])
        both = hit[ends] - hit[ends - n[rest]]
        for j in rest[100 * both >= percent * (n[rest] + n[i] - both)]:
            if label[j] != label[i]:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label[label == b] = a
    return label


def _links(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from the groups of ``placed`` (rep, doc_id, key, g1, g2, g3, weight, label): each text and the least joined with it."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["rep"].to_numpy(), -group["weight"].to_numpy()))
        group = group.take(pa.array(order))
        ids, was = group["rep"].to_numpy(), group["label"].to_numpy()
        _, label = np.unique(was, return_inverse=True)
        label = _closure(_sets(group["text"]), label.copy(), percent)
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        keep = ids != least[label]
        return pa.table({"a": pa.array(ids[keep], pa.int64()), "b": pa.array(least[label][keep], pa.int64())}, schema=arrow_schema("a long, b long"))

    rows = _with_text(placed.select("rep", "doc_id", "key", "g1", "g2", "g3", "weight", "label"), texts)
    return rows.select("rep", "text", "g1", "g2", "g3", "weight", "label").groupBy("g1", "g2", "g3").applyInArrow(run, "a long, b long")


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column of texts."""
    out = []
    for at in range(0, len(column), 64):
        out += shingles(column.slice(at, 64).to_pylist())
    return out


def _with_text(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """placed(doc_id, key, ...) with the text; only texts whose doc_id passes a Bloom filter of the placed ones are shuffled.

    Texts, not their sets, are shipped: hashes don't compress and would take several times the disk.
    """
    placed = checkpoint(placed)
    words, _ = bloom_words(placed.select("doc_id").distinct(), "doc_id")
    return placed.join(maybe_in(texts, "doc_id", words), ["doc_id", "key"])


def _digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _prefix_ties(large: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(rep, leader) from large(rep, doc_id, key, cluster, groups, g2, lot): each with the first of those that share a prefix element."""
    own = large.select("rep", "doc_id", "key", "cluster", "g2", F.lit(False).alias("sample"))
    some = large.where(F.col("lot") <= SAMPLE).select("rep", "doc_id", "key", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g2"), F.lit(True).alias("sample"))

    def run(group: pa.Table) -> pa.Table:
        sets, sample = _sets(group["text"]), group["sample"].to_numpy(zero_copy_only=False)
        common, times = np.unique(np.concatenate([np.zeros(1, np.uint64), *(sets[k] for k in np.flatnonzero(sample))]), return_counts=True)
        rep, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(~sample).tolist():
            x = sets[k]
            at = np.minimum(np.searchsorted(common, x), len(common) - 1)
            rank = np.where(common[at] == x, times[at], 0)
            first = x[np.lexsort((x, rank))][: len(x) - -(-percent * len(x) // 100) + 1]
            rep.append(np.full(len(first), group["rep"][k].as_py()))
            key.append(first.view(np.int64))
        rows, elements = np.concatenate(rep), np.concatenate(key)
        return pa.table({"rep": rows, "cluster": np.full(len(rows), group["cluster"][0].as_py()), "element": elements}, schema=arrow_schema("rep long, cluster long, element long"))

    posted = _with_text(own.union(some), texts).select("rep", "text", "cluster", "g2", "sample").groupBy("cluster", "g2").applyInArrow(run, "rep long, cluster long, element long")
    # one shuffle: an element's leader is found where its rows are, by partial sums of (least rep, count)
    posted = checkpoint(posted)
    leaders = posted.groupBy("cluster", "element").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").select("cluster", "element", "leader")
    return posted.join(leaders, ["cluster", "element"]).where("rep <> leader").select("rep", "leader").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, chosen) for every row of (doc_id, text).

    component_id is the smallest doc_id reachable by links of at least ``percent`` / 100 similarity.  Null and empty texts, and texts
    without words, have n_shingles 0 and are linked with nothing.  Repeated rows get a row each, and rows of one doc_id with other texts
    are linked each by its own text.  An empty table gives no rows; extra columns are ignored.  Rows with a null doc_id are linked with
    nothing.  chosen: kept, and of kept rows with different sets in one component the first.  With ``keys`` there is text_key, too.
    """
    docs = docs.select("doc_id", "text")
    described = checkpoint(describe(docs, bands_for(percent)).withColumn("row", F.monotonically_increasing_id()))
    first = F.struct("doc_id", "row")
    reps = described.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(first).alias("k"), F.count("*").alias("n"), F.min_by("bands", first).alias("bands"), F.min_by("key", first).alias("key"))
    reps = checkpoint(reps.select("digest", F.col("k.row").alias("rep"), F.col("k.doc_id").alias("doc_id"), "key", "n", "bands"))
    tied = candidates(reps.select("rep", "bands"))
    cluster = connected_components(tied.where("rep <> leader"), "rep", "leader")
    weights = tied.groupBy("rep").agg(F.max("weight").alias("weight"))
    inside = cluster.join(weights, cluster["node"] == weights["rep"]).select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "weight")
    inside = checkpoint(_placed(inside).join(reps.select("rep", "doc_id", "key"), "rep"))
    texts = docs.where("text is not null").withColumn("key", text_key())
    if not described.groupBy("doc_id", "key").count().where("count > 1 and doc_id is not null").isEmpty():  # rows that are repeated whole
        texts = texts.dropDuplicates(["doc_id", "key"])

    # every class in its group, and the cluster's hub in each group of its cluster
    single = F.lit(-1).cast("long").alias("g3")
    names = ["rep", "doc_id", "key"]
    own = inside.select(*names, F.col("cluster").alias("g1"), "g2", single, "weight", F.col("rep").alias("label"))
    hubs = inside.where("rep = hub and groups > 1").select(*names, F.col("cluster").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("at"), F.col("g2").alias("own"), "weight").where("at <> own")
    links = checkpoint(_links(own.union(hubs.select(*names, "g1", F.col("at").alias("g2"), single, "weight", F.col("rep").alias("label"))), texts, percent))
    found = connected_components(links)

    # clusters in several groups with several parts: parts that a prefix element connects meet again
    large = inside.where("groups > 1").join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    apart = large.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster")
    large = checkpoint(large.join(apart, "cluster", "left_semi"))
    if not large.isEmpty():
        ties = _prefix_ties(large, texts, percent)
        joined = connected_components(checkpoint(ties.union(large.where("rep <> label").select("rep", F.col("label").alias("leader")))), "rep", "leader")
        again = large.select(*names, "weight", "label").join(joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
        again = checkpoint(again.join(_placed(again.select("rep", "cluster", "weight")).drop("cluster", "weight"), "rep"))
        parts = again.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        main = parts.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        again = checkpoint(again.join(main.select("cluster", (-F.col("top.minus")).alias("main")), "cluster"))
        # what is apart from the largest part, in blocks, meets every group
        other = again.where("label <> main")
        blocks = other.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
        other = other.join(blocks, "cluster").withColumn("g3", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("blocks")))
        columns = [*names, "cluster", "g2", "g3", "weight", "label"]
        to = other.drop("g2").withColumn("g2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).where(F.col("g2") != F.pmod(F.xxhash64("rep"), F.col("groups"))).select(columns)
        of = again.join(blocks, "cluster").withColumn("g3", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(columns)
        links = checkpoint(_links(to.union(of).withColumnRenamed("cluster", "g1"), texts, percent).union(links))
        found = connected_components(links)

    # classes of several rows or with links; the others are components of their own
    roots = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("n > 1 or component is not null").select("digest", "n", F.coalesce("component", "rep").alias("root"), "doc_id", "rep")
    tops = roots.groupBy("root").agg(F.min(F.struct("doc_id", "rep")).alias("top"))
    final = checkpoint(roots.join(tops, "root").select("digest", "n", F.col("top.doc_id").alias("component_id"), (F.col("rep") == F.col("top.rep")).alias("leads")))
    rows = described.select("doc_id", "n_shingles", F.col("key").alias("text_key"), F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_classes(rows, final, ["digest"], ["component_id", "leads"])
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), (kept & F.coalesce("leads", F.lit(True))).alias("chosen"), *(["text_key"] if keys else []))


def _placed(inside: DataFrame) -> DataFrame:
    """inside(rep, cluster, weight) with groups (of the cluster), g2 (the own one), hub and lot (one for the sample's sets)."""
    sizes = inside.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).alias("groups"), F.count("*").alias("size"), F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"))
    x = inside.join(sizes, "cluster").withColumn("g2", F.pmod(F.xxhash64("rep"), F.col("groups")))
    # about SAMPLE sets of a cluster, by hash
    lot = F.pmod(F.xxhash64(F.lit(2), "rep"), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE))) * SAMPLE * 2 + 1
    return x.select("rep", "cluster", "weight", "groups", "g2", (-F.col("top.minus")).alias("hub"), lot.cast("long").alias("lot"))


def keep(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, of which one of each group of near copies stays: that of the smallest doc_id.

    Of rows with the same doc_id and text one stays, if the text has words; rows without a doc_id are no one's copies and stay.
    """
    id_, key, n = "__kept_id", "__kept_key", "__kept_n"
    own = near_duplicates(docs, percent, keys=True).where("chosen and doc_id is not null")
    chosen = checkpoint(own.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.count(F.when(F.col("n_shingles") > 0, 1)).alias(n)))
    named = docs.where("doc_id is not null").join(chosen, (F.col("doc_id") == F.col(id_)) & (text_key() == F.col(key)))
    whole = named.where(F.col(n) <= 1)
    if not chosen.where(F.col(n) > 1).isEmpty():
        whole = whole.union(named.where(F.col(n) > 1).dropDuplicates([id_, key]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return whole.select(columns).union(docs.where("doc_id is null").select(columns))
