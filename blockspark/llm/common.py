"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = rb"\x20\x09-\x0D"
#: Texts are handed to numpy in slices of about this many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, the folder the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return where or tempfile.mkdtemp(prefix="spark-checkpoints-")


def text_key(column: str = "text"):
    """The md5 of a text in hexadecimal, of null ''; ``key_of`` gives the same inside tasks.  With doc_id it tells rows apart."""
    return F.coalesce(F.md5(F.col(column).cast("binary")), F.lit(""))


def key_of(text: str | None) -> str:
    return "" if text is None else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Run ``fn(ids, texts) -> {column: values}`` over slices of at most about SLICE_BYTES of text.

    Only ``columns`` (an id and a text) are read, so extra columns of any name do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            # one slice at a time becomes Python objects; a text longer than a slice is one of its own
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                got = fn(batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist())
                out_schema = out_schema or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in out_schema], schema=out_schema)
                at = to

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in ddl.split(", ")])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Two primes under 2**31 and a base for each: products of two residues stay under 2**62.
PRIMES, BASES = (2147483647, 2147483629), (1540483477, 1812433253)
_powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime base**i and base**-i modulo it for i < n, kept by the next power of two."""
    m = 1 << max(10, (n - 1).bit_length())
    if m not in _powers:
        out = []
        for p, base in zip(PRIMES, BASES, strict=True):
            pair = []
            for b in (base, pow(base, -1, p)):
                x = np.ones(1, np.uint64)
                while len(x) < m:
                    x = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
                pair.append(x)
            out.append((pair[0], pair[1]))
        _powers.clear()
        _powers[m] = out
    return _powers[m]


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end], the place doesn't matter.

    Two polynomials by prefix sums, modulo two primes: modulo a power of two, words that differ like the Thue-Morse word and its
    complement would have one hash whatever the base.
    """
    out = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        for (up, down), p in zip(powers(len(symbols) + 1), PRIMES, strict=True):
            total = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)] % np.uint64(p), out=total[1:])
            out = mix64(out ^ ((total[end] - total[start]) % np.uint64(p) * down[start] % np.uint64(p)))
    return out


#: So many links (16 bytes each) one task unites.
TASK_LINKS = 1 << 18


def _united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of each node that isn't the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            break
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _unite_tasks(e: DataFrame, tasks: int) -> DataFrame:
    """e(u, v) with the links of each of ``tasks`` tasks replaced by those to the least node that the task can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
        node, least = _united(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], schema=arrow_schema("u long, v long"))

    return checkpoint(e.coalesce(tasks).mapInArrow(run, "u long, v long"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Links are first replaced, in tasks of about task_links each and without a shuffle, by those to the least node that a task can reach.
    More than one task's worth go through alternating large-star and small-star rounds, which replace a node's neighbours' links by links
    to the least of them, until one task's worth is left or nothing changes.  Nothing is collected; hubs are met by partial
    aggregation and by plain joins, whose skewed partitions AQE splits.  Nulls and loops are dropped.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    n = e.count()
    tasks = max(1, -(-n // task_links))
    if n:
        e = _unite_tasks(e, tasks)
    seen = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        if now[0] <= task_links:
            e = _unite_tasks(e, 1)
            break
        seen = now
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Classes with more than one in HEAVY rows are met by a broadcast; there are fewer than HEAVY of them.
HEAVY = 4096


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the values of their class; null where the last key is null or no class has it.

    classes holds keys, values and n, the class's number of rows.  Large classes are broadcast and rows without a key aren't shuffled, so
    no task gets all rows of one class.
    """
    limit = max(1, rows.count() // HEAVY)
    hot = F.broadcast(classes.where(F.col("n") > limit).select(*[F.col(c).alias(f"_hot_{c}") for c in keys + values]))
    met = rows.join(hot, [F.col(c) == F.col(f"_hot_{c}") for c in keys], "left")
    done = F.col(f"_hot_{keys[-1]}").isNotNull() | F.col(keys[-1]).isNull()
    light = classes.where(F.col("n") <= limit).select(keys + values)
    names = [F.col(f"`{c}`") for c in rows.columns]
    rest = met.where(~done).select(names).join(light, keys, "left").select(*names, *values)
    return met.where(done).select(*names, *[F.col(f"_hot_{c}").alias(c) for c in values]).union(rest)


#: A Bloom filter has at most 2**26 bits (8 MB), whatever the number of keys.
MAX_BLOOM_LOG2 = 26


def bloom_words(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A one-hash Bloom filter of a long column as 32-bit words, and the number of keys.

    16 bits a key, up to the fixed limit; beyond it more false positives pass, which only costs rows where an exact join follows.  The
    bits are joined by Spark; the driver gets the filter alone.
    """
    n = keys.count()
    log2 = min(MAX_BLOOM_LOG2, max(10, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << log2))
    got = keys.select(F.shiftright(slot, 5).alias("word"), F.expr("1L").alias("one"), F.pmod(slot, F.lit(32)).cast("int").alias("at"))
    got = got.select("word", F.call_function("shiftleft", "one", "at").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (log2 - 5), np.uint32)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return words, n


def maybe_in(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows of df whose long ``column`` passes the filter; others are surely not among its keys."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def passes(slot: pd.Series) -> pd.Series:
        s = slot.to_numpy(np.int64)
        return pd.Series((shared.value[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1) > 0)

    return df.where(passes(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(len(words) * 32))))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; executors have the same installation."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
