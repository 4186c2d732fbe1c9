"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text, are made by zstandard's trainer.  Both begin with the same trained
base of ordinary text, so that what all text shares compresses alike; then each holds what the trainer makes of its own class's text
where that is distinctive: the stretches covered by byte segments that are RATIO times as frequent among the class's texts as among
the other's.  A window of WINDOW words is compressed with each; the bytes that the toxic dictionary saves over the ordinary one are
its distance.  Calibrated thresholds turn the distances of all windows of a text into a score: the shares of windows that save at
least 1, 2, ... bytes, their mean and maximum are weighed by a logistic regression fitted on labelled texts that the dictionaries
haven't seen.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, checkpoint, map_texts

WINDOW, SEGMENT = 8, 6
BASE = 8192  # bytes of the shared base
#: Bytes of a class's own part, and the trainer's segment length: the pair that separates the calibrating texts best is taken.
SHAPES = ((512, 8), (512, 12), (1024, 8), (1024, 12), (2048, 8), (2048, 16))
#: A segment is distinctive if so many times as frequent, and in at least so large a share of the class's texts (and two).
RATIO, SHARE = 4.0, 0.006
CUTS = (1, 2, 3, 4, 5, 6)
#: Of a class with fewer families of near copies than this, all texts are taken; so many texts of a class calibrate at least.
FAMILIES, CALIBRATE = 100, 10
_WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def windows(text: str) -> list[bytes]:
    """The whole text, lower-cased, as windows of WINDOW words, each with a space at both ends."""
    w = _WHITE.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip(b" ").split(b" ")
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)] if w != [b""] else []


def family(text: str) -> int:
    """The least hash of the text's word pairs: mostly equal for near copies, of which one is enough to learn from."""
    w = text.lower().encode("utf-8", "surrogatepass").split()
    return min((zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:])), default=-1)


@lru_cache(4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    out = []
    for content in (ordinary, toxic):
        p = zstd.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(toxic), min_match=SEGMENT, strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstd.ZstdCompressor(compression_params=p, dict_data=d))
    return out[0], out[1]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weight: tuple[float, ...] = ()  # the last is the intercept

    def distances(self, text: str) -> np.ndarray:
        a, b = _compressors(self.ordinary, self.toxic)
        return np.array([len(a.compress(w)) - len(b.compress(w)) for w in windows(text)], float)

    def features(self, text: str) -> list[float]:
        x = self.distances(text)
        if not len(x):
            return [0.0] * (len(CUTS) + 4)
        top = np.sort(x)[-3:]
        return [float(x.mean()), float(x.max()), float(top.mean()), float(np.log1p(len(x))), *(float((x >= c).mean()) for c in CUTS)]

    def score(self, text: str | None) -> float:
        """0 without words or where nothing could be learned."""
        if not text or not self.weight or not text.strip():
            return 0.0
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ np.array(self.weight[:-1]) + self.weight[-1], -30, 30))))


def segments(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the text's windows and the SEGMENT bytes from each place on, as one word."""
    a = np.frombuffer(b"".join(windows(text)), np.uint8)
    h = np.zeros(max(0, len(a) - SEGMENT + 1), np.uint64)
    for i in range(SEGMENT):
        h = (h << np.uint64(8)) | a[i : len(h) + i]
    return a, h


def distinctive(text: str, known: np.ndarray) -> bytes:
    """The stretches of the text that segments among ``known`` (sorted) cover, with spaces between."""
    a, h = segments(text)
    if not len(h) or not len(known):
        return b""
    good = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    keep = np.zeros(len(a), bool)
    for i in range(SEGMENT):
        keep[i : len(h) + i] |= good
    return b" ".join(np.where(keep, a, 32).astype(np.uint8).tobytes().split())


def dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """``size`` bytes of content by zstandard's trainer; of the samples themselves where they are too few to train on."""
    try:
        return zstd.train_dictionary(size + 1024, samples, k=k, d=SEGMENT).as_bytes()[-size:].rjust(size)
    except zstd.ZstdError:
        return b" ".join(samples)[-size:].rjust(size)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + ridge * np.append(b[:-1], 0)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _labelled(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int]) -> tuple[DataFrame | None, dict[int, int]]:
    """(h, toxic, part, text) of the chosen labelled texts, and the number of labelled rows by label.

    Chosen are the different texts of least hash, at most ``per_class`` (toxic, ordinary) of them, and one of each family of near copies;
    all of them where a class has few families, as in templated text.  part is 0 for the quarter of each class that calibrates.  Only ids
    and hashes are shuffled before the choice.
    """
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).join(labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"]), "doc_id")
    texts = checkpoint(rows.groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        return None, sizes
    first = [texts.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(per_class[1 - k]).select("doc_id", "h", "toxic") for k in (0, 1)]
    chosen = F.broadcast(checkpoint(first[0].union(first[1])))  # at most sum(per_class) rows
    whole = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"]).dropDuplicates(["toxic", "h"])
    whole = checkpoint(whole.select("h", "toxic", F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(4)).alias("part"), "text"))
    seen = map_texts(whole, lambda ids, t: {"h": ids, "family": [family(x) for x in t]}, "h long, family long", ("h", "text"))
    leads = whole.select("h", "toxic", "part").join(seen.dropDuplicates(["h"]), "h")
    # all windows here are over no more rows than were chosen
    leads = leads.withColumn("lead", F.row_number().over(Window.partitionBy("toxic", "family").orderBy("h")) == 1)
    own = Window.partitionBy("toxic")
    leads = leads.withColumn("families", F.sum(F.col("lead").cast("int")).over(own)).where(F.col("lead") | (F.col("families") < FAMILIES))
    # where the hash leaves a class too few texts to calibrate, each fourth does
    fourth = F.pmod(F.row_number().over(own.orderBy(F.xxhash64(F.lit(7), "h"), "h")), F.lit(4))
    few = F.count(F.when(F.col("part") == 0, 1)).over(own) < CALIBRATE
    leads = leads.select("toxic", "h", F.when(few, fourth).otherwise(F.col("part")).alias("part"))
    return checkpoint(whole.drop("part").join(F.broadcast(leads), ["toxic", "h"])), sizes


def _known_segments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinctive segments of ordinary and of toxic texts: counted by Spark, at most 1 / SHARE times a text's length of each."""

    def count(batches):
        schema = arrow_schema("s long, n0 long, n1 long")
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[toxic].append(np.unique(segments(text.as_py())[1]))
            for k in (0, 1):
                s, n = np.unique(np.concatenate(found[k]), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(zero if k else n), pa.array(n if k else zero)], schema=schema)

    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = texts.select("toxic", "text").mapInArrow(count, "s long, n0 long, n1 long").groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = []
    for k in (0, 1):
        own, other = F.col(f"n{k}"), F.col(f"n{1 - k}")
        often = own >= max(2.0, SHARE * total.get(k, 0))
        rare = (own + 0.5) / (total.get(k, 0) + 1) > RATIO * (other + 0.5) / (total.get(1 - k, 0) + 1)
        out.append(np.sort(counts.where(often & rare).select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64)))
    return out[0], out[1]


def dictionaries(texts: DataFrame) -> list[Model]:
    """The two dictionaries in each of SHAPES from (toxic, h, text)."""
    known = _known_segments(texts)
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(ids, t):
        own = [distinctive(x, shared.value[i & 1]) for i, x in zip(ids, t, strict=True)]
        return {"id": ids, "own": own, "base": [b"\n".join(windows(x)) if i & 1 == 0 else b"" for i, x in zip(ids, t, strict=True)]}

    # the label is the id's last bit; the order of the rows is that of the texts' hashes, whatever the partitions
    marked = texts.select(F.expr("(h & -2L) | toxic").alias("id"), "text")
    got = map_texts(marked, run, "id long, own binary, base binary", ("id", "text")).toPandas().sort_values(["id", "own", "base"], ignore_index=True)
    base = dictionary([w for t in got["base"] if t for w in bytes(t).split(b"\n")], BASE, 64)
    own = [[bytes(x) for x in got.loc[got["id"] % 2 == label, "own"] if len(x) > SEGMENT + 2] for label in (0, 1)]
    return [Model(base + dictionary(own[0], size, k), base + dictionary(own[1], size, k)) for size, k in SHAPES]


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (3000, 6000)) -> Model:
    """A model from at most ``per_class`` toxic and ordinary labelled texts, each read whole.

    Three quarters make the dictionaries; the rest calibrate.  The thresholds hold for the classes' shares among all labelled rows.  The
    model depends on the rows alone, not on their order or partitions.
    """
    texts, sizes = _labelled(docs, labels, per_class)
    if texts is None:
        return Model(b" " * 8, b" " * 8)
    models = dictionaries(texts.where("part <> 0"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(ids, t):
        return {"id": ids, "x": [[v for m in shared.value for v in m.features(x)] for x in t]}

    # a class of fewer than four texts calibrates on those that made the dictionaries
    held = texts.where("part = 0")
    marked = (held if held.select("toxic").distinct().count() == 2 else texts).select(F.expr("(h & -2L) | toxic").alias("id"), "text")
    got = map_texts(marked, measure, "id long, x array<double>", ("id", "text")).toPandas()
    got = got.assign(order=[tuple(x) for x in got["x"]]).sort_values(["id", "order"], ignore_index=True)
    y = (got["id"].to_numpy(np.int64) & 1).astype(float)
    if len(np.unique(y)) < 2:
        return models[0]
    share = np.array([sizes[0], sizes[1]]) / (sizes[0] + sizes[1]) / [(y == 0).sum(), (y == 1).sum()]
    weight, fits = share[y.astype(int)], []
    for k, x in enumerate(np.split(np.array(got["x"].tolist()), len(models), axis=1)):
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        b = _logistic((x - mean) / scale, y, weight)
        z = ((x - mean) / scale) @ b[:-1] + b[-1]
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
        fits.append((loss, k, tuple(mean), tuple(scale), tuple(b)))
    _, k, mean, scale, b = min(fits)
    return Model(models[k].ordinary, models[k].toxic, mean, scale, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone: 0 to 1, null and empty texts 0.

    Repeated rows get a row each; an empty table gives none; extra columns are ignored.  The model is at most some tens of kB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        return {"doc_id": ids, "score": [shared.value.score(t) for t in texts]}

    return map_texts(docs, run, "doc_id long, score double")
