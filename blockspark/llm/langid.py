"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot is a bitmask over languages (at most 64), an n-gram has HASHES slots, and the
AND of its slots tells every language that (perhaps) has it.  A text's n-grams are looked up once each; per-language popcounts, less
the hits that the language's false-positive rate explains, give the share of n-grams known to each language, and the largest decides.
A language's n-grams are those that make up at least ``min_share`` of its training n-grams, so the filter's size follows the number of
languages, not the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_texts, mix64

ORDERS = (3, 4)  # bytes of UTF-8
HASHES = 2
UND = "und"


def _lower_table() -> np.ndarray:
    """Bytes: A-Z as a-z, everything that ASCII has besides letters as a space."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


_LOWER = _lower_table()


def grams(text: str) -> np.ndarray:
    """All n-grams of the whole text as 64-bit words (order in the top byte); runs of non-letters count as one space."""
    b = _LOWER[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n << 56, np.uint64)
            for i in range(n):
                h |= b[i : len(b) - n + 1 + i] << np.uint64(8 * i)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # uint64 bitmasks
    false_rate: np.ndarray  # of each language

    def masks(self, g: np.ndarray) -> np.ndarray:
        return _masks(self.slots, g)

    def score(self, text: str) -> tuple[str, float]:
        """(language, its part of all corrected shares); ties go to the first language in order."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0
        m = self.masks(grams(text))
        n = len(m)
        hits = np.array([int(np.count_nonzero(m & np.uint64(1 << i))) for i in range(len(self.languages))])
        share = np.clip((hits / n - self.false_rate) / (1 - self.false_rate), 0, None)
        if not share.any():
            return self.languages[int(np.argmax(hits))], 0.0
        # texts differ by the n-grams that not all languages have
        weight = share ** 8
        k = int(np.argmax(share))
        return self.languages[k], float(weight[k] / weight.sum())


def _masks(slots: np.ndarray, g: np.ndarray) -> np.ndarray:
    h, bits = mix64(g), np.uint64(len(slots) - 1)
    out = slots[(h & bits).astype(np.int64)]
    for _ in range(HASHES - 1):
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        out = out & slots[(h & bits).astype(np.int64)]
    return out


def train(docs: DataFrame, per_language: int = 400, min_share: float = 2e-5, max_languages: int = 64, slots_log2: int = 18) -> Filters:
    """Filters from rows with text and lang, about ``per_language`` of each language (those with the least hash of the text).

    The n-grams of the sample are counted by Spark, one row for each (language, n-gram); a language keeps the n-grams of at least
    ``min_share``, of which there are at most 1 / min_share.
    """
    d = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # one row for each language, of which there are at most max_languages
    sample = d.join(F.broadcast(_cuts(d, per_language)), "lang").where("h <= cut")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], schema=arrow_schema("lang string, g long, n long"))

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * min_share).select("lang", "g").toPandas()
    languages = sorted(kept["lang"].unique().tolist())
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; a slot has {max_languages} bits")
    slots = np.zeros(1 << slots_log2, np.uint64)
    for k, lang in enumerate(languages):
        h = mix64(kept.loc[kept["lang"] == lang, "g"].to_numpy().view(np.uint64))
        for _ in range(HASHES):
            np.bitwise_or.at(slots, (h & np.uint64(len(slots) - 1)).astype(np.int64), np.uint64(1 << k))
            h = mix64(h + np.uint64(0x9E3779B97F4A7C15))
    load = np.array([np.count_nonzero(slots & np.uint64(1 << k)) / len(slots) for k in range(len(languages))])
    return Filters(languages, slots, load**HASHES)


def _cuts(d: DataFrame, per_language: int) -> DataFrame:
    """For each language the hash below which about ``per_language`` texts lie (hashes are uniform)."""
    n = F.count("*").cast("double")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / n)
    return d.groupBy("lang").agg((F.lit(-(2.0**63)) + share * 2.0**64).alias("cut"))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` with score 0 if the text is null, has no letter, or no language was learned.

    Whole texts are read.  Repeated rows get a row each; an empty table gives none; the filters (a few MB at most, by slots_log2) go to
    the workers with the function.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rate))

    def run(ids, texts):
        f = Filters(*shared.value)
        got = [f.score(t) if t else (UND, 0.0) for t in texts]
        return {"doc_id": ids, "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    return map_texts(docs, run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, filters: Filters, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is surely in a learned language, and in ``lang`` where that is one.

    Null texts and texts without a letter or a known n-gram go, and so do those whose language has less than ``least`` of the corrected
    shares (mixtures, junk) or isn't that of the row's lang column.  Where nothing could be learned every row with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rate))

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series, langs: pd.Series) -> pd.Series:
        f = Filters(*shared.value)

        def judge(text, lang) -> bool:
            if not text:
                return False
            if not f.languages:
                return any(map(str.isalpha, text))
            found, score = f.score(text)
            return score >= least and (lang not in f.languages or lang == found)

        return pd.Series([judge(t, x) for t, x in zip(texts, langs, strict=True)], dtype=bool)

    return docs.where(fits("text", "lang"))
