"""Offset-mapped token attribution.

A whole document is encoded once.  Byte-level tokens tile its bytes, so each token's character span follows from the sums of token
lengths; an interval join (binary search of the sorted sections) finds the sections that a span touches.  A token that crosses a
boundary is given by one explicit rule:

    start   the section of its first character
    end     the section of its last character
    larger  the section with most of its characters, the first of equals

so that every token counts once and the sections' counts add up to the document's.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .tokens import encode, token_bytes

RULES = ("start", "end", "larger")


def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each token in characters, end exclusive; a token that holds part of a character's bytes spans the character."""
    ids = encode(text)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(token_bytes()[ids])
    start = end - token_bytes()[ids]
    return char_of[start], char_of[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); section k is bounds[k] <= character < bounds[k + 1]."""
    first = np.searchsorted(bounds, start, side="right") - 1
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    if rule == "start":
        return first, first != last
    if rule == "end":
        return last, first != last
    best, most = first.copy(), np.minimum(end, bounds[first + 1]) - start
    for k in range(1, int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + k, last)
        part = np.where(first + k <= last, np.minimum(end, bounds[at + 1]) - bounds[at], 0)
        best, most = np.where(part > most, at, best), np.maximum(part, most)
    return best, first != last


def line_bounds(text: str) -> np.ndarray:
    """Sections are lines, each with its line feed; the ends of the text included."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(text)]]))


def count_sections(docs: DataFrame, rule: str = "start") -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, tokens): tokens holds each line's count, in order.

    Null and empty texts have no sections and no tokens; repeated rows get a row each; an empty table gives none; extra columns are
    ignored.  The largest state is one text's spans.
    """
    if rule not in RULES:
        raise ValueError(f"rule: {rule}")

    def run(ids, texts):
        out = {"doc_id": ids, "n_tokens": [], "n_sections": [], "n_crossing": [], "tokens": []}
        for text in texts:
            counts, crossing = np.zeros(0, np.int64), 0
            if text:
                start, end = spans(text)
                bounds = line_bounds(text)
                section, crosses = attribute(start, end, bounds, rule)
                counts, crossing = np.bincount(section, minlength=len(bounds) - 1), int(crosses.sum())
            out["n_tokens"].append(int(counts.sum()))
            out["n_sections"].append(len(counts))
            out["n_crossing"].append(crossing)
            out["tokens"].append(counts.tolist())
        return out

    return map_texts(docs, run, "doc_id long, n_tokens long, n_sections long, n_crossing long, tokens array<int>")


def count_fields(df: DataFrame, key: str, fields: list[str], rule: str = "start", separator: str = "\n") -> DataFrame:
    """(key, field, tokens): the fields of a row are joined by ``separator`` into one document, which is encoded once.

    The separator belongs to the field before it.  Null fields are empty; every field of every row gets a row.
    """

    def run(ids, texts):
        out = {"doc_id": [], "field": [], "tokens": []}
        for i, packed in zip(ids, texts, strict=True):
            sizes = [int(x) for x in packed[: packed.index("|")].split(",")]
            text = packed[packed.index("|") + 1 :]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            counts = np.zeros(len(fields), np.int64)
            if text:
                keep = np.flatnonzero(np.diff(bounds) > 0)
                section, _ = attribute(*spans(text), np.append(bounds[keep], bounds[-1]), rule)
                counts[keep] = np.bincount(section, minlength=len(keep))
            for f, n in zip(fields, counts.tolist(), strict=True):
                out["doc_id"].append(i)
                out["field"].append(f)
                out["tokens"].append(n)
        return out

    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if k + 1 < len(fields) else "")) for k, f in enumerate(fields)]
    packed = F.concat(F.concat_ws(",", *[F.char_length(p).cast("string") for p in parts]), F.lit("|"), *parts)
    return map_texts(df.select(F.col(key).cast("long").alias("doc_id"), packed.alias("text")), run, "doc_id long, field string, tokens long")


def digest(counts: DataFrame) -> DataFrame:
    """``count_sections`` with the counts as the crc32 of their decimal list."""
    return counts.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.crc32(F.concat_ws(",", F.col("tokens").cast("array<string>")).cast("binary")).alias("tokens_crc32"))


def crc(counts: list[int]) -> int:
    return zlib.crc32(",".join(map(str, counts)).encode())
