"""Personal data: base patterns, and terms that reveal the people behind them.

Base spans (emails, IP addresses, card and phone numbers) are the protected entities, and so are the groups that they belong to, one
step up a ladder of generalisation: an email's domain, an address's network, a card's first eight digits, a phone number but for its
last four digits.  A term near one may reveal it: the corpus tells how strongly.  For a term t and an entity or group e

    support(e, t)    = different contexts of e that hold t (WINDOW terms on each side; equal contexts, as in copies, count once)
    near(e, t)       = documents with t in a context of e
    documents(t)     = documents of the whole corpus that hold t
    disclosure(e, t) = near(e, t) / documents(t), an estimate of P(e | t)
    information      = log2(disclosure / P(e)), P(e) = documents(e) / all documents
    share(e, t)      = information / log2(1 / P(e)), the part of what there is to learn about e that t tells

A term whose support (a group needs more), disclosure and share reach the thresholds gives the entity or its group away wherever it
stands; all three mean the same in small and large tables, for rare and common entities.  The share only excludes terms of an entity
that stands nearly everywhere, which any word would predict.  The spans of such a term are added as kind ``term`` (outside base spans)
and it is generalised like the rest.

Three scans of the texts.  The first yields base spans and contexts, the second documents(t) for terms that pass a fixed-size Bloom
filter of those with enough support, the third the places of revealing terms.  At most HELD_TERMS of those are held by the tasks; more
are met by a filter and a join with the full table, so no case is dropped however large the corpus.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, checkpoint, key_of, map_texts, mix64, span_hashes, text_key

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns.  A match starts where its run of characters does, or where the last match ended: any other start
# would end alike, so each run is read once.  Possessive runs are followed by a character that they don't hold.
_LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_DOTTED = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
EMAIL = (re.compile(_LOCAL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL))
IP = (re.compile(_DOTTED), re.compile(r"(?<![0-9])" + _DOTTED))
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _matches(pattern: tuple[re.Pattern, re.Pattern], text: str):
    """Leftmost non-overlapping matches of a pattern given with and without the condition that a run begins."""
    at = 0
    while True:
        m = (pattern[0].match(text, at) if at else None) or pattern[1].search(text, at)
        if m is None:
            return
        yield m
        at = m.end()


WINDOW = 8
BLOOM_LOG2 = 22
#: Revealing terms that tasks hold (8 bytes each).
HELD_TERMS = 1 << 20


@dataclass(frozen=True)
class Thresholds:
    support: int = 2
    group_support: int = 3
    disclosure: float = 0.9
    share: float = 0.5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start: leftmost non-overlapping matches of each kind, less those that fail its check."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _matches(EMAIL, text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _matches(IP, text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


_lower = _letter = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case, where that is one code point, and whether it is a letter or digit."""
    global _lower, _letter
    if _letter is None:
        chars = [chr(i) for i in range(0x110000)]
        _letter = np.fromiter((c.isalnum() for c in chars), bool, len(chars))
        low = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(_letter).tolist():
            if len(x := chars[i].lower()) == 1:
                low[i] = ord(x)
        _lower = low
    return _lower, _letter


def terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the text's terms: runs of letters and digits without regard to case, in code points."""
    lower, letter = _tables()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(letter[c].astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    return span_hashes(lower[c], start, end).view(np.int64), start, end


def _entities(kind: str, match: str) -> tuple[int, int]:
    """Hashes of the entity and of its group."""
    digits = re.sub(r"[^0-9]", "", match)
    norm, group = {
        "email": lambda: (match.lower(), match.lower().rpartition("@")[2]),
        "ip": lambda: (match, match.rpartition(".")[0]),
        "card": lambda: (digits, digits[:8]),
        "phone": lambda: (digits, digits[:-4]),
    }[kind]()
    key = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return key(f"{kind}:{norm}"), key(f"{kind}-group:{group}")


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, level, context, doc_id, terms) for each base span, as itself (level 0) and as its group (1).

    terms are the hashes of the terms around it, context that of all of them."""

    def run(ids, texts):
        out = {"entity": [], "level": [], "context": [], "doc_id": [], "terms": []}
        for doc_id, text in zip(ids, texts, strict=True):
            spans = base_spans(text or "")
            if not spans:
                continue
            h, start, end = terms(text)
            free = np.ones(len(h), bool)
            for _, a, b in spans:
                free[np.searchsorted(end, a, side="right") : np.searchsorted(start, b, side="left")] = False
            h, start = h[free], start[free]
            for kind, a, b in spans:
                at = int(np.searchsorted(start, a))
                near = h[max(0, at - WINDOW) : at + WINDOW]
                context = int(mix64(np.frombuffer(hashlib.blake2b(near.tobytes(), digest_size=8).digest(), np.uint64)).view(np.int64)[0])
                for level, entity in enumerate(_entities(kind, text[a:b])):
                    for name, value in (("entity", entity), ("level", level), ("context", context), ("doc_id", doc_id), ("terms", np.unique(near).tolist())):
                        out[name].append(value)
        return out

    return map_texts(docs, run, "entity long, level int, context long, doc_id long, terms array<long>")


def _bloom(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the long column ``t``: at most 2**BLOOM_LOG2 bits come to the driver, however many keys there are."""
    slot = F.pmod(F.col("t"), F.lit(1 << BLOOM_LOG2))
    words = keys.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(t, {1 << BLOOM_LOG2}) % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BLOOM_LOG2 - 5), np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits, len(words)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.int64((1 << BLOOM_LOG2) - 1)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) > 0


def revealing_terms(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(t, support, documents, disclosure, information) of the terms that give an entity away; each term once, at its most revealing."""
    spark = docs.sparkSession
    seen = checkpoint(contexts(docs))
    entities = seen.groupBy("entity").agg(F.count_distinct("doc_id").alias("entity_documents"))
    near = seen.select("entity", "level", "context", "doc_id", F.explode("terms").alias("t")).groupBy("entity", "level", "t").agg(F.count_distinct("context").alias("support"), F.count_distinct("doc_id").alias("near"))
    near = checkpoint(near.where(F.col("support") >= F.when(F.col("level") == 0, thresholds.support).otherwise(thresholds.group_support)))
    bits, n = _bloom(near)
    if not n:
        return spark.createDataFrame([], "t long, support long, documents long, disclosure double, information double")
    shared = spark.sparkContext.broadcast(bits)

    def count(batches):
        for batch in batches:
            found = []
            for text in batch.column(0):
                if text.is_valid and (s := text.as_py()):
                    h = terms(s)[0]
                    found.append(np.unique(h[_passes(shared.value, h)]))
            if found:
                t, k = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(k)], schema=arrow_schema("t long, documents long"))

    documents = docs.select("text").mapInArrow(count, "t long, documents long").groupBy("t").agg(F.sum("documents").alias("documents"))
    everything = docs.count()
    scored = near.join(documents, "t").join(entities, "entity").withColumn("disclosure", F.col("near") / F.col("documents"))
    scored = scored.withColumn("information", F.log2(F.col("disclosure") * everything / F.col("entity_documents")))
    most = F.log2(everything / F.col("entity_documents"))
    scored = scored.where((F.col("disclosure") >= thresholds.disclosure) & (most > 0) & (F.col("information") >= thresholds.share * most))
    best = scored.groupBy("t").agg(F.max(F.struct("disclosure", "information", "support", "documents")).alias("b"))
    return checkpoint(best.select("t", "b.support", "b.documents", "b.disclosure", "b.information"))


def _held(revealing: DataFrame) -> np.ndarray | None:
    """The sorted revealing terms, if tasks may hold them."""
    t = revealing.select("t").limit(HELD_TERMS + 1).toPandas()["t"].to_numpy(np.int64)
    return np.sort(t) if len(t) <= HELD_TERMS else None


def _term_places(text: str, base: list[tuple[str, int, int]], known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the terms outside base spans that ``known`` accepts."""
    h, start, end = terms(text)
    ok = known(h)
    for _, a, b in base:
        ok[np.searchsorted(end, a, side="right") : np.searchsorted(start, b, side="left")] = False
    return h[ok], start[ok], end[ok]


def _in(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), bool)


def text_spans(text: str | None, held: np.ndarray) -> list[str]:
    """"kind:start:end" of base spans and of the terms among ``held`` (sorted hashes)."""
    if not text:
        return []
    base = base_spans(text)
    out = [f"{k}:{a}:{b}" for k, a, b in base]
    if len(held):
        _, start, end = _term_places(text, base, lambda h: _in(held, h))
        out += [f"term:{a}:{b}" for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return out


def find_spans(docs: DataFrame, thresholds: Thresholds = Thresholds(), revealing: DataFrame | None = None, keys: bool = False) -> DataFrame:
    """(doc_id, spans) of every row: spans holds "kind:start:end" by kind (email, ip, card, phone, term), then start; code points.

    Null texts are empty; repeated rows and rows of one doc_id get a row each, each by its own text; an empty table gives no rows; extra
    columns are ignored.  ``revealing`` holds the terms that another table has shown to give entities away.  With ``keys`` there is
    text_key, too.
    """
    revealing = revealing_terms(docs, thresholds) if revealing is None else revealing
    held = _held(revealing)
    more, key = (", text_key string", lambda texts: {"text_key": [key_of(t) for t in texts]}) if keys else ("", lambda texts: {})
    if held is not None:
        shared = docs.sparkSession.sparkContext.broadcast(held)
        return map_texts(docs, lambda ids, texts: {"doc_id": ids, "spans": [text_spans(t, shared.value) for t in texts]} | key(texts), "doc_id long, spans array<string>" + more)
    bits, _ = _bloom(revealing)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(ids, texts):
        out = {"doc_id": ids, "base": [], "t": [], "at": []} | key(texts)
        for text in texts:
            base = base_spans(text or "")
            t, start, end = _term_places(text or "", base, lambda h: _passes(shared.value, h))
            out["base"].append([f"{k}:{a}:{b}" for k, a, b in base])
            out["t"].append(t.tolist())
            out["at"].append([f"term:{a}:{b}" for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return out

    found = map_texts(docs, run, "doc_id long, base array<string>, t array<long>, at array<string>" + more)
    # only rows with a term that passed the filter meet the table of terms
    found = checkpoint(found.withColumn("key", F.monotonically_increasing_id()))
    places = found.where(F.size("t") > 0).select("key", F.explode(F.arrays_zip("t", "at")).alias("x")).select("key", F.col("x.t").alias("t"), F.col("x.at").alias("at"))
    sure = places.join(revealing.select("t"), "t").groupBy("key").agg(F.collect_list("at").alias("terms"))
    by_start = F.array_sort(F.coalesce("terms", F.array().cast("array<string>")), lambda a, b: F.split_part(a, F.lit(":"), F.lit(2)).cast("int") - F.split_part(b, F.lit(":"), F.lit(2)).cast("int"))
    return found.join(sure, "key", "left").select("doc_id", F.concat("base", by_start).alias("spans"), *(["text_key"] if keys else []))


def masked(docs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; overlapping spans become one, named after the first.

    Each row is masked by its own text, whatever its doc_id; null texts stay null.
    """
    revealing = revealing_terms(docs, thresholds)
    held = _held(revealing)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if held is not None:
        shared = docs.sparkSession.sparkContext.broadcast(held)

        @F.pandas_udf("string")
        def mask(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else mask_text(t, text_spans(t, shared.value)))

        return docs.withColumn("text", mask("text")).select(columns)
    key, found = "__pii_key", "__pii_spans"

    @F.pandas_udf("string")
    def mask_found(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return texts.combine(spans, lambda t, s: t if t is None or s is None else mask_text(t, s))

    # equal texts have equal spans, so rows meet their spans by text
    spans = find_spans(docs, thresholds, revealing, keys=True).where(F.size("spans") > 0).dropDuplicates(["text_key"]).select(F.col("text_key").alias(key), F.col("spans").alias(found))
    d = docs.join(spans, text_key() == F.col(key), "left")
    return d.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(mask_found("text", found))).select(columns)


def mask_text(text: str, spans) -> str:
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from ``find_spans``."""
    base = F.filter("spans", lambda s: ~s.startswith("term:"))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
