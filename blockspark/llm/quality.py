"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a Column that says "reject".  On a sample each rule's cost (the time it takes over the sample) and selectivity (the share it
rejects of what is left) are measured, and rules are ordered by rejection per cost: the next rule is the one that removes most of the
remaining sample per second.  The verdict is one CASE expression in that order, so a document pays only for the rules up to the first
that rejects it.  The order changes the cost, never the verdict, and the reason that is given for a rejection is the first in the
rules' own order, whatever was measured.

``keep`` puts the base rules into the same cascade, so the repeated windows, the dearest count, are looked for only in what the rules
before let pass; ``assess`` must return that count for every row and has it anyway.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule, as a Java character class.
_WHITE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _next(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0)))


def repeat_words(words: Column) -> Column:
    """The words inside 3-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes of their words.  Only texts with a repeated window sort their windows; the covered words
    follow from the gaps between the places.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda x, c: F.xxhash64(x, c))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = _bind(placed, lambda s: F.filter(F.zip_with(s, _next(s), lambda p, q: F.struct((p["x"] == q["x"]).alias("e"), p["i"].alias("a"), q["i"].alias("b"))), lambda r: r["e"]))
        at = _bind(same, lambda s: F.sort_array(F.array_distinct(F.concat(F.transform(s, lambda r: r["a"]), F.transform(s, lambda r: r["b"])))))
        gaps = _bind(at, lambda p: F.zip_with(p, _next(p), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    return _bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")


def _counted(docs: DataFrame) -> DataFrame:
    """docs' whole ``row``, doc_id, text (null: empty), the words w, and COUNTS (long)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.array_remove(F.split("text", f"{_WHITE}+"), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # a generator keeps later filters above: pushed below, they would evaluate all of the above once for each mention
    return d.select("row", "doc_id", "text", "w", F.inline(F.array(counts)))


def features(docs: DataFrame) -> DataFrame:
    """docs' doc_id, text (null: empty) and whole ``row`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    d = _counted(docs)
    return d.select("row", "doc_id", "text", *COUNTS, F.inline(F.array(F.struct(repeat_words(F.col("w")).alias("n_repeat_words")))))


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[], Column]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _letters() -> Column:
    return F.char_length(F.regexp_replace("text", r"\P{L}+", ""))


#: The base as rules of the cascade, on the columns of ``_counted``.
BASE = (
    Rule("short", lambda: F.col("n_words") < 50),
    Rule("repetition", lambda: 100 * repeat_words(F.col("w")) > 50 * F.col("n_words")),
)

#: The production rules, on the counts.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("bars", lambda: F.char_length(F.regexp_replace("text", r"[^|]+", "")) * 20 > F.col("n_words")),
    Rule("letters", lambda: _letters() * 10 < F.col("word_chars") * 8),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("exclamation", lambda: F.char_length(F.regexp_replace("text", r"[^!]+", "")) * 5 > F.col("n_words")),
    Rule("capitals", lambda: F.char_length(F.regexp_replace("text", r"\P{Lu}+", "")) * 2 > _letters()),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what is left) in the order of rejection per cost, from about ``sample_rows`` documents.

    Those that fail the base are not in the sample, unless rules of the base are to be ordered: the cascade doesn't see them either.
    """
    n = docs.count()
    some = docs.sample(min(1.0, sample_rows / n), seed) if n else docs
    sample = (_counted(some) if set(BASE) & set(rules) else features(some).where(~base_failed())).persist()
    try:
        flags = [r.reject().cast("int").alias(f"r{k}") for k, r in enumerate(rules)]

        def seconds(*what: Column) -> float:
            start = time.perf_counter()
            sample.agg(*what).collect()
            return time.perf_counter() - start

        seconds(F.count("*"))
        empty = min(seconds(F.count("*")) for _ in range(2))
        cost = [max(1e-4, min(seconds(F.sum(f)) for _ in range(2)) - empty) for f in flags]
        # how often each pattern of rejections occurs: at most 2 ** len(rules) rows
        patterns = sample.select(*flags).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()
    finally:
        sample.unpersist()
    left = [([bool(p[f"r{k}"]) for k in range(len(rules))], p["count"]) for p in patterns]
    order, rest = [], list(range(len(rules)))
    while rest:
        total = sum(c for _, c in left) or 1
        share = {k: sum(c for p, c in left if p[k]) / total for k in rest}
        best = max(rest, key=lambda k: (share[k] / cost[k], -cost[k], -k))
        order.append((rules[best], cost[best], share[best]))
        left = [(p, c) for p, c in left if not p[best]]
        rest.remove(best)
    return order


def verdict(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, else null; a rule that is null doesn't reject."""
    out = F
    for r in rules:
        out = out.when(r.reject(), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of every row.

    Null and empty texts have no words and fail the base; repeated rows get a row each; an empty table gives none; extra columns are
    ignored.  kept: not base_failed, and no rule of the cascade rejects.  rejected_by: ``base``, or the first rule in their own order.
    """
    order = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    d = features(docs).withColumn("base_failed", base_failed())
    passes = ~F.col("base_failed") & verdict(order).isNull()
    d = d.withColumn("kept", passes).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).when(~F.col("kept"), verdict(rules)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs, all columns as they are, that neither the base nor a rule rejects."""
    order = [r for r, _, _ in order_rules(docs, BASE + rules, sample_rows)]
    return _counted(docs).where(verdict(order).isNull()).select("row.*")
