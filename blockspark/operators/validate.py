"""Checks of tables: what is broken, how often, and where first; columns in order; stored parts; constants that runs carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report(df: DataFrame, key: list[str], rules: dict[str, Column], first: int = 5) -> DataFrame:
    """(check, violations, examples) of every rule, a Column that is true where a row breaks it; null breaks nothing.

    examples: the keys of the first such rows in key order, parts of a key joined by ``::``, keys by ``, ``; empty without any.  Each
    task passes on no more than ``first`` rows of a rule.
    """
    names = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(r, F.lit(False)).alias("broken")) for n, r in rules.items()])
    broken = df.select(*key, F.explode(F.filter(names, lambda x: x["broken"])).alias("x")).select(*key, "x.check")
    counts = broken.groupBy("check").agg(F.count("*").alias("violations"))
    early = broken.withColumn("__at", F.row_number().over(Window.partitionBy("check").orderBy(*key))).where(F.col("__at") <= first)
    names_of = early.groupBy("check").agg(F.array_sort(F.collect_list(F.struct("__at", F.concat_ws("::", *[F.col(k).cast("string") for k in key]).alias("k")))).alias("x"))
    every = df.sparkSession.createDataFrame([(n,) for n in rules], "check string")
    x = every.join(counts, "check", "left").join(names_of, "check", "left")
    return x.select("check", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.coalesce(F.array_join("x.k", ", "), F.lit("")).alias("examples"))


def or_error(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """df, if it breaks no rule; else an error that names each broken rule with its first five rows."""
    bad = report(df, key, rules).where("violations > 0").orderBy("check").collect()  # a row a rule
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']} rows, first {r['examples']}" for r in bad))
    return df


def in_order(df: DataFrame, base: list[str], params: list[str] = ()) -> DataFrame:
    """df's columns: base, then params, then the others as they are; a base column that isn't there is an error."""
    missing = [c for c in base if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing[:5]}")
    front = [*base, *[c for c in params if c in df.columns and c not in base]]
    return df.select(*[F.col(f"`{c}`") for c in [*front, *[c for c in df.columns if c not in front]]])


def stored_part(df: DataFrame, split: DataFrame, part: str, key: str = "graph") -> DataFrame:
    """The rows of df whose key is in the part of split(key, part); a stored key that df hasn't is an error that names the first five."""
    want = split.where(F.col("part") == part).select(key).distinct()
    missing = want.join(df.select(key), key, "left_anti").orderBy(key).limit(5).collect()
    if missing or want.isEmpty():
        raise ValueError(f"part {part}: {'no keys' if not missing else 'missing ' + ', '.join(str(r[key]) for r in missing)}")
    return df.join(want, key, "left_semi")


def averaged_with_constants(runs: DataFrame, outcomes: list[str], constants: list[str], keys: tuple[str, ...] = ("graph", "config"), expected: int | None = None) -> DataFrame:
    """A row for each of keys: means of the outcomes, the constants that all its runs carry, and the number of runs.

    Runs of one key with different constants (null is a value), or another number of runs than expected, are an error.
    """
    same = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in constants]) if constants else F.lit(1)
    x = runs.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in outcomes], *[F.first(c).alias(c) for c in constants], F.count("*").alias("runs"), (F.min(same) != F.max(same)).alias("__differ"))
    rules = {"different constants": F.col("__differ")} | ({f"not {expected} runs": F.col("runs") != expected} if expected is not None else {})
    return or_error(x, list(keys), rules).drop("__differ")
