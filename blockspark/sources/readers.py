"""Readers of edge lists, partitions, Matrix Market files, configurations, result documents, logs and usage tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_COLUMNS = ("Configuration ID", "SUBGRAPHS", "BATCHES", "CACHE_SIZE", "DEGREEPRODUCTSORT", "SPLITINIT", "SPLIT", "MH_PERCENT", "ALGORITHM", "OVERLAP", "NONPARAMETRIC", "NODELTA", "MIX", "GREEDY", "APPROXIMATE", "ASYNC_ITERS")
_CONFIG_SCHEMA = ", ".join(f"`{c}` {'double' if c == 'MH_PERCENT' else 'string' if c in ('DEGREEPRODUCTSORT', 'SPLITINIT', 'SPLIT', 'ALGORITHM', 'OVERLAP') else 'int'}" for c in CONFIG_COLUMNS)


def number(value: Column) -> Column:
    """A double, null where the text is none."""
    return value.cast("string").try_cast("double")


def integer(value: Column) -> Column:
    """A long from an integer or an integral decimal; null otherwise."""
    x = number(value)
    return F.when(x == F.floor(x), x.cast("long"))


def first_number(*values: Column) -> Column:
    return F.coalesce(*[number(v) for v in values])


def _fields(spark: SparkSession, path: str, comments: str) -> DataFrame:
    """Lines as arrays of fields between any white space; blank lines and comments left out; gzip is read by its name."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line <> ''")
    if comments:
        lines = lines.where(~F.substring("line", 1, 1).isin(*comments))
    return lines.select(F.split("line", " ").alias("f"))


def edge_list(spark: SparkSession, path: str, base: int = 1, unit: bool = False, comments: str = "#%", strict: bool = True) -> DataFrame:
    """edges(src, dst, w) from 2 or 3 fields a line; ids less ``base``; weight 1 if it isn't given or ``unit``.

    strict: a line with other fields, or a weight that isn't a positive whole number, is an error; otherwise such a weight is 1 and such
    a line is left out.
    """
    f = _fields(spark, path, comments)
    w = integer(F.get("f", F.lit(2)))
    shape = F.size("f").isin(2, 3) & integer(F.get("f", F.lit(0))).isNotNull() & integer(F.get("f", F.lit(1))).isNotNull()
    if strict:
        bad = F.concat(F.lit("not an edge: "), F.array_join("f", " "))
        f = f.select(F.when(shape, F.col("f")).otherwise(F.raise_error(bad).cast("array<string>")).alias("f"))
        given = F.when(w > 0, w).otherwise(F.raise_error(F.concat(F.lit("not a weight: "), F.array_join("f", " "))).cast("long"))
        weight = F.when(F.size("f") < 3, F.lit(1)).otherwise(given)
    else:
        f = f.where(shape)
        weight = F.when(w > 0, w).otherwise(F.lit(1))
    one = F.lit(1.0) if unit else weight.cast("double")
    return f.select((integer(F.col("f")[0]) - base).alias("src"), (integer(F.col("f")[1]) - base).alias("dst"), one.alias("w"))


def partition(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """assign(v, b) from tab-separated vertex and community; community labels are opaque."""
    return spark.read.csv(path, sep="\t", schema="v long, b long").select((F.col("v") - base).alias("v"), "b")


def with_truth(vertices: DataFrame, truth: DataFrame | None) -> DataFrame:
    """(v, b) of every vertex: -1 where the truth has none; all 0 without a truth."""
    if truth is None:
        return vertices.select("v", F.lit(0).cast("long").alias("b"))
    return vertices.join(truth, "v", "left").select("v", F.coalesce("b", F.lit(-1)).alias("b"))


def matrix_market(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, dict]:
    """(edges, header) of a square coordinate file; a symmetric one gives both directions of what isn't a loop.

    A line's place in the file is the start of its split and its place there, so the banner and the size line are least rows of one
    aggregate, which also counts the entries; nothing is sorted.  strict: another number of entries than the size line's, an index
    outside the matrix, or a weight that isn't a positive whole number is an error; else such a weight is 1 and the header says how
    many entries were ``found``.
    """
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(line.alias("line"), place.alias("at"))
    entry = (F.substring("line", 1, 1) != "%") & (F.col("line") != "")
    first = lines.agg(F.min_by("line", "at").alias("banner"), F.min_by("line", F.when(entry, F.col("at"))).alias("size"), F.min(F.when(entry, F.col("at"))).alias("at"), F.count_if(entry).alias("n")).first()
    banner = (first["banner"] or "").lower().split()
    if banner[:3] != ["%%matrixmarket", "matrix", "coordinate"]:
        raise ValueError("not a Matrix Market coordinate file")
    size = (first["size"] or "").split()
    if len(size) != 3 or not all(x.isdigit() for x in size):
        raise ValueError(f"not a size line: {first['size']}")
    rows, cols, entries = map(int, size)
    if rows != cols:
        raise ValueError("the matrix isn't square")
    found = first["n"] - 1
    if strict and found != entries:
        raise ValueError(f"{entries} entries declared, {found} found")
    head = F.struct(F.lit(first["at"]["split"]).alias("split"), F.lit(first["at"]["row"]).alias("row"))
    f = lines.where(entry & (F.col("at") != head)).select("line", F.split("line", " ").alias("f"))
    src, dst, w = integer(F.col("f")[0]), integer(F.get("f", F.lit(1))), integer(F.get("f", F.lit(2)))
    inside = src.between(1, rows) & dst.between(1, rows)
    given = F.size("f") > 2
    if strict:
        right = F.size("f").isin(2, 3) & inside & (~given | (w > 0))
        f = f.select(F.when(right, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not an entry: "), "line")).cast("array<string>")).alias("f"))
    else:
        f = f.where(inside)
    e = f.select((src - 1).alias("src"), (dst - 1).alias("dst"), F.when(given & (w > 0), w).otherwise(F.lit(1)).cast("double").alias("w"))
    symmetric = "symmetric" in banner
    if symmetric:
        from ..operators.graph import undirect

        e = undirect(e)
    return e, {"vertices": rows, "entries": entries, "found": found, "undirected": symmetric}


def configurations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The 16 columns of a configuration file, fields between bars; strict: a malformed line is an error, else it is left out."""
    return spark.read.csv(path, sep="|", comment="#", schema=_CONFIG_SCHEMA, mode="FAILFAST" if strict else "DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def last_document(text: str | None) -> str | None:
    """The last of the JSON documents that follow one another in a text; null without one."""
    decoder, at, found = json.JSONDecoder(), 0, None
    text = text or ""
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return found
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            return found
        found, at = text[at:end], end


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): each file's last JSON document, as text."""
    @F.pandas_udf("string")
    def last(texts: pd.Series) -> pd.Series:
        return texts.map(last_document)

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), last("value").alias("document"))


def result_partition(docs: DataFrame, first_vertex: int = 0, document: str = "document") -> DataFrame:
    """(path, v, b) of the documents' ``Results``: pairs of vertex and block, or blocks alone from ``first_vertex`` on."""
    pairs = F.from_json(F.get_json_object(document, "$.Results"), "array<array<long>>")
    flat = F.from_json(F.get_json_object(document, "$.Results"), "array<long>")
    nested = F.get_json_object(document, "$.Results").rlike(r"^\s*\[\s*\[")
    as_pairs = F.transform(pairs, lambda x: F.struct(x[0].alias("v"), x[1].alias("b")))
    as_flat = F.transform(flat, lambda x, i: F.struct((i + first_vertex).cast("long").alias("v"), x.alias("b")))
    keep = [c for c in docs.columns if c != document]
    return docs.select(*keep, F.explode(F.when(nested, as_pairs).otherwise(as_flat)).alias("x")).select(*keep, "x.*")


#: fixed values: patterns of a solver's log, the first that matches wins
RUNTIME_PATTERNS = (r"(?i)total runtime\s*[:=]\s*([0-9.eE+-]+)", r"(?i)runtime\s*(?:\(s\))?\s*[:=]\s*([0-9.eE+-]+)", r"(?i)elapsed\s*[:=]\s*([0-9.eE+-]+)")
ITERATION_PATTERNS = (r"(?i)iterations?\s*[:=]\s*(\d+)", r"(?i)iteration\s+(\d+)")


def log_value(text: Column, patterns: tuple[str, ...]) -> Column:
    """The last match of the first pattern that matches, as a number."""
    return F.coalesce(*[number(F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))) for p in patterns])


def log_metrics(logs: DataFrame, text: str = "text") -> DataFrame:
    return logs.withColumn("runtime", log_value(F.col(text), RUNTIME_PATTERNS)).withColumn("iterations", log_value(F.col(text), ITERATION_PATTERNS).cast("long"))


def performance(result: Column, perf: Column, log: Column) -> Column:
    """Runtime from the result document, else the performance document, else the log."""
    keys = ("$['Runtime (s)']", "$.Runtime", "$.runtime", "$.runtime_seconds")
    return F.coalesce(*[number(F.get_json_object(doc, k)) for doc in (result, perf) for k in keys], log_value(log, RUNTIME_PATTERNS))


def resource_usage(samples: DataFrame, *keys: str) -> DataFrame:
    """For each key: runtime (span of Timestamp), average and maximum CPU use (100 - idle), maximum memory in MB."""
    return samples.groupBy(*keys).agg((F.max("Timestamp") - F.min("Timestamp")).alias("runtime"), (100 - F.avg("CPU_Idle")).alias("avg_cpu"), (100 - F.min("CPU_Idle")).alias("max_cpu"), F.max("Mem_Used_MB").alias("max_memory"))


def key_values(text: Column) -> Column:
    """A map from lines of key=value."""
    return F.str_to_map(F.regexp_replace(text, r"\s*=\s*", "="), F.lit("\n"), F.lit("="))


def run_state(log: Column, result: Column, marker: str = "Success") -> Column:
    """done, oot (out of time), running or pending, from a run's log and result."""
    return F.when(result.isNotNull() & log.contains(marker), "done").when(log.rlike(r"(?i)time ?limit|out of time|\bOOT\b"), "oot").when(log.isNotNull(), "running").otherwise("pending")


def sweep_files(spark: SparkSession, folder: str) -> DataFrame:
    """(theta, run, path) of folder/theta_*/run_*/result.json, in the order of numbers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").load(folder).select("path")
    x = files.select(F.regexp_extract("path", r"theta_(\d+)/", 1).alias("theta"), F.regexp_extract("path", r"run_(\d+)/", 1).alias("run"), "path")
    return x.where("theta <> '' and run <> ''").select(F.col("theta").cast("int"), F.col("run").cast("int"), "path").orderBy("theta", "run")


def shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All shards of a measurement table."""
    return spark.read.csv(pattern, header=True, schema=schema)


def feature_columns(spark: SparkSession, path: str) -> list[str]:
    """A feature manifest: one column a line; a repeated one is an error."""
    names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]  # some dozens of lines
    if len(set(names)) != len(names):
        raise ValueError("a feature column is listed twice")
    return names


def name_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, state): names that are missing or extra."""
    return expected.exceptAll(found).withColumn("state", F.lit("missing")).union(found.exceptAll(expected).withColumn("state", F.lit("extra")))
