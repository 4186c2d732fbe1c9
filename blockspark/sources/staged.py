"""Writes that appear whole or not at all, and appends that count once however often they are repeated.

A table is written to a folder beside its place and renamed when it is complete.  An append has a writer's name: its rows lie in
``writer=<name>`` under the table's folder, so a repeated or restarted append finds its own rows there and adds none.  The header is a
file of its own, put in place once.  Readers see only complete folders; what a killed write leaves begins with an underscore, which Spark
passes over, and the next write of that name clears it away.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "_header.csv"


def general(x: Column) -> Column:
    """A number as %g prints it: six significant digits without trailing zeros, exponents below -4 and from 6 on."""
    x = x.cast("double")
    text = F.format_string("%.5e", x)
    exponent = F.regexp_extract(text, "e([+-][0-9]+)$", 1).cast("int")
    bare = lambda s: F.regexp_replace(F.when(s.contains("."), F.regexp_replace(s, "0+$", "")).otherwise(s), r"\.$", "")
    out = F.when(x == 0, "0")
    for e in range(-4, 6):
        out = out.when(exponent == e, bare(F.format_string(f"%.{5 - e}f", x)))
    return F.when(x.isNotNull(), out.otherwise(F.concat(bare(F.regexp_extract(text, "^[^e]+", 0)), F.regexp_extract(text, "e.*$", 0))))


def _fs(spark: SparkSession, path: str):
    """(file system, path) of the store that holds the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _clear(spark: SparkSession, folder: str, prefix: str) -> None:
    fs, p = _fs(spark, folder)
    if fs.exists(p):
        for status in fs.listStatus(p):
            if status.getPath().getName().startswith(prefix):
                fs.delete(status.getPath(), True)


def _renamed(spark: SparkSession, temporary: str, path: str) -> bool:
    """temporary becomes path; False, and temporary is deleted, if path is there already."""
    fs, new = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(temporary)
    if not fs.exists(new) and fs.rename(old, new):
        return True
    fs.delete(old, True)
    return False


def _place(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder or ".", name


def whole(df: DataFrame, path: str, by: list[str] | None = None, form: str = "csv", **options) -> None:
    """df as CSV (or another form) at ``path``, which must not exist: all of it or nothing; ``by`` columns name folders."""
    spark = df.sparkSession
    folder, name = _place(path)
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _clear(spark, folder, f"_{name}.")
    temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
    df.write.partitionBy(*by or []).format(form).options(**options).save(temporary)
    if not _renamed(spark, temporary, path):
        raise FileExistsError(path)


def edges(df: DataFrame, path: str, base: int = 1) -> None:
    """edges(src, dst, w) as tab-separated lines, weights as %g prints them."""
    whole(df.select((F.col("src") + base).alias("src"), (F.col("dst") + base).alias("dst"), general(F.col("w")).alias("w")), path, sep="\t")


def append(df: DataFrame, path: str, writer: str) -> bool:
    """Adds df's rows to the table at ``path`` under the writer's name; False if that writer's rows are there already.

    All appends have the first one's columns, in its order; others are an error.
    """
    if not re.fullmatch(r"[A-Za-z0-9.-]+", writer):
        raise ValueError(f"not a writer's name: {writer}")
    spark = df.sparkSession
    fs, own = _fs(spark, f"{path}/writer={writer}")
    if fs.exists(own):
        return False
    known = columns(spark, path)
    if known is None:
        temporary = f"{path}/_header.{uuid.uuid4().hex}"
        spark.createDataFrame([(",".join(df.columns),)], "line string").coalesce(1).write.text(temporary)
        _renamed(spark, temporary, f"{path}/{HEADER}")
        known = columns(spark, path)
    if known != df.columns:
        raise ValueError(f"the table has the columns {known}, not {df.columns}")
    _clear(spark, path, f"_staged-{writer}.")
    temporary = f"{path}/_staged-{writer}.{uuid.uuid4().hex}"
    df.write.csv(temporary)
    return _renamed(spark, temporary, f"{path}/writer={writer}")


def columns(spark: SparkSession, path: str) -> list[str] | None:
    """The table's columns; None before the first append."""
    fs, p = _fs(spark, f"{path}/{HEADER}")
    if not fs.exists(p):
        return None
    stream = [f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    return spark.sparkContext.textFile(stream[0]).first().split(",")


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all writers, with the column ``writer``; values are text."""
    names = columns(spark, path)
    if names is None:
        raise FileNotFoundError(path)
    return spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in names) + ", writer string")
