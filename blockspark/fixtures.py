"""Graphs, partitions and measurements derived from the TPC-H-like tables; each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import spread


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _first_supplier(self) -> DataFrame:
        return self.customer.agg((F.max("c_custkey") + 1).alias("nc"))

    def _ordered(self, n: int) -> DataFrame:
        """(o_custkey, l_suppkey) of the ``n`` line items, joined in tasks of bounded size."""
        items, orders = self.lineitem.select("l_orderkey", "l_suppkey"), self.orders.select("o_orderkey", "o_custkey")
        return spread(items, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")

    def g_cs(self) -> DataFrame:
        """customer -> supplier, w = line items; suppliers come after customers."""
        n = self.lineitem.count()
        e = spread(self._ordered(n), n, "o_custkey", "l_suppkey").groupBy(F.col("o_custkey").alias("src"), "l_suppkey").agg(F.count("*").cast("double").alias("w"))
        return e.crossJoin(F.broadcast(self._first_supplier())).select("src", (F.col("nc") + F.col("l_suppkey")).alias("dst"), "w")

    def l_cs(self) -> DataFrame:
        """The same graph with an edge of weight 1 for each line item: for what only sums weights by block, labels can come first."""
        e = self._ordered(self.lineitem.count())
        return e.crossJoin(F.broadcast(self._first_supplier())).select(F.col("o_custkey").alias("src"), (F.col("nc") + F.col("l_suppkey")).alias("dst"), F.lit(1.0).alias("w"))

    def v_cs(self) -> DataFrame:
        s = self.supplier.crossJoin(F.broadcast(self._first_supplier())).select((F.col("nc") + F.col("s_suppkey")).alias("v"))
        return self.customer.select(F.col("c_custkey").alias("v")).union(s)

    def p_nation(self, split: int = 0) -> DataFrame:
        """customers and suppliers by nation; supplier labels + split."""
        s = self.supplier.crossJoin(F.broadcast(self._first_supplier())).select((F.col("nc") + F.col("s_suppkey")).alias("v"), (F.col("s_nationkey") + split).cast("long").alias("b"))
        return self.customer.select(F.col("c_custkey").alias("v"), F.col("c_nationkey").cast("long").alias("b")).union(s)

    def p_region(self) -> DataFrame:
        n = self.nation.select(F.col("n_nationkey").cast("long").alias("b"), F.col("n_regionkey").cast("long").alias("region"))
        return self.p_nation().join(F.broadcast(n), "b").select("v", F.col("region").alias("b"))  # nations: 25 rows

    def p_mkt(self) -> DataFrame:
        """customers by market segment, numbered in order of name"""
        from .operators.blockmodel import relabel

        return relabel(self.customer.select(F.col("c_custkey").alias("v"), F.col("c_mktsegment").alias("b")))

    def g_nn(self) -> DataFrame:
        """nation -> nation of customer and supplier, w = line items; with self loops."""
        e = self.lineitem.select("l_orderkey", "l_suppkey").join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        e = e.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return e.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("w"))

    def v_nn(self) -> DataFrame:
        return self.nation.select(F.col("n_nationkey").cast("long").alias("v"))

    def p_nn(self) -> DataFrame:
        return self.nation.select(F.col("n_nationkey").cast("long").alias("v"), F.col("n_regionkey").cast("long").alias("b"))

    def g_raw(self) -> DataFrame:
        """line items as edges (repeated): nation of customer -> nation of supplier, w = quantity, with the line's key."""
        e = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return e.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber")

    def g_pp(self) -> DataFrame:
        """parts that share an order, u < v, once."""
        n = self.lineitem.count()
        a = spread(self.lineitem.select("l_orderkey", F.col("l_partkey").alias("u")), n, "l_orderkey")
        b = spread(self.lineitem.select("l_orderkey", F.col("l_partkey").alias("v")), n, "l_orderkey")
        return spread(a.join(b, "l_orderkey").where("u < v").select("u", "v"), 2 * n, "u", "v").distinct()

    def o_pp(self) -> tuple[DataFrame, int]:
        """(g, v): the parts of each order, and how many rows; g_pp joins all parts of an order."""
        return self.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("v")), self.lineitem.count()

    def v_pp(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("v"))

    def g_pp_edges(self) -> DataFrame:
        return self.g_pp().select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("w"))

    def p_brand(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("v"), F.regexp_extract("p_brand", r"(\d+)\s*$", 1).cast("long").alias("b"))

    def measurements(self) -> DataFrame:
        """graph = supplier's nation, configuration = brand number, run = line number % 3 + 1, with four outcomes."""
        e = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        e = e.groupBy(F.col("n_name").alias("graph"), F.regexp_extract("p_brand", r"(\d+)\s*$", 1).cast("int").alias("config"), (F.col("l_linenumber") % 3 + 1).alias("run"))
        return e.agg(F.avg("l_discount").alias("inverse_hnorm"), F.avg("l_tax").alias("modularity"), F.avg(F.col("l_discount") * F.col("l_tax")).alias("conductance"), (F.sum("l_quantity") / 1000).alias("teps"))


#: The same definitions as common table expressions.
CTE = {
    "nc": "nc as (select max(c_custkey) + 1 as n from customer)",
    "g_cs": "g_cs as (select o_custkey as src, (select n from nc) + l_suppkey as dst, cast(count(*) as double) as w from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey)",
    "v_cs": "v_cs as (select c_custkey as v from customer union all select (select n from nc) + s_suppkey from supplier)",
    "p_nation": "p_nation as (select c_custkey as v, cast(c_nationkey as bigint) as b from customer union all select (select n from nc) + s_suppkey, s_nationkey from supplier)",
    "p_split": "p_split as (select c_custkey as v, cast(c_nationkey as bigint) as b from customer union all select (select n from nc) + s_suppkey, s_nationkey + 25 from supplier)",
    "p_region": "p_region as (select v, cast(n_regionkey as bigint) as b from p_nation join nation on n_nationkey = b)",
    "p_mkt": "p_mkt as (select c_custkey as v, dense_rank() over (order by c_mktsegment) - 1 as b from customer)",
    "g_nn": "g_nn as (select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, cast(count(*) as double) as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)",
    "v_nn": "v_nn as (select cast(n_nationkey as bigint) as v from nation)",
    "p_nn": "p_nn as (select cast(n_nationkey as bigint) as v, cast(n_regionkey as bigint) as b from nation)",
    "g_raw": "g_raw as (select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, l_quantity as w, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)",
    "g_pp": "g_pp as (select distinct a.l_partkey as u, b.l_partkey as v from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)",
    "v_pp": "v_pp as (select p_partkey as v from part)",
    "p_brand": "p_brand as (select p_partkey as v, cast(regexp_extract(p_brand, '(\\d+)\\s*$', 1) as bigint) as b from part)",
    "m_raw": "m_raw as (select n_name as graph, cast(regexp_extract(p_brand, '(\\d+)\\s*$', 1) as integer) as config, l_linenumber % 3 + 1 as run, avg(l_discount) as inverse_hnorm, avg(l_tax) as modularity, avg(l_discount * l_tax) as conductance, sum(l_quantity) / 1000 as teps from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3)",
}


def sql(body: str, *names: str, extra: str = "") -> str:
    """body after the named common table expressions and ``extra`` ones."""
    need = list(names)
    if any(n in ("g_cs", "v_cs", "p_nation", "p_split", "p_region") for n in need):
        need = ["nc", *need]
    if "p_region" in need and "p_nation" not in need:
        need.insert(need.index("p_region"), "p_nation")
    parts = [CTE[n] for n in dict.fromkeys(need)] + ([extra] if extra else [])
    return "with " + ",\n".join(parts) + "\n" + body if parts else body
