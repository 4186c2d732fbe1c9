"""What each of five filters removes in every order of applying them, from a histogram of failure masks, in DataFrame functions alone.

A document fails any of the filters A to E; its mask has a bit for each.  A to D follow from the text by native expressions; E (the
text is that of a smaller doc_id) follows from the smallest id of each text.  Per part the documents fall in 32 cells, and every order,
step and count is a sum over cells: no order is ever applied to the documents.

Shape of the jobs: texts are read once and leave as a digest (sha-256) with four bits.  Rows are summed by part, bits and labels, and
of each digest only the row of the smallest id is sought, by a partial aggregate; its copies are those counted less that one.  So no join
is needed that a text with many copies could skew.  The cells (32 a part) are exploded to the 80 pairs of a filter and a set of filters
before it, and those to the 600 steps of 120 orders.

Rows: null text is empty, null source the part ''.  A null doc_id is no smaller than any and no copy of any.  Rows of one id and one
text aren't copies of each other; each counts.  Labels of one id count together: good if any has quality 1, toxic if any has toxic 1.  An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")


def text_mask() -> Column:
    """The bits of A to D, of the columns text (not null) and w (its words)."""
    n = F.size("w")
    fails = [
        n < 50,
        100 * F.size(F.array_distinct("w")) < 65 * n,
        100 * (F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))) > 5 * F.char_length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "part", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"))
    d = d.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), text_mask().alias("bits"))
    d = d.groupBy("doc_id", "digest", "bits", "part").agg(F.count("*").alias("n"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows without an id have no labels, but must not meet in one task
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("digest")))
    d = d.withColumn("key", key).join(marked.select(F.col("doc_id").cast("string").alias("key"), "good", "toxic"), "key", "left").drop("key")
    d = checkpoint(d.na.fill(0, ["good", "toxic"]))
    # as if each row with an id were a copy; then the rows of each text's smallest id are put back
    copy = F.when(F.col("doc_id").isNotNull(), _COPY).otherwise(0)
    counted = d.groupBy("part", (F.col("bits") + copy).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))
    same = d.where("doc_id is not null").groupBy("doc_id", "digest", "bits", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("rows"))
    first = same.groupBy("digest").agg(F.min_by(F.struct("bits", "good", "toxic", "rows"), "doc_id").alias("f")).select("f.bits", "f.good", "f.toxic", F.inline("f.rows"))
    first = first.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))
    back = first.select("part", F.col("bits").alias("mask"), "good", "toxic", "n").union(first.select("part", F.col("bits") + _COPY, "good", "toxic", -F.col("n")))
    every = counted.select("part", "mask", "good", "toxic", "n").union(back)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def _struct_array(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])


def steps(cell: DataFrame) -> DataFrame:
    """Every part's counts for each of the 120 orders and 5 steps."""
    pairs = []
    for k in range(len(FILTERS)):
        others = [1 << j for j in range(len(FILTERS)) if j != k]
        for size in range(len(others) + 1):
            # as many orders have this set before the filter
            pairs += [(1 << k, sum(c), factorial(size) * factorial(len(others) - size)) for c in combinations(others, size)]
    d = cell.select("*", F.inline(_struct_array(pairs, ("own", "before", "orders"))))
    own, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(what: Column, when: Column) -> Column:
        return F.sum(F.when(when, what).otherwise(0))

    n = F.col("n")
    d = d.groupBy("part", "own", "before", "orders").agg(
        total(n, ~own & ~before).alias("kept"),
        total(n, own & ~before).alias("removed"),
        total(n, own & before).alias("redundant"),
        total(n, F.col("mask") == F.col("own")).alias("unique_fails"),
        total(F.col("good"), own & ~before).alias("good_lost"),
        total(F.col("toxic"), own & ~before).alias("toxic_lost"),
    )
    d = d.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "own")))  # 16 rows each
    spark = cell.sparkSession
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    plan = [("".join(p), s + 1, bit[p[s]], sum(bit[f] for f in p[:s])) for p in permutations(FILTERS) for s in range(len(FILTERS))]
    plan = F.broadcast(spark.createDataFrame(plan, "filter_order string, step int, own int, before int"))  # 600 rows
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return d.join(plan, ["own", "before"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    kept and removed: after and by this step; redundant: fail its filter, removed before; unique_fails: fail its filter only; good_lost
    and toxic_lost: removed here with that label; shapley: what the filter removes, summed over the 120 orders.
    """
    return steps(cells(docs, labels))


def oracle_sql() -> str:
    return r"""
    with words as (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), smallest as (
        select text, min(doc_id) as least from words group by text
    ), marks as (
        select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id
    ), masks as (
        select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
            + 16 * coalesce(words.doc_id > least, false)::int as mask
        from words join smallest using (text) left join marks on words.doc_id = marks.doc_id
    ), cells as (
        select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by part, mask
    ), letters as (
        select unnest(['A', 'B', 'C', 'D', 'E']) as f
    ), orders as (
        select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), plan as (
        select filter_order, step, substr(filter_order, step, 1) as f, (1 << (ascii(substr(filter_order, step, 1)) - 65)) as own,
            list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65)))::int as earlier
        from orders, (select unnest([1, 2, 3, 4, 5]) as step)
    ), counted as (
        select part, filter_order, step, f,
            sum(case when mask & (own | coalesce(earlier, 0)) = 0 then n else 0 end) as kept,
            sum(case when mask & own <> 0 and mask & coalesce(earlier, 0) = 0 then n else 0 end) as removed,
            sum(case when mask & own <> 0 and mask & coalesce(earlier, 0) <> 0 then n else 0 end) as redundant,
            sum(case when mask = own then n else 0 end) as unique_fails,
            sum(case when mask & own <> 0 and mask & coalesce(earlier, 0) = 0 then good else 0 end) as good_lost,
            sum(case when mask & own <> 0 and mask & coalesce(earlier, 0) = 0 then toxic else 0 end) as toxic_lost
        from cells, plan group by part, filter_order, step, f
    )
    select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
        good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
    from counted
    """
