"""Importance resampling towards a target distribution, in DataFrame functions alone.

A text's features are its runs of one and two consecutive words, hashed to buckets (crc32 modulo their number).  All source texts give
a count s to every bucket, all target texts a count t; a bucket's gain is the smoothed log ratio of the two shares, and a document's
weight is the mean gain of its features.  Adding a Gumbel variate drawn from the id and taking the highest scores is sampling without
replacement in proportion to exp(weight / 1000).

Shape of the jobs: grams are exploded and summed to buckets map-side, so a shuffle has at most one row a bucket from each task; the gain
table has one row a bucket, which bounds its broadcast; exploded grams meet it and are summed back to one row a document before the
shuffle by document.  The order of all documents is a range partitioning; its partitions' running counts (one row each) give the ranks.

Rows: null and empty texts have no features and weight 0.  A null doc_id is hashed as an empty one and comes last among equal scores.
Equal ids with different texts are ordered by the texts' md5; repeated rows get a row and a rank each.  An empty table gives no rows, an
empty target gains from the smoothing alone.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_key

#: What separates words: every ASCII character but 0-9 and a-z (texts are lower-cased before).
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _APART), "")


def _grams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets))


def _exploded(docs: DataFrame, keep: list[Column], buckets: int) -> DataFrame:
    """keep, the gram's place and its bucket; a text without words has one row of nulls."""
    d = docs.select(*keep, _words(F.col("text")).alias("w"))
    d = d.select("*", F.posexplode_outer(_grams(F.col("w"))).alias("place", "gram")).drop("w")
    return d.withColumn("bucket", bucket_of(F.col("gram"), buckets)).drop("gram")


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10000) -> DataFrame:
    """(bucket, source, target, gain) for every bucket, seen or not."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return _exploded(df, [], buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(counted(docs, "source"), "bucket", "left").join(counted(target, "target"), "bucket", "left")
    both = checkpoint(both.na.fill(0, ["source", "target"]))
    total = both.agg(F.sum("source").alias("source"), F.sum("target").alias("target")).first()
    ratio = (F.col("target") + 1.0) * F.lit(total["source"] + float(buckets)) / ((F.col("source") + 1.0) * F.lit(total["target"] + float(buckets)))
    return both.withColumn("gain", F.floor(1000.0 * F.log(ratio)))


def _gumbel(doc_id: Column, seed: int) -> Column:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: DataFrame, buckets: int = 10000, seed: int = 7) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score) of every row of docs; key is the md5 of the text."""
    e = _exploded(docs, [F.col("doc_id"), text_key().alias("key")], buckets)
    e = e.join(F.broadcast(gain.select("bucket", "gain")), "bucket", "left")  # a row a bucket
    d = e.groupBy("doc_id", "key").agg(F.count("bucket").alias("grams"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"), F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"))
    # all rows of one id and one text were summed together; each gets its own row again
    d = d.select("doc_id", "key", F.expr("grams div copies").alias("n_features"), F.expr("total div copies").alias("total"), F.expr("explode(sequence(1L, copies))").alias("copy"))
    d = d.withColumn("weight", F.expr("case when n_features > 0 then (total - pmod(total, n_features)) div n_features else 0L end"))
    return d.select("doc_id", "key", "copy", F.expr("(n_features + 1) div 2").alias("n_words"), "n_features", "weight", (F.col("weight") + _gumbel(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10000, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row; rank is null for what isn't drawn.

    Of the N documents with at least min_words words the floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id.
    """
    d = weigh(docs, gains(docs, target, buckets), buckets, seed).withColumn("fit", F.col("n_words") >= min_words)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"), F.asc("copy")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id of a row holds its partition and its place there
    d = checkpoint(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_at", 33))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"), F.count(F.when(F.col("fit"), 1)).alias("_fit"))
    every = Window.orderBy("_part")  # over a row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_fit").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    d = d.join(F.broadcast(sizes), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("fit") & (place <= F.expr(f"({int(percent)}L * _all) div 100"))
    return d.select("doc_id", "n_features", "weight", "score", F.when(drawn, place).alias("rank"), "n_words")


def oracle_sql(percent: int = 25, min_words: int = 20, buckets: int = 10000, seed: int = 7) -> str:
    """DuckDB has no crc32, so it is computed here once for each distinct feature, from the polynomial."""
    return f"""
    with crc as materialized (
        select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
    ), texts as (
        select 'd' as side, row_number() over (order by doc_id, text) as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
        union all
        select 'b', row_number() over (), item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark
    ), grams as materialized (
        select side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from texts
    ), bytes as (
        select g, list_transform(range(octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), 2 * k + 1, 2))::bigint) as b from (select distinct g from grams)
    ), hashed as materialized (
        select g, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % {buckets} as bucket from bytes, crc
    ), counts as (
        select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from grams join hashed using (g) group by bucket
    ), totals as (
        select sum(s)::double as s, sum(t)::double as t from counts
    ), gain as (
        select bucket, floor(1000 * ln((c.t + 1)::double * (totals.s + {buckets}) / ((c.s + 1)::double * (totals.t + {buckets}))))::bigint as gain from counts c, totals
    ), sums as (
        select r, sum(gain)::double as total, count(*) as n from grams join hashed using (g) join gain using (bucket) where side = 'd' group by r
    ), scored as (
        select doc_id, r, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(floor(total / n), 0)::bigint as weight,
            ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
        from texts left join sums using (r) where side = 'd'
    ), final as (
        select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored
    ), placed as (
        select *, row_number() over (order by n_words >= {min_words} desc, score desc, doc_id nulls last, r) as place, count(*) filter (n_words >= {min_words}) over () as fit from final
    )
    select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= {min_words} and place <= {percent} * fit // 100 then place::bigint end as rank, n_words::bigint as n_words from placed
    """
