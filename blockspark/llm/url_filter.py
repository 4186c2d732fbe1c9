"""URL filtering: host and path rules first, then a list of canonical URLs, in DataFrame functions alone.

Listed URLs are brought to a canonical form and set in a blocked Bloom filter: a key has one block of 256 bits, and one bit in each of
the block's eight lanes, so a lookup touches one row of four longs.  The filter is a table with a row a block; its number of blocks
is fixed by the list's count and bounded by MAX_BLOCKS, which bounds its broadcast.  A larger list only lets more false positives pass.  Pages whose
block lacks a bit are surely unlisted and are never shuffled; possible hits meet the listed URLs by an exact hash join, which AQE splits
when one URL has very many pages.

Rows: a null URL, or one without ``://``, has an empty host and path, no rule, and is on no list.  Repeated rows are judged alike, each
with a row of its own; an empty list or table gives no hits or rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: At most so many blocks of 256 bits (8 MB).
MAX_BLOCKS = 1 << 18
BITS_A_KEY = 16
_LANES = ("l0", "l1", "l2", "l3")

#: Host, path and verdict; fixed values of production.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Query fields that don't name a page.
_TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def _rest() -> Column:
    """What follows the first ://, else null."""
    return F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end")


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url with host, path and canonical."""
    d = pages.select("page_id", "url", _rest().alias("_rest"))
    d = d.select("page_id", "url", "_rest", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_host"))
    path, query = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    d = d.select("page_id", "url", "_host", path.alias("_path"), query.alias("_query"))
    fields = F.array_join(F.array_sort(F.filter(F.split("_query", "&"), lambda x: (x != "") & ~x.rlike(_TRACKING))), "&")
    site = F.regexp_replace(F.regexp_replace("_host", r"^(www|m)\.", ""), r":(80|443)$", "")
    canonical = F.concat(site, F.regexp_replace("_path", r"/+$", ""), F.when(fields != "", F.concat(F.lit("?"), fields)).otherwise(""))
    return d.select("page_id", "url", F.coalesce("_host", F.lit("")).alias("host"), F.coalesce("_path", F.lit("")).alias("path"), canonical.alias("canonical"))


def rule(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits host and path, else null; of equally long ones the longer host's, then the first."""
    out = F
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = out.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).cast("int")


def _bits() -> list[Column]:
    """The four longs that hold a key's eight bits."""
    h = F.xxhash64("canonical", F.lit("bits"))

    def one(shift: int, base: int) -> Column:
        at = (F.shiftright(h, shift).bitwiseAND(F.lit(31)) + base).cast("int")
        return F.call_function("shiftleft", F.expr("1L"), at)

    return [one(12 * k, 0).bitwiseOR(one(12 * k + 6, 32)) for k in range(4)]


def blocked_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """A row (block, l0, l1, l2, l3) for each block that a key of ``canonical`` falls in, and the number of blocks."""
    want = listed.count() * BITS_A_KEY // 256
    n = min(MAX_BLOCKS, 1 << max(4, want.bit_length()))
    d = listed.select(_block(n).alias("block"), *[b.alias(name) for b, name in zip(_bits(), _LANES, strict=True)])
    return d.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in _LANES]), n


def possible(pages: DataFrame, words: DataFrame, n_blocks: int) -> DataFrame:
    """pages with ``maybe``: false for what is surely not listed."""
    met = pages.withColumn("block", _block(n_blocks)).join(F.broadcast(words), "block", "left")  # at most MAX_BLOCKS rows
    every = [F.col(name).bitwiseAND(b) == b for b, name in zip(_bits(), _LANES, strict=True)]
    hit = F.coalesce(every[0] & every[1] & every[2] & every[3], F.lit(False)) & F.col("canonical").isNotNull()
    return met.withColumn("maybe", hit).drop("block", *_LANES)


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every page; listed is a table of URLs (column url) to block.

    verdict: the rule's; without one, block if the canonical URL is that of a listed one, else allow.
    """
    keys = checkpoint(parts(listed.select(F.lit(None).cast("long").alias("page_id"), "url")).where("canonical is not null").select("canonical").distinct())
    words, n = blocked_filter(keys)
    d = possible(parts(pages), words, n)
    hits = d.where("maybe").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path", "canonical"]
    d = hits.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed")).union(d.where("not maybe").select(*columns, F.lit(False)))
    d = d.withColumn("r", rule(rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return d.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "canonical", "listed")


def junk_urls(pages: DataFrame, percent: int = 3) -> DataFrame:
    """The list of the query: URLs of pages of whose html at least ``percent`` in a hundred characters are one of # * % $ |."""
    marks = F.char_length("html") - F.char_length(F.regexp_replace("html", "[#*%$|]+", ""))
    return pages.where(100 * marks >= percent * F.greatest(F.char_length("html"), F.lit(1))).select("url")


def oracle_sql(percent: int = 3) -> str:
    return rf"""
    with cut as (
        select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
    ), split as (
        select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query, rest is not null as good
        from cut
    ), named as (
        select *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '{_TRACKING}'))), '&') as fields from split
    ), whole as (
        select page_id, html, coalesce(host, '') as host, coalesce(path, '') as path,
            case when good then regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                || case when coalesce(fields, '') <> '' then '?' || fields else '' end end as canonical
        from named
    ), listed as (
        select distinct canonical from whole
        where canonical is not null and 100 * (length(html) - length(regexp_replace(html, '[#*%$|]+', '', 'g'))) >= {percent} * greatest(length(html), 1)
    ), ruled as (
        select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
        from whole
    )
    select page_id, host, path, rule, ruled.canonical, l.canonical is not null as listed,
        case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or l.canonical is not null then 'block' else 'allow' end as verdict
    from ruled left join listed l on ruled.canonical = l.canonical
    """
