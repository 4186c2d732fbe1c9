"""Importance resampling, filter audit and URL filters against plain Python, on odd rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from blockspark.llm import filter_audit, queries, resampling, url_filter

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"word{k % 700}" for k in range(40_000))
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n", "a"),
    (4, "One two THREE é日本 four_five " * 6, "a"),
    (4, "One two THREE é日本 four_five " * 6, "a"),
    (4, "same id, other text", "b"),
    (5, "One two THREE é日本 four_five " * 6, "b"),
    (None, "One two THREE é日本 four_five " * 6, "b"),
    (None, None, None),
    (6, "x" * 70_000, "c"),
    (7, LONG, "c"),
    (8, LONG, "a"),
    (9, "A B C $ D " * 30, "c"),
    (10, " ".join(f"w{k}" for k in range(60)), "c"),
    (11, "a\0b nul 😀 end", ""),
]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 0) for r in rows], "doc_id long, text string, source string, n_words long, bucket string, mask int").repartition(3)


def resampled(rows, target, percent=25, seed=7):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(g.encode()) % 10000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]], len(w)

    own = [(i, t or "", *grams(t)) for i, t, *_ in rows]
    s, t = Counter(b for r in own for b in r[2]), Counter(b for x in target for b in grams(x)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, text, g, n in own:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, text])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, hashlib.md5(r[6].encode()).hexdigest()))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:6]) for r in out), key=str)


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling_of_odd_rows(spark, percent):
    target = ["one two three four", None, "", "word1 word2 word3"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(documents(spark, ODD), bench, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(ODD, target, percent)


def test_resampling_query_and_empty_tables(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled([(r["doc_id"], r["text"]) for r in d.collect()], [r["text"] for r in b.collect()])
    got = queries.op11_importance_resampling(spark, SF)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert resampling.resample(d.limit(0), b).count() == 0
    alone = resampling.resample(d, b.limit(0)).collect()
    assert sorted((tuple(r) for r in alone), key=str) == resampled([(r["doc_id"], r["text"]) for r in d.collect()], [])


def test_one_text_of_a_third_of_all_rows(spark):
    rows = [(k if k % 3 else 0, "hot text of many rows " * 5 if k % 3 == 0 else f"text {k} " * 12, "a") for k in range(90)]
    bench = spark.createDataFrame([(1, "text 5 of many")], "item_id long, text string")
    got = resampling.resample(documents(spark, rows), bench, 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(rows, ["text 5 of many"], 50)


def audited(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(WORD, t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((s or "", {f for f in bad if bad[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            gone = []
            for k, f in enumerate(order):
                cut = [x for x in left if f in x[1]]
                out[part, order, k + 1] = [0, len(cut), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in [*left, *gone]), sum(x[2] for x in cut), sum(x[3] for x in cut), f]
                left, gone = [x for x in left if f not in x[1]], gone + cut
                out[part, order, k + 1][0] = len(left)
                shapley[f] += len(cut)
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return sorted((*k, *v) for k, v in out.items())


def test_audit_of_odd_rows(spark):
    labels = [(1, 1, 0), (4, 0, 1), (5, 1, 1), (5, 0, None), (7, 1, 0), (9, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, ODD), frame)
    assert sorted(tuple(r) for r in got.collect()) == audited(ODD, labels)
    assert filter_audit.audit(documents(spark, ODD).limit(0), frame).count() == 0
    bare = filter_audit.audit(documents(spark, ODD), frame.limit(0)).collect()
    assert sorted(tuple(r) for r in bare) == audited(ODD, [])


def test_audit_query(spark):
    d, x = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = audited([(r["doc_id"], r["text"], r["source"]) for r in d.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in x.collect()])
    assert sorted(tuple(r) for r in queries.op12_filter_audit(spark, SF).collect()) == want


def test_audit_plan_has_no_python_and_reads_texts_once(spark):
    plan = filter_audit.cells(documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "split" not in plan  # what is planned starts from the checkpointed bits


URLS = [
    None,
    "",
    "no scheme/at/all",
    "http://",
    "HTTP://WWW.Bad.example.ORG:80/a/?utm_source=x&b=2&a=1#frag",
    "https://bad.example.org/a?a=1&b=2",
    "https://m.bad.example.org/a/?a=1&b=2&gclid=3",
    "https://bad.example.org/a?a=1&b=3",
    "https://x.example.net/en/1",
    "https://example.net/en/1",
    "https://notexample.net/en/1",
    "https://example.net",
    "https://a.b.net/de/#/en/",
    "https://x.example.com/de/2?ref=q",
    "https://x.example.com/fr/2",
    "https://x.org/fr/9",
    "https://org/fr/",
    "https://forg/fr/",
    "https://x.example.org/?u=http://y.net/",
    "https://x.example.org/é/日本 " + "p" * 30_000,
    "https://x.example.org/é/日本 " + "p" * 30_000,
]


def canonical(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    fields = sorted(f for f in (query[1] if query else "").split("&") if f and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|$)", f))
    return host, path, re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host)) + re.sub(r"/+$", "", path) + ("?" + "&".join(fields) if fields else "")


def judged(pages, listed, rules=url_filter.RULES):
    block = {c for u in listed if (c := canonical(u)[2]) is not None}
    out = []
    for i, u in pages:
        host, path, c = canonical(u)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        r = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        out.append((i, host, path, r and r[0] + r[1], r[2] if r else "block" if c in block else "allow", c, c in block))
    return sorted(out, key=str)


@pytest.mark.parametrize("listed", [[], [None, "no url"], URLS[4:5] * 3 + ["https://x.example.com/fr/2/", "https://other.org"], URLS])
def test_urls_of_odd_rows(spark, listed):
    pages = [(None if k == 3 else k, u) for k, u in enumerate(URLS)]
    p = spark.createDataFrame([(*r, "clash", 1, 2) for r in pages], "page_id long, url string, rule string, block int, l0 int")
    x = spark.createDataFrame([(u, "clash") for u in listed], "url string, canonical string")
    got = [tuple(r) for r in url_filter.judge(p, x).collect()]
    assert sorted(got, key=str) == judged(pages, listed)
    assert url_filter.judge(p.limit(0), x).count() == 0


def test_the_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host/"), "id").alias("canonical"))
    words, n = url_filter.blocked_filter(keys)
    assert words.count() <= n <= url_filter.MAX_BLOCKS
    d = url_filter.possible(spark.range(40000).select("id", F.concat(F.lit("host/"), "id").alias("canonical")), words, n).where("maybe").select("id").collect()
    found = {r["id"] for r in d}
    assert set(range(5000)) <= found and len(found) - 5000 < 350  # under 1 % of 35000
    pages, listed = [(k, f"http://host/{k}") for k in range(2000)], [f"http://host/{k}" for k in range(0, 2000, 7)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(u,) for u in listed], "url string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == judged(pages, listed)


def test_url_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    listed = [r["url"] for r in rows if 100 * len(re.findall(r"[#*%$|]", r["html"])) >= 3 * max(1, len(r["html"]))]
    got = queries.op13_url_filter(spark, "/root/testdata/sf0.01")
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and listed
    assert sorted((tuple(r) for r in got.collect()), key=str) == judged([(r["page_id"], r["url"]) for r in rows], listed)
