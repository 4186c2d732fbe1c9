"""Groups that once cost the square of their size, and rows that share a doc_id."""

import time

import numpy as np

from blockspark.llm import minhash

from .test_whole_job import documents


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def brute(texts, percent):
    sets = [set(s.tolist()) for s in minhash.shingles(texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return components(len(texts), pairs)


def templated(n, rng, own=30):
    shared = [f"t{k}" for k in range(120)]
    return [" ".join(shared + [f"u{x}" for x in rng.integers(0, 10**9, own)]) for _ in range(n)]


def test_templates_with_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 16)
    rng = np.random.default_rng(3)
    texts = templated(120, rng)
    for k in range(0, 60, 3):  # near copies of some, and copies of copies
        w = texts[k].split()
        texts.append(" ".join(w[:-3] + [f"x{k}"] + w[-2:]))
        texts.append(" ".join(w[:4] + [f"y{k}"] + w[5:-3] + [f"x{k}"] + w[-2:]))
    order = rng.permutation(len(texts)).tolist()
    texts = [texts[k] for k in order]
    for percent in (80, 85):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, enumerate(texts)), percent).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, percent)


def test_8000_templated_documents_in_a_minute(spark):
    docs = documents(spark, enumerate(templated(8000, np.random.default_rng(4)))).repartition(8)
    start = time.perf_counter()
    assert minhash.near_duplicates(docs).where("kept").count() == 8000
    assert time.perf_counter() - start < 60


def test_rows_of_one_id_are_linked_each_by_its_own_text(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (5, ""), (5, ""), (None, a), (6, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"], r["chosen"]) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == sorted([(1, 1, True, True), (1, 1, True, True), (2, 1, False, False), (3, 1, False, False), (4, 4, True, True), (4, 4, True, True), (5, 5, True, True), (5, 5, True, True), (0, 0, True, True), (6, 6, True, True)])
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (4, c), (5, ""), (5, ""), (None, a), (6, None)], key=str)
