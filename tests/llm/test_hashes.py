"""Texts made to collide keep hashes and classes of their own."""

import numpy as np

from blockspark.llm import minhash
from blockspark.llm.common import PRIMES, connected_components, powers, span_hashes

from .test_whole_job import documents


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_words_differ(spark):
    texts = [f(n) for n in (1024, 2048, 4096, 8192) for f in (thue_morse, lambda n: thue_morse(n, "b", "a"))]
    texts += ["x " * 7 + t for t in texts]
    assert len({s.tobytes() for s in minhash.shingles(texts)}) == len(texts)
    got = minhash.near_duplicates(documents(spark, list(enumerate(texts[:8])))).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)


def test_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 256, 300).astype(np.uint8)
    line = np.concatenate([rng.integers(0, 256, 5000).astype(np.uint8), word, rng.integers(0, 256, 77).astype(np.uint8), word])
    start = np.array([5000, 5377, 5001, 0])
    h = span_hashes(line, start, start + [300, 300, 300, 0])
    assert h[0] == h[1] == span_hashes(word, np.array([0]), np.array([300]))[0] and h[2] != h[0] and len(set(h.tolist())) == 3
    for (up, down), p in zip(powers(3000), PRIMES, strict=True):
        assert (up * down % np.uint64(p) == 1).all() and up.max() < p
    spans = np.sort(rng.integers(0, len(line), (20000, 2)), axis=1)
    texts = {line[a:b].tobytes() for a, b in spans.tolist()}
    assert len(set(span_hashes(line, spans[:, 0], spans[:, 1]).tolist())) == len(texts)


def test_components_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(6)
    chain = [(k + 1, k) for k in range(1000, 1300)]
    edges = [*map(tuple, rng.integers(0, 400, (250, 2)).tolist()), *chain, (None, 3), (7, 7), (1100, 1100)] + [(2000, k) for k in range(2001, 2200)] * 2
    from .test_hot_groups import components

    names = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(names)}
    root = components(len(names), [(at[a], at[b]) for a, b in edges if a in at and b in at])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for links in (1 << 18, 50, 100):
        got = connected_components(frame, task_links=links).collect()
        assert sorted((r["node"], r["component"]) for r in got) == [(x, names[root[k]]) for k, x in enumerate(names)]
    assert connected_components(frame.limit(0)).count() == 0
