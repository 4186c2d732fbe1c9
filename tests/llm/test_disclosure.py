"""Personal data: linear patterns, co-occurrence against counting in plain Python, rows that share a doc_id."""

import math
import re
import time

import numpy as np
import pytest

from blockspark.llm import pii

from .test_whole_job import documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}


def test_run_starts_give_the_same_matches():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab1.@-_ +"), 40)) for _ in range(4000)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@@y.z", "a.b@c.d.e@f.g"]
    for text in texts:
        for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP)):
            assert [m.span() for m in pii._matches(pattern, text)] == [m.span() for m in re.finditer(PLAIN[kind], text)], text


@pytest.mark.parametrize("text", ["1" * 300_000 + " .", "a" * 300_000 + " @", "1." * 150_000 + "@", "a@" * 150_000 + ".", "+" + "1 " * 150_000 + "(", "1-" * 150_000])
def test_long_tokens_take_linear_time(text):
    start = time.perf_counter()
    pii.text_spans(text, np.array([5], np.int64))
    assert time.perf_counter() - start < 5


def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(200):
        text = " ".join(rng.choice(words, 30))
        if k % 10 == 0:  # one person, told by a nickname
            text += f" zorro {words[k % 7]} writes from jo@x{k % 3}.org {words[k % 11]}"
        if k % 10 == 1:  # many people of one firm, told by its name
            text += f" {words[k % 13]} acme {words[k % 5]} has p{k}@firm.example as address {k}"
        rows.append((k, text))
    rows += [(300, "zorro without an address"), (301, rows[1][1]), (302, None), (302, "")]
    return rows


def counted(rows, thresholds=pii.Thresholds()):
    """The revealing terms by counting sets."""
    word = re.compile(r"\w+")
    holds, contexts, near, has = {}, {}, {}, {}
    for i, (_, text) in enumerate(rows):
        text = text or ""
        at = [(m[0].lower(), *m.span()) for m in word.finditer(text)]
        for w, _, _ in at:
            holds.setdefault(w, set()).add(i)
        spans = pii.base_spans(text)
        free = [x for x in at if not any(a < x[2] and x[1] < b for _, a, b in spans)]
        for kind, a, b in spans:
            place = sum(x[1] < a for x in free)
            around = tuple(x[0] for x in free[max(0, place - pii.WINDOW) : place + pii.WINDOW])
            for e in ((0, kind, text[a:b].lower()), (1, kind, text[a:b].lower().split("@")[-1])):
                has.setdefault(e, set()).add(i)
                for w in set(around):
                    contexts.setdefault((e, w), set()).add(around)
                    near.setdefault((e, w), set()).add(i)
    out = set()
    for (e, w), c in contexts.items():
        disclosure = len(near[e, w]) / len(holds[w])
        most = math.log2(len(rows) / len(has[e]))
        if len(c) >= (thresholds.group_support if e[0] else thresholds.support) and disclosure >= thresholds.disclosure and most > 0 and math.log2(disclosure) + most >= thresholds.share * most:
            out.add(w)
    return out


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_terms_against_counting(spark, monkeypatch, held):
    monkeypatch.setattr(pii, "HELD_TERMS", held)
    rows = corpus()
    want = counted(rows)
    assert "acme" in want and not any(w.startswith("w") for w in want)
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.find_spans(docs).collect()), key=str)
    expected = []
    for i, t in rows:
        base = pii.base_spans(t or "")
        more = [(m.start(), m.end()) for m in re.finditer(r"\w+", t or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in base)]
        expected.append((i, [f"{k}:{a}:{b}" for k, a, b in base] + [f"term:{a}:{b}" for a, b in more]))
    assert got == sorted(expected, key=str)
    out = {(r["doc_id"], r["text"]) for r in pii.masked(docs).collect()}
    assert out == {(i, t if t is None else pii.mask_text(t, s)) for (i, t), (_, s) in zip(rows, expected, strict=True)}


def test_rows_of_one_id_are_masked_each_by_its_own_text(spark):
    out = pii.masked(documents(spark, [(1, "to a@b.org now"), (1, "a longer text to c@d.org"), (1, None)]))
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "a longer text to [EMAIL]", "to [EMAIL] now"]
