"""Each operator against a brute-force version, a round trip or held-out accuracy, on small and on odd tables."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from blockspark.llm import embed_dedup, langid, licenses, minhash, packing, pieces, pii, quality, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, h long, row string, spans string"
SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "!", "a", "a b", "The cat sat on the mat. " * 3, "The cat sat on the mat. " * 3, "x" * 70_000, "é日本 😀\n\nfoo@bar.com +1 (555) 123-4567\t10.0.0.1", "# $ % & | < >", "<|endoftext|> a\0b  c \n d"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", i, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key]))


@pytest.fixture(scope="module")
def sample(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_round_trip_and_best_score(spark):
    automaton, _ = pieces.model()
    score = {int(i): (float(s), int(n)) for i, s, n in zip(automaton.id, automaton.score, automaton.size) if i >= 0}
    by_text = {pieces.model()[1][i].replace(b" ", "▁".encode()): s for i, (s, _) in score.items()}
    for text in ["hello  world", "日本 é\n\tq", "a", "The cat sat on the mat."]:
        ids = pieces.encode([text])[0]
        assert pieces.decode(ids) == text
        raw = ("▁" + text.replace(" ", "▁"))
        best = [0.0] + [-np.inf] * len(raw)
        for e in range(1, len(raw) + 1):
            best[e] = max([best[e - 1] + automaton.unknown] + [best[k] + by_text[p] for k in range(e) if (p := raw[k:e].encode()) in by_text])
        loose = bytes(int(i) for b in ids for i in np.flatnonzero(automaton.byte_ids == b)[:1] if b in automaton.byte_ids)
        got = sum(score[i][0] for i in ids if i in score) + automaton.unknown * len(loose.decode())
        assert abs(got - best[-1]) < 1e-6
    out = rows(pieces.round_trip(docs(spark, ODD)))
    assert len(out) == len(ODD) and all(r["decoded"] for r in out) and out[0]["n_pieces"] == out[1]["n_pieces"] == 0
    assert pieces.round_trip(empty(spark)).count() == 0


def test_packing_places_every_piece(spark, sample):
    from blockspark.llm.tokens import encoding

    texts = ODD + sample[:60]
    out = rows(packing.pack_documents(docs(spark, texts)))
    by = {(r["doc_id"], r["piece"]): r for r in out}
    assert len(by) == len(out)
    for i, t in enumerate(texts):
        ids = np.array([*encoding().encode_ordinary(t or ""), 2], "<u4")
        own = [by[i, p] for p in range(-(-len(ids) // 1024))]
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r["length"] for r in out) / 1024 + 2
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing_keeps_every_capacity(rule):
    runs = packing.plan_runs({100: 7, 60: 5, 30: 40, 1: 300}, 128, 4, 12_000, rule=rule)
    bins: dict[int, list[tuple[int, int]]] = {}
    placed = Counter()
    for length, first, count, b, offset in runs:
        for k in range(count):
            bins.setdefault(b + k, []).append((offset, length))
            placed[length, first + k] += 1
    assert len(placed) == 352 and set(placed.values()) == {1}
    for items in bins.values():
        assert sum(n for _, n in items) <= 128 and len(items) <= 4 and sum(n * n for _, n in items) <= 12_000


def test_quality_counts_and_cascade(spark, sample):
    texts = ODD + ["a b c " * 30, "one\ntwo\none\n\none", "*** " * 60] + sample[:80]
    out = rows(quality.assess(docs(spark, texts)))
    for t, r in zip(texts, out):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (r["rejected_by"] is None) and not (r["base_failed"] and r["kept"])
    assert quality.assess(empty(spark)).count() == 0
    assert {r.name for r, _, _ in quality.order_rules(docs(spark, texts))} == {r.name for r in quality.RULES}


def test_token_counts_by_offsets(spark, sample):
    from tokenizers import Tokenizer

    from blockspark.llm.common import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [t for t in ODD if t and len(t) < 1000] + sample[:15]
    for rule in token_counts.RULES:
        for t, r in zip(texts, rows(token_counts.count_sections(docs(spark, texts), rule))):
            spans = tok.encode(t, add_special_tokens=False).offsets
            bounds = [0, *[m.end() for m in re.finditer("\n", t)]]
            bounds = [*bounds, len(t)] if bounds[-1] != len(t) else bounds
            want = [0] * (len(bounds) - 1)
            for a, b in spans:
                shares = [max(0, min(b, y) - max(a, x)) for x, y in zip(bounds, bounds[1:])]
                touched = [k for k, s in enumerate(shares) if s]
                want[{"start": touched[0], "end": touched[-1], "larger": max(touched, key=lambda k: (shares[k], -k))}[rule]] += 1
            assert r["tokens"] == want and r["n_tokens"] == len(spans)
    fields = rows(token_counts.count_fields(docs(spark, ["ab cd", None]), "doc_id", ["text", "lang"]))
    assert len(fields) == 4 and sum(r["tokens"] for r in fields if r["doc_id"] == 0) == len(tok.encode("ab cd\nen").ids)
    assert token_counts.count_sections(empty(spark)).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    filters = langid.train(d.where("doc_id % 4 <> 2"))
    got = langid.predict(d.where("doc_id % 4 = 2"), filters).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = rows(langid.predict(docs(spark, ODD), filters))
    assert [r["lang_pred"] for r in odd[:4]] == [langid.UND] * 4 and all(0 <= r["score"] <= 1 for r in odd)
    kept = {r["doc_id"] for r in rows(langid.keep(docs(spark, ODD), filters))}
    assert not kept & {0, 1, 2, 3} and 6 in kept
    assert langid.predict(empty(spark), filters).count() == 0


def test_toxicity_separates(spark):
    ordinary = [f"the {w} river ran past the old mill and the {w} bridge near town {i}" for i, w in enumerate(["green", "quiet", "long", "cold"] * 60)]
    toxic = [f"the {w} river ran past you worthless scum and the {w} bridge near town {i}" for i, w in enumerate(["green", "quiet", "long", "cold"] * 40)]
    d = docs(spark, ordinary + toxic)
    labels = d.selectExpr("doc_id", f"int(doc_id >= {len(ordinary)}) as toxic")
    model = toxicity.train(d, labels)
    out = rows(toxicity.score(docs(spark, [*ODD, "we met by the quiet river near the mill", "you are worthless scum my friend"]), model))
    assert all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"] == 0
    assert out[-1]["score"] > 0.5 > out[-2]["score"]
    assert toxicity.score(empty(spark), model).count() == 0


def test_licenses(spark):
    mit = " ".join(licenses.SENTENCES[k] for k in ("mit_grant", "mit_condition", "as_is"))
    texts = [*ODD, "Foo.\nLicensed under the Apache License, Version 2.0.\nBar.", mit, mit[: mit.index("The above")], "RELEASED under the   MIT license. Released under the MIT License."]
    out = rows(licenses.scan(docs(spark, texts)))
    assert [r["licenses"] for r in out[-4:]] == [["Apache-2.0"], ["MIT"], [], ["MIT"]] and [r["n_matches"] for r in out[-4:]] == [1, 1, 0, 2]
    assert all(r["licenses"] == [] for r in out[: len(ODD)]) and licenses.scan(empty(spark)).count() == 0


def test_pii_spans_and_terms(spark):
    card = "4111 1111 1111 1111"
    texts = [*ODD, f"mail a.b@c.example.org or {card} and 4111 1111 1111 1112", "1.2.3.4.5.6.7.8 300.1.1.1 +12 34", f"{card} {card}"]
    out = rows(pii.digest(pii.find_spans(docs(spark, texts))))
    assert [r["n_email"] for r in out[-3:]] == [1, 0, 0] and [r["n_card"] for r in out[-3:]] == [1, 0, 0] and out[-2]["n_ip"] == 2
    assert out[9]["n_email"] == out[9]["n_phone"] == out[9]["n_ip"] == 1
    # a rare word that stands beside one address alone, in different sentences, gives it away elsewhere too
    told = [f"the zanzibar {w} wrote from jane@example.com about {w} {i} things" for i, w in enumerate(["red", "blue", "green"])]
    plain = [f"plain text {i} about red and blue and green things of the day" for i in range(3000)]
    d = docs(spark, told + plain)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(d, pii.Thresholds()).collect()}
    assert "term:4:12" in spans[0] and not any(s for i, s in spans.items() if i >= 3)
    text = {r["doc_id"]: r["text"] for r in pii.masked(d).where("doc_id < 3").collect()}
    assert text[0] == "the [TERM] red [TERM] [TERM] [EMAIL] about red 0 things" or "[EMAIL]" in text[0] and "zanzibar" not in text[0]
    assert pii.masked(docs(spark, ODD)).columns == docs(spark, ODD).columns and pii.find_spans(empty(spark)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    pool = minhash.mix64(np.arange(1, 4001, dtype=np.uint64))
    for n, common in ((1, 1), (3, 2), (40, 34), (2000, 1700)):
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        same = (minhash.sketch(a) == minhash.sketch(b)).mean()
        assert abs(same - common / (2 * n - common)) < 0.25
    assert (minhash.sketch(pool[:1]) != 0).all() and rng is not None


def test_near_duplicates_exactly(spark, sample, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 8)
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 900, 400)]
    family = []
    for k in range(40):
        w = list(base)
        for i in rng.integers(0, 400, 4):
            w[i] = f"k{k}x{i}"
        family.append(" ".join(w))
    texts = [*ODD, *sample[:40], *family, "one two three", "One two\nthree", *family[:3]]
    out = rows(minhash.near_duplicates(docs(spark, texts)))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert [r["n_shingles"] for r in out] == [len(s) for s in sets]
    assert [r["component_id"] for r in out] == [root(i) for i in range(len(texts))]
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in out)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    x[50:100] = x[:50] + rng.normal(size=(50, 16)) * 0.08
    x[100:120] = x[0]
    vectors = [v.tolist() for v in x.astype(np.float32)] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14]
    data = [(i, v, None if i == 149 else i % 3 if i < 100 else 0, "clash", 1) for i, v in enumerate(vectors)]
    out = rows(embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string, n int")), "vec_id")
    u = np.array(vectors[:150], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([-1 if d[2] is None else d[2] for d in data[:150]])
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & (label[:, None] >= 0) & ~np.eye(150, dtype=bool)
    got = np.array([r["n_links"] for r in out])
    assert (got[150:] == 0).all() and (got[:150] <= link.sum(1)).all() and got.sum() >= 0.9 * link.sum()
    assert all(r["component_id"] <= r["vec_id"] for r in out) and out[110]["component_id"] == 0 and len(out) == 155
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark, sample):
    import corpus_pipeline

    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate([*ODD, *sample[:50]])], "doc_id long, text string, lang string, source string, n_chars long")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == columns and d.count() <= n, name
        n = d.count()
    assert 0 < n < len(sample[:50]) + len(ODD)
