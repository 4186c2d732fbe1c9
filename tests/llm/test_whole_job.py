"""Cases in which an operator once did less than the whole job."""

import numpy as np

from blockspark.llm import licenses, minhash, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def test_stage_drops_copies_of_080_to_085_and_keeps_rows_without_id(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):  # pairs of 204 and 204 shingles, 184 in common: 184 / 224 = 0.82
        w = [f"w{x}" for x in rng.integers(0, 10**9, 208)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:50], f"x{k}", *w[51:90], f"y{k}", *w[91:130], f"z{k}", *w[131:170], f"u{k}", *w[171:]]))]
    a, b = (s for s in minhash.shingles([rows[0][1], rows[1][1]]))
    assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.85
    loose = [(None, None), (None, rows[0][1]), (None, "a text of its own")]
    out = corpus_pipeline.near_duplicates(spark, documents(spark, rows + loose), "")
    assert out.columns == documents(spark, []).columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(i for i, _ in got if i is not None) == list(range(0, 80, 2))
    assert sorted((t or "" for i, t in got if i is None)) == sorted(t or "" for _, t in loose)


def test_bands_miss_less_than_one_in_100000():
    assert minhash.bands_for(85) == minhash.BANDS
    assert all((1 - (p / 100) ** minhash.ROWS) ** minhash.bands_for(p) < 1e-5 for p in (70, 80, 85, 90, 100))


def test_rows_without_id_are_masked_each_by_its_own_text(spark):
    out = pii.masked(documents(spark, [(1, "x a@b.org"), (None, "mail c@d.org now"), (None, "to e@f.org"), (None, None), (None, "plain")]))
    assert sorted((r["text"] or "" for r in out.collect())) == sorted(["x [EMAIL]", "mail [EMAIL] now", "to [EMAIL]", "", "plain"])


def test_terms_are_found_in_small_tables_and_beside_common_entities(spark):
    words = ["red", "blue", "green", "grey", "pink"]
    told = [f"the zanzibar {w} wrote from jane@example.com about {w} things" for w in words]
    plain = [f"plain text about the {w} things of the day and what they wrote from home {i}" for i, w in enumerate(words * 19)]
    small = documents(spark, enumerate(told + plain))
    hot = documents(spark, enumerate([f"{told[i % 5]} {i}" for i in range(1000)] + [f"{plain[i % 95]} {i}" for i in range(2000)]))
    for docs, n in ((small, 5), (hot, 1000)):
        spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
        assert all("term:4:12" in spans[i] for i in range(n)) and not any(spans[i] for i in range(n, len(spans)))
    # an address in all texts but one is foretold by any word: none of them reveals it
    everywhere = documents(spark, enumerate([f"the {w} day {i} jane@example.com" for i, w in enumerate(words * 20)] + ["the day"]))
    assert not any(s.startswith("term") for r in pii.find_spans(everywhere).collect() if r["doc_id"] == 100 for s in r["spans"])


def test_every_license_rule_on_one_line_and_wrapped(spark):
    import textwrap

    numbers, rules = licenses.compiled()
    texts, want = [], []
    for name, ids in licenses.RULES:
        whole = [licenses.SENTENCES[i] for i in ids]
        for text in (" ".join(whole), "\n".join(whole), textwrap.fill("  ".join(whole), 40), "\r\n".join(textwrap.wrap(" ".join(whole), 60)), "# " + textwrap.fill(" ".join(whole), 30, break_long_words=False).replace("\n", "\n# "), "A heading\n" + textwrap.fill(" ".join(whole), 50) + "\n\nmore text"):
            texts.append(text)
            want.append(([name], sum(len(licenses.sentences_of(s)) for s in whole)))
    texts += ["Released under\n\nthe MIT License.", "Released under the MIT License", "my tool\nReleased under the MIT License\nmy name", "not Released under the MIT License.", "This is version 2.0.\nv. 2.1"]
    want += [([], 0), (["MIT"], 1), (["MIT"], 1), ([], 0), ([], 0)]
    out = sorted(licenses.scan(documents(spark, enumerate(texts))).collect(), key=lambda r: r["doc_id"])
    assert [(r["licenses"], r["n_sentences"]) for r in out] == want


def test_license_scan_equals_its_sql(spark):
    import duckdb

    mpl = licenses.SENTENCES["mpl2_notice"]
    rows = [(i, t) for i, t in enumerate([None, "", mpl, f"x\n{mpl}\ny", "2.0. 2.0", "a | b\nS H\nReleased under the MIT License."])]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs in (documents(spark, rows).select("doc_id", "text"), real):
        con = duckdb.connect()
        con.register("documents", docs.toArrow())
        got = [(r["doc_id"], r["n_sentences"], ",".join(r["licenses"]), r["n_matches"]) for r in licenses.scan(docs).collect()]
        assert sorted(got) == sorted(con.execute(licenses.oracle_sql()).fetchall())
