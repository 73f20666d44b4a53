"""Classifiers by held-out accuracy, decontamination against brute force, the pipeline by its parts."""

import random
import re
import zlib

import numpy as np
import pytest
from ledgerleaf.llm import boosting, decontaminate, language, quality, tokens, toxicity

SYLLABLES = {"en": "the and ing er tion st".split(), "de": "sch ung ein ver ich ß".split(), "es": "ción os de la ñ rr".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def held(doc, n, at):
    return zlib.crc32(("null" if doc is None else str(doc)).encode()) % n == at


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        lang = r.choice(list(SYLLABLES))
        text = prose(r, lang, r.randint(20, 200))
        bad, toxic = r.random() < 0.25, r.random() < 0.2
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum"]) if lang == "en" else "zug" + r.choice(["ab", "ef", "ig", "ol", "ux"]))
            text = " ".join(words)
        if bad:
            text = " ".join(w + r.choice(["###", "$$$"]) for w in text.split())
        docs.append((i, text, lang, "s"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_word_hashes_do_not_depend_on_the_block():
    import pyarrow as pa

    texts = ["alpha beta", None, "", "beta", "gamma beta alpha", "日本 beta"]
    one = []
    for size in (1, 10, 1000):
        seen = {}
        for b in tokens.blocks(pa.array(texts), size):
            b.words()
            for h, s, e in zip(b.hashes(), b.start, b.end):
                seen.setdefault(bytes(b.data[s:e]), set()).add(int(h))
            assert [int(x) for x in np.diff(b.limit)] == [len((texts[i] or "").split()) for i in b.rows]
        assert all(len(x) == 1 for x in seen.values()) and len(seen) == 4
        one.append({k: min(v) for k, v in seen.items()})
    assert one[0] == one[1] == one[2]


def test_quality_held_out(make, spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality.predict(make(docs), label_table(spark, labels)).collect()}
    out = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert all(got[i].held_out == held(i, 4, 2) for i, *_ in labels)
    assert sum(a == b for a, b in out) / len(out) > 0.95


def test_toxicity_held_out(make, spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.predict(make(docs), label_table(spark, labels)).collect()}
    out = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.93


def test_held_out_labels_are_not_read(make, spark, corpus):
    docs, labels = corpus
    turned = [(i, 1 - q if held(i, 4, 2) else q, 1 - t if held(i, 4, 2) else t) for i, q, t in labels]
    for predict in (quality.predict, toxicity.predict):
        a, b = (sorted(map(tuple, predict(make(docs[:300]), label_table(spark, x[:300])).collect())) for x in (labels, turned))
        assert a == b


def test_language_held_out(make, corpus):
    docs, _ = corpus
    got = {r.doc_id: r for r in language.identify(make(docs)).collect()}
    out = [(got[i].lang_pred, lang) for i, _, lang, _ in docs if got[i].held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.97


def test_convolution_tables_equal_the_network():
    r = np.random.default_rng(0)
    net = language.Network(["a", "b"])
    x = r.integers(0, language.SIGNS, (7, language.WINDOW)).astype(np.uint8)
    p = net.p
    pooled = []
    for w in language.WIDTHS:
        act = [sum(p["e"][x[:, i + o]] @ p[f"w{w}"][o] for o in range(w)) for i in range(language.WINDOW - w + 1)]
        pooled.append(np.max(act, axis=0))
    logits = np.maximum(np.concatenate(pooled, 1) + p["b"], 0) @ p["s"] + p["c"]
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(net.score(x, net.tables()), want, atol=1e-4)


def test_odd_rows(make, spark, odd_rows):
    labels = [(4, 1, 0), (4, 0, 0), (6, 1, 1), (None, 1, 1), (8, None, None), (10, 0, 0)]
    docs = make(odd_rows)
    for rows in (labels, []):
        t = label_table(spark, rows)
        for predict in (quality.predict, toxicity.predict):
            got = predict(docs, t).collect()
            assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
            assert predict(docs.limit(0), t).count() == 0
        assert quality.accept(docs, t).columns == docs.columns
    got = language.identify(docs).collect()
    assert len(got) == len(odd_rows)
    for r, text in ((r, t) for r in got for i, t, *_ in odd_rows if i == r.doc_id and i in (1, 2, 3)):
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(docs.limit(0)).count() == 0


def test_boosting_learns_a_rule():
    cells = [((a, b), 10.0, 10.0 if a >= 2 and b == 1 else 0.0) for a in range(4) for b in range(2)]
    model = boosting.boost(cells)
    assert all((boosting.log_odds(model, c[0]) > 0) == (c[2] > 0) for c in cells)
    limit = boosting.threshold(model, cells, 0.99)
    assert {c[0] for c in cells if boosting.log_odds(model, c[0]) >= limit} == {c[0] for c in cells if c[2]}


def test_decontamination(make, spark, odd_rows):
    r = random.Random(9)
    items = [(i, prose(r, "en", r.randint(6, 300))) for i in range(60)] + [(60, None), (61, "..."), (5, "short item here now"), (62, prose(r, "de", 40))]
    items.append((63, items[-1][1]))
    docs = []
    for i in range(200):
        text = prose(r, "en", r.randint(5, 700))
        if i % 4 == 0:
            t = r.choice([t for _, t in items if t])
            text += "\n" + (t.upper() if i % 8 else t.replace(" ", "!! ")) + " " + prose(r, "es", r.randint(0, 50))
        docs.append((1000 + i, text, "en", "s"))
    docs += odd_rows + [docs[4]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    have = {(d, i) for d, text, *_ in docs for i, t in items if words(t) and f" {' '.join(words(t))} " in f" {' '.join(words(text))} "}
    told = set()
    for size in (100000, 300, 40):
        rows = decontaminate.leaks(make(docs), benchmark, pieces=size).collect()
        got = {(x.doc_id, x.item_id) for x in rows}
        assert have <= got and len(got - have) <= 2, (have - got, got - have)
        told.add(frozenset((x.doc_id, x.item_id, x.word, round(x.score, 9)) for x in rows))
    assert len(told) == 1
    kept = decontaminate.clean(make(docs), benchmark)
    bad = {d for d, _ in got}
    assert kept.columns == make(docs).columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((d for d, *_ in docs if d not in bad), key=str)
    assert decontaminate.leaks(make(docs).limit(0), benchmark).count() == 0
    assert decontaminate.leaks(make(docs), benchmark.limit(0)).count() == 0


def test_wand_finds_all_above_the_threshold():
    r = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 30)))) for i in range(200)])
    for _ in range(60):
        terms = np.array(sorted(r.sample(range(len(index.terms)), r.randint(1, 40))))
        scores = {}
        for t in terms:
            for p, s in zip(index.piece[index.limit[t] : index.limit[t + 1]], index.impact[index.limit[t] : index.limit[t + 1]]):
                scores[p] = scores.get(p, 0) + s
        want = {(int(p), round(s, 6)) for p, s in scores.items() if s >= 0.5}
        assert {(p, round(s, 6)) for p, s in index.search(terms, 0.5)} == want


def test_pipeline(make, spark, odd_rows, corpus, tmp_path):
    import corpus_pipeline

    docs, labels = corpus
    r = random.Random(2)
    item = prose(r, "es", 40)
    rows = docs[:200] + [(5000, docs[0][1], "en", "s"), (5001, "x " + item, "en", "t"), (5002, docs[1][1] + " mail a@b.org", "en", "t")] + odd_rows
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    label_table(spark, labels[:200]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, str(tmp_path))
        assert out.columns[: len(left.columns)] == left.columns
        left = out
        seen.append([(x.doc_id, x.text) for x in out.collect()])
    accepted = {x.doc_id for x in quality.predict(make(rows), label_table(spark, labels[:200])).filter("predicted = 1").collect()}
    assert {d for d, _ in seen[0]} == accepted
    assert sum(d in (0, 5000) for d, _ in seen[1]) <= 1
    assert 5001 not in {d for d, _ in seen[2]}
    assert not any("a@b.org" in (t or "") for _, t in seen[3]) and len(seen[3]) == len(seen[2])
    assert set(seen[4]) <= set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
