from __future__ import annotations

import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import langid, toxicity
from brindle.llm.queries import QUERIES

HELD = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_held_out_documents(spark, sf):
    rows = QUERIES["op2_langid"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == HELD(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95


def test_bundle_is_the_sum_of_bound_letters():
    a, b, c = langid._letter_vectors()
    code = {" ": 0} | {chr(97 + i): i + 1 for i in range(26)}
    text = "Ab, c"
    x = [code.get(ch, 0) for ch in " " + text.lower() + " "]
    want = sum(a[x[i - 1]].astype(int) * b[x[i]] * c[x[i + 1]] for i in range(1, len(x) - 1) if x[i])
    got, letters = langid.bundles(["", text, "漢"])
    assert np.array_equal(got[1], want) and letters.tolist() == [0, 3, 1] and not got[0].any()


def test_undetermined(spark):
    docs = spark.createDataFrame([(1, None), (2, "123 ..."), (3, "hello")], "doc_id long, text string")
    known = langid.Profiles(["en"], np.ones((1, langid.DIM)), np.ones(1))
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, known).collect()} == {1: "und", 2: "und", 3: "en"}
    nothing = langid.Profiles([], np.zeros((0, langid.DIM)), np.zeros(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert [r.doc_id for r in langid.label(docs.withColumn("lang", F.lit("xx")), nothing).filter("lang = 'xx'").collect()] == [3]


def by_hand(texts, langs, asked):
    """Bundles, prototypes and predictions with one vector for each trigram."""
    a, b, c = (t.astype(int) for t in langid._letter_vectors())
    table = langid._letter_table().astype(int)

    def bundle(text):
        x = [table[ord(ch)] for ch in f" {text} "]
        return sum((a[x[i - 1]] * b[x[i]] * c[x[i + 1]] for i in range(1, len(x) - 1) if x[i]), np.zeros(langid.DIM, dtype=int))

    names = sorted(set(langs))
    known = np.array([sum(bundle(t) for t, lang in zip(texts, langs, strict=True) if lang == name) for name in names])
    out = []
    for t in asked:
        v = bundle(t)
        cosines = known @ v / np.linalg.norm(known, axis=1) / max(np.linalg.norm(v), 1e-9)
        out.append((names[int(cosines.argmax())], max(cosines.max(), 0)))
    return out


def test_predictions_equal_brute_force(spark, monkeypatch):
    """With stretches, trigrams and rows in small blocks."""
    for name, value in (("STRETCH", 70), ("PRESENT", 9), ("BUNDLE", 3)):
        monkeypatch.setattr(langid, name, value)
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list(abc), rng.integers(1, 7))) for _ in range(rng.integers(1, 30))) for abc in ("abcde", "cdefg", "щжзйé") * 7]
    langs = ["x", "y", "z"] * 7
    vectors, letters = langid.bundles(texts, np.array([2, 0, 1] * 7), 3)
    known = langid.Profiles(["y", "z", "x"], vectors, letters)
    names, scores, n, _ = langid._judge(texts, known, langid.SHARE)
    want = by_hand(texts, langs, texts)
    assert names.tolist() == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want])
    assert n.tolist() == [sum(map(str.isalpha, t)) for t in texts]


def test_memory_of_mixed_scripts():
    """Texts of ever new trigrams: what is held at once is bounded."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 4000))) for _ in range(500)]
    tracemalloc.start()
    langid.bundles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_other_languages_go_and_short_clean_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    known = langid.learn(docs)
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    odd = [" ".join(letters(rng.integers(3, 9)) for _ in range(1000)), letters(20000), "".join(chr(k) for k in rng.integers(0x4E00, 0x9FFF, 3000))]
    gone = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), known).collect()
    assert not any(r.native for r in gone)
    clean = langid.predict(docs, known).filter("not native and n_letters > 0").count()
    assert clean <= 0.002 * docs.count()
    starts = docs.select("doc_id", F.left("text", F.lit(25)).alias("text"))
    short = langid.predict(starts, known).filter("not native and n_letters > 0").count()
    assert short == 0


def test_gradient_of_the_network():
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, ids = rng.standard_normal((7, 2 * toxicity.WIDTH)), rng.integers(0, 7, (5, 6))
    real = np.arange(6) < np.array([6, 3, 6, 1, 0])[:, None]
    y = np.array([0, 1, 1, 0, 1.0])

    def loss():
        logit = net.forward(net.projected(x), ids, real)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g, dx = net.gradient(x, ids, real, y)
    for k, grad in g.items():
        at = tuple(rng.integers(0, s) for s in net.w[k].shape)
        old = net.w[k][at]
        sides = []
        for e in (1e-4, -1e-4):
            net.w[k][at] = old + e
            sides.append(loss())
        net.w[k][at] = old
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(grad[at], rel=0.05, abs=2e-5), k
    assert dx.shape == x.shape


def test_windows_cover_every_word():
    for n in (0, 1, 19, 20, 21, 29, 30, 31, 57, 200):
        covered = {i for s in toxicity.starts_of(n) for i in range(s, s + toxicity.WINDOW)}
        assert covered >= set(range(n))


def test_toxic_windows_anywhere_are_found():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    make = lambda bad, n: " ".join([*rng.choice(words, n), *(["vilescum"] if bad else []), *rng.choice(words, n)])
    texts = [make(i % 2, 60) for i in range(160)]
    net = toxicity.fit(texts, [i % 2 for i in range(160)], epochs=40)
    scorer = toxicity.Scorer(net)
    fresh = [make(i % 2, n) for n in (5, 50, 300) for i in range(20)]
    scores = scorer.texts([toxicity.words_of(t) for t in fresh])
    right = [(s >= 0.5) == bool(i % 2) for i, s in enumerate(scores)]
    assert np.mean(right) >= 0.9
    assert 0 <= scorer.texts([[]])[0] <= 1


def area(scores, labels):
    """Chance that a toxic text scores higher than another, ties half."""
    bad, good = ([s for s, y in zip(scores, labels, strict=True) if y == v] for v in (1, 0))
    return np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])


def test_quality_on_held_out_documents(spark, tmp_path):
    """Toxic documents hold one of a few words somewhere, some of them misspelt."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8))) for _ in range(3000)]
    bad = ["vilescum", "filthrag", "worthless"]
    docs, labels = [], []
    for i in range(900):
        text = rng.choice(words, rng.integers(5, 200)).tolist()
        if i % 3 == 0:
            w = bad[rng.integers(3)]
            at = rng.integers(1, len(w) - 1)
            text.insert(rng.integers(len(text)), w if rng.random() < 0.8 else w[:at] + w[at] + w[at:])
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = [r for r in QUERIES["op8_toxicity"](spark, str(tmp_path)).collect() if r.held_out]
    assert area([r.score for r in held], [int(r.doc_id % 3 == 0) for r in held]) >= 0.95
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) >= 0.9


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i == 7 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, ys = toxicity.sample(docs, labels, 50, 200)
    assert sum(map(len, texts)) == 200 and len(texts) == 20 and 8 <= sum(ys) <= 12
    texts, ys = toxicity.sample(docs, labels, 3)
    assert len(texts) == 6 and sum(ys) == 3


def test_nothing_to_learn_from():
    assert toxicity.fit([], []) == 0.0 and toxicity.fit(["a"], [1]) == 1.0


def test_toxicity_query(spark, sf):
    rows = QUERIES["op8_toxicity"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == HELD(r.doc_id) for r in rows)


def plain_score(net, text):
    """The greatest window score of a text, window by window and word by word."""
    w, mask = net.w, (1 << 64) - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        codes = [ord(c) for c in f"\x02{word}\x03"]
        whole = sum(c * pow(0xC4CEB9FE1A85EC53, i + 1, 1 << 64) for i, c in enumerate(codes)) & mask
        grams = []
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                code = 0
                for c in codes[i : i + n]:
                    code = (code * 0x9E3779B97F4A7C15 + c) & mask
                grams.append(((code * 0xD1B54A32D192ED03 & mask) >> 40) % toxicity.GRAMS)
        return np.concatenate((w["word"][(whole >> 37) % toxicity.WORDS], np.mean([w["gram"][g] for g in grams], axis=0)))

    def read(d, vectors):
        h, out, size = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for v in vectors if d == "l" else vectors[::-1]:
            x, g = v @ w[f"x{d}"] + w[f"b{d}"], h @ w[f"h{d}"]
            r, z = sigmoid(x[:size] + g[:size]), sigmoid(x[size : 2 * size] + g[size : 2 * size])
            h = (1 - z) * np.tanh(x[2 * size :] + r * g[2 * size :]) + z * h
            out.append(h)
        return out if d == "l" else out[::-1]

    words = re.findall(r"\w+", text.lower())
    starts = list(range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE)) + ([len(words) - toxicity.WINDOW] if len(words) > toxicity.WINDOW else [])
    known = {x: vector(x) for x in set(words)}
    best = -np.inf
    for s in starts:
        window = [known[x] for x in words[s : s + toxicity.WINDOW]]
        if not window:
            best = max(best, float(w["bias"][0]))
            continue
        states = np.concatenate((read("l", window), read("r", window)), axis=1)
        weight = np.exp(np.clip(np.tanh(states @ w["att"]) @ w["key"], -30, 30))
        best = max(best, float((weight / weight.sum()) @ states @ w["out"] + w["bias"][0]))
    return sigmoid(best)


def test_toxicity_scores_equal_a_plain_loop(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(*toxicity.sample(docs, labels))
    got = {r.doc_id: r.score for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    rows = [r for r in docs.orderBy("doc_id").collect()][::3]
    for r in rows:
        assert abs(got[r.doc_id] - plain_score(net, r.text or "")) < 1e-4
    odd = ["", "one", " ".join(["word"] * 20), " ".join(f"w{i}" for i in range(21)), "é 漢字 😀 x_y"]
    scores = toxicity.Scorer(net).texts([toxicity.words_of(t) for t in odd])
    assert all(abs(a - plain_score(net, t)) < 1e-4 for a, t in zip(scores, odd, strict=True))
