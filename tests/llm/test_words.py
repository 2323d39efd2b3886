"""Substring dedup, ranked search and the filter audit against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import audit, ranked, repeats
from brindle.llm.packing import packed, unpacked
from brindle.llm.queries import QUERIES
from brindle.llm.shingles import words_of
from brindle.llm.work import Work

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_packing_is_reversible():
    rng = np.random.default_rng(5)
    values = np.concatenate((rng.integers(0, 200, 500), rng.integers(0, 1 << 50, 500), [0, 127, 128, (1 << 62) + 5]))
    data, ends = packed(values)
    assert unpacked(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert len(unpacked(b"")) == 0


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    from brindle.llm import shingles

    texts = ["", "a b  c\n", "x" * 300 + " y", "é z A a", " ", "b"]
    whole = words_of(texts)
    monkeypatch.setattr(shingles, "CHUNK", 16)
    cut = words_of(texts)
    assert whole[1].tolist() == cut[1].tolist() == [len(WORD.findall(t)) for t in texts]
    assert whole[0].tolist() == cut[0].tolist()
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(whole[0].tolist())) == len(set(flat))


def removed(docs, size):
    """(id, words, words removed, words kept) by comparing all windows."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - size + 1):
                key = tuple(w[s : s + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and least[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def repeating(seed, size):
    """Passages at all offsets, in copies, within one document, cut just short of a window."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(30))
    passages = [[word() for _ in range(n)] for n in (size - 1, size, size + 1, 3 * size, 2 * size + 3)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [word() for _ in range(rng.randint(0, size))]
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            text += p[a : rng.choice([len(p), len(p), a + size])]
        if docs and rng.random() < 0.2:
            text = list(rng.choice(docs)[1])
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = word()
        docs.append((rng.choice([i * 37 % 1009, i * 37 % 1009, None, 5]) if i % 9 == 0 else i * 37 % 1009, text))
    return [(i, rng.choice([" ", "  ", "\n"]).join(t)) for i, t in docs] + [(5000, None), (5001, ""), (5002, " \n")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    docs = repeating(seed, repeats.SIZE)
    rows = repeats.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str) == removed(docs, repeats.SIZE)
    assert sum(r.n_removed for r in rows) > 1000


def test_one_passage_in_most_documents(spark, monkeypatch):
    """A passage at any offset in many slices: its first holder alone keeps it."""
    from brindle.llm import arrow

    monkeypatch.setattr(arrow, "SLICE_ROWS", 8)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(200):
        text = [f"w{i}x{k}" for k in range(rng.randint(0, 40))] + passage + [f"v{i}x{k}" for k in range(rng.randint(0, 40))]
        docs.append((i, " ".join(text)))
    rows = {r.doc_id: r.n_removed for r in repeats.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert rows == {i: 60 if i else 0 for i in range(200)}


def test_very_long_text(spark):
    base = " ".join(f"w{i}" for i in range(300_000))
    rows = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.dedup(spark.createDataFrame([(1, base), (2, "x " + base), (3, base + " y")], "doc_id long, text string")).collect()}
    assert rows == {1: (300_000, 0), 2: (300_001, 300_000), 3: (300_001, 300_000)}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for i, t in held:
            m = 100 - 50 + 50 * len(t) * n // total
            score = 0
            for w in asked:
                tf = t.count(w)
                if tf:
                    df = sum(w in u for _, u in held)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if there else None, -s) for r, (s, there, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ranked, "SEGMENT", 300)
    monkeypatch.setattr(ranked, "BLOCK", 4)
    monkeypatch.setattr(ranked, "ITEM_CHARS", 150)
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.8))}" for _ in range(300)] + ["É", "é", "ΑΒ", "x_y", "Q-r", "a b"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n))
    docs = [(rng.choice([i, i, i, None, 7]), text(rng.choice([0, 1, 5, 40]))) for i in range(300)] + [(900, None), (901, "-- \x00 !"), (902, "t1"), (903, "t1")]
    items = [(i % 15, text(rng.choice([0, 1, 3, 12]))) for i in range(20)] + [(50, None), (51, "nowhere"), (None, "t1 T1"), (52, " ".join(vocabulary))]
    rows = ranked.search(ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), Work(spark)), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str) == ranking(docs, items, 10)


def test_blocks_below_the_threshold_stay_closed():
    """A list of a common term is opened only where a rare one may lift it."""
    segment = ranked._Builder()
    texts = [f"common {'rare rare rare' if i % 1000 == 500 else ''} w{i}" for i in range(20_000)]
    segment.add(list(range(20_000)), texts)
    head, *batches = (b.to_pylist() for b in segment.rows("0.0"))
    blocks = {}
    for r in (r for b in batches for r in b):
        blocks.setdefault(r["term"], []).append(tuple(r[c] for c in ("first", "last", "n", "impacts", "docs", "tfs")))
    weights = {"common": ranked.weight(20_000, 20_000), "rare": ranked.weight(20_000, 20)}
    found = ranked._Segment((head[0]["first"], head[0]["docs"], head[0]["tfs"]), {t: blocks[t] for t in weights}, weights, 20_000, head[0]["total"])
    best = ranked._Best(10)
    found.search(["common", "rare"], best)
    assert sorted(best.rows[1].tolist()) == [500 + 1000 * i for i in range(10)]
    common = found.lists["common"]
    # the first ten are found in the first blocks; of the rest a block for each rare document
    assert common.opened.sum() <= (10_000 + 4096) // 128 + 20


def audited(docs, labels):
    """The audit by applying the filters one after the other."""
    least, flags = {}, []
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        flags.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], {}
    for part in {f[0] for f in flags}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in flags if f[0] == part]
            for step, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                before = [f for f in flags if f[0] == part and c in f[1] and f[1] & set(order[:step])]
                left = [f for f in left if c not in f[1]]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                out.append([part, "".join(order), step + 1, len(left), len(gone), len(before), sum(f[0] == part and f[1] == {c} for f in flags), sum(f[2] for f in gone), sum(f[3] for f in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_filters_in_order(spark, tmp_path):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        kind = rng.random()
        text = " ".join(rng.choice(["Word", "w", "X", "é", "#1", "ok"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 3, 99, 100, 101, 200])))
        if docs and kind < 0.3:
            text = rng.choice(docs)[1]
        elif kind < 0.6 and text:
            text = text.lower().replace("#", "")
        docs.append((rng.choice([i, i, i, None, 11]), rng.choice([text, text, text, text, text, None]), rng.choice(["en", "de", None, ""])))
    docs += docs[:5]
    labels = [(rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(120)] * 2
    folder = saved(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string"), labels=(labels, "doc_id long, quality int, toxic int"))
    rows = QUERIES["op13_audit"](spark, folder).collect()
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r[c] for c in names) for r in rows) == audited(docs, labels)


def test_words_of_the_audit_do_not_shuffle(spark, sf):
    docs = audit._documents(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = audit.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_of_slices_and_buckets_follow_the_words(spark):
    """Many partitions of few words do not meet in as many buckets each (op12_repeats)."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: (i * 7919 + F.col("id") * 104729) % 1_000_003), " ").alias("text")).repartition(40)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    plain = repeats._probes
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        repeats._probes = lambda known, buckets: made.append(plain(known, buckets).count()) or plain(known, buckets)
        repeats.repeats(docs, Work(spark))
    finally:
        repeats._probes = plain
        spark.conf.set("spark.sql.shuffle.partitions", width)
    # a row for the documents of a slice, and for each kind and bucket: 24,000 words fill two buckets
    assert made == [n for n in made if n <= 40 * (1 + 3 * 2)] and made
