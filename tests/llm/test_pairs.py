from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from brindle.llm import decontaminate, fingerprint, jaccard
from brindle.llm.queries import ORACLE_SQL, QUERIES
from brindle.llm.shingles import shingle_sets


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def components(docs, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in docs]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)), key=lambda k: sets[k][0])
                comp[y] = x
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)]) for i, (d, s) in enumerate(sets)}


def corpus(seed, n=240):
    """Groups of copies and near copies, chains, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(30)]
    docs, base = [], None
    for i in range(n):
        kind = rng.random()
        if base is None or kind < 0.3:
            base = [word() for _ in range(rng.choice([3, 5, 12, 40, 80]))]
            text = base[:]
        elif kind < 0.75:
            text = base[:]
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = word()
            base = text if rng.random() < 0.5 else base
        elif kind < 0.85:
            text = [word() for _ in range(30)] + passage
        elif kind < 0.9:
            text = []
        else:
            text = base[:] + [word()]
        docs.append((i * 7 % 1009, " ".join(w.upper() if rng.random() < 0.05 else w for w in text)))
    return docs


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 60, 100)])
def test_join_equals_brute_force(spark, seed, size, num, den):
    docs = corpus(seed)
    want = components(docs, size, num, den)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, num, den).collect()}
    assert got == want


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        t = base[:]
        t[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(t)))
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0}


@pytest.mark.parametrize("seed", [4, 5])
def test_copies_too_far_from_their_original(spark, seed):
    """Most copies do not link with the original; some link with one another."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    docs, variant = [(0, " ".join(base))], base
    for i in range(1, 120):
        text = (variant if rng.random() < 0.5 else base)[:]
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4, 5, 6])):
            text[at] = f"x{rng.randrange(40)}"
        variant = text if rng.random() < 0.3 else variant
        docs.append((i, " ".join(text)))
    want = components(docs, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def drifting(seed):
    """Each a copy of an earlier one with a few words replaced, added or cut."""
    rng = random.Random(seed)
    pool = [f"v{seed}x{i}" for i in range(rng.choice([10, 40, 200]))]
    docs = [[f"w{seed}x{i}" for i in range(rng.choice([30, 50, 80]))]]
    for _ in range(29):
        t = rng.choice(docs[-8:])[:]
        for _ in range(rng.choice([1, 1, 2, 3])):
            at, kind = rng.randrange(len(t)), rng.random()
            if kind < 0.4:
                t[at] = rng.choice(pool)
            elif kind < 0.7:
                t[at:at] = rng.sample(pool, rng.choice([1, 2, 4]))
            elif len(t) > 25:
                del t[at : at + rng.choice([1, 2, 4])]
        docs.append(t)
    return [(seed * 100 + i, " ".join(t)) for i, t in enumerate(docs)]


def test_prefixes_that_end_at_one_place(spark):
    """Pairs that meet one way round in some lists and the other way in others."""
    docs = [d for seed in (275, 314) for d in drifting(seed)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80, 100).collect()}
    assert got == components(docs, 2, 80, 100)


def test_repeated_and_missing_ids(spark):
    docs = [(5, "a b c d e f"), (5, "g h i j k l"), (7, "g h i j k l"), (None, "a b c d e f"), (None, "q r s t u"), (3, ""), (2, None)]
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert rows == [("2", 0, "2"), ("3", 0, "3"), ("5", 3, "5"), ("5", 3, "5"), ("7", 3, "5"), ("None", 2, "None"), ("None", 3, "5")]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = "a b c d e f g h", "g h i j k l m n", "q r s t u v w"
    docs = [(5, a, 1), (5, a, 1), (5, a.upper(), 2), (5, b, 3), (3, b, 4), (None, c, 5), (None, c, 6), (None, a, 7), (None, "x y", 8), (None, "", 9), (None, None, 10), (4, " \n", 11), (4, " \n", 11)]
    kept = jaccard.keep_one(spark.createDataFrame(docs, "doc_id int, text string, node int"))
    assert kept.columns == ["doc_id", "text", "node"]
    rows = sorted(r.node if r.node not in (5, 6) else 5 for r in kept.collect())
    assert rows in ([1, 4, 5, 8, 9, 10, 11, 11], [2, 4, 5, 8, 9, 10, 11, 11])


def test_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(map(tuple, QUERIES[name](spark, sf).select(*columns).collect())) == sorted(found.fetchall())


def edits(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_edit_matching_equals_brute_force():
    rng = random.Random(3)
    some = lambda lo, hi: "".join(rng.choice("ab c") for _ in range(rng.randint(lo, hi)))
    for _ in range(400):
        p, t = some(8, 24), some(1, 60)
        if rng.random() < 0.6:
            q = list(p)
            for _ in range(rng.randint(0, 3)):
                q[rng.randrange(len(q))] = rng.choice("ab")
            t = t[:20] + "".join(q) + t[20:]
        p, t = decontaminate.normal(p), decontaminate.normal(t)
        budget = int(0.2 * len(p))
        if not budget or not t:
            continue
        found, want = decontaminate.Matcher(((1, p),), 0.2).leaks(t), edits(p, t)
        assert [f["distance"] for f in found] == ([want] if want <= budget else [])
        for f in found:
            assert edits(p, t[f["start"] : f["end"]]) == want


def test_leaks_and_clean_documents(spark):
    item = "The capital of the old kingdom was moved three times before the river changed its course for good."
    items = spark.createDataFrame([(1, item), (2, "yes"), (3, None), (4, "...")], "item_id long, text string")
    near = item.replace("three", "thrice").replace("its", "it").upper().replace(" ", "\n")
    docs = spark.createDataFrame([(10, f"x {item} y"), (11, f"before {near} after"), (12, "the capital of another kingdom"), (13, "yesterday"), (14, "Oh, YES!"), (15, None)], "doc_id long, text string")
    found = {r.doc_id: [(x.item_id, x.distance) for x in r.leaks] for r in decontaminate.with_leaks(docs, items).collect()}
    assert found[10] == [(1, 0)] and found[11][0][0] == 1 and found[14] == [(2, 0)]
    assert not found[12] and not found[13] and not found[15]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [12, 13, 15]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    """op1 on documents with items left as they are, changed within and beyond the budget."""
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (120,))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(12)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 20))]
        q = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            q[rng.randrange(len(q))] = rng.choice("abcxyz")
        text.insert(rng.randint(0, len(text)), "".join(q))
        docs.append((i, " ".join(text)))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for i, t in docs:
        for k, q in items:
            p, n = decontaminate.normal(q), decontaminate.normal(t)
            budget = int(decontaminate.RATE * len(p))
            distance = edits(p, n) if budget else 0 if f" {p} " in f" {n} " else 99
            if distance <= budget:
                want.append((i, k, distance))
    got = sorted(tuple(r) for r in QUERIES["op1_decontamination"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(want) > 30
    kept = decontaminate.decontaminate(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {w[0] for w in want})


def test_columns_named_like_ours_stay(spark):
    items = spark.createDataFrame([(1, "some words of an item that leaks")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "clean", "mine")], "doc_id long, text string, __leaks string")
    assert tuple(decontaminate.decontaminate(docs, items).first()) == (1, "clean", "mine")


def test_items_without_id(spark):
    items = spark.createDataFrame([(None, "a passage that has no number of its own"), (1, "another passage that has a number"), (None, "yes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a passage that has no number of its own, another passage that has a number"), (2, "oh yes"), (3, "neither")], "doc_id long, text string")
    found = {r.doc_id: [(x.item_id, x.distance) for x in r.leaks] for r in decontaminate.with_leaks(docs, items).collect()}
    assert found == {1: [(None, 0), (1, 0)], 2: [(None, 0)], 3: []}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [3]


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(i, f"unique item number {i} of many words") for i in range(20)], "item_id long, text string")
    blocks = list(decontaminate.blocks_of(items, 100))
    assert len(blocks) > 5 and sum(map(len, blocks)) == 20 and all(sum(len(t) for _, t in b) <= 100 for b in blocks)


def test_fingerprints(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op4_fingerprint"](spark, sf).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    bias = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text, 5), shingles(edited, 5)
        bias.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1))
    assert abs(sum(bias) / len(bias)) < 0.02 and max(map(abs, bias)) < 0.3
    by_text = {}
    for i, text in docs:
        assert by_text.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint


def test_sketches_equal_brute_force():
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d", "e"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 80, 3000)] + ["é " * 300, "x"]
    for text, sketch in zip(texts, fingerprint.sketches(texts), strict=True):
        words = text.split()
        # the hash of a shingle is that of a text of its words alone
        grams = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} - {""}
        least = sorted({int(h) >> 16 for g in grams for h in shingle_sets([g], 5)[0]})[: fingerprint.K]
        assert sketch.tolist() == least


def test_neighbours_of_repeated_and_missing_ids(spark):
    docs = [(3, "c"), (None, "n"), (1, "b"), (1, "a"), (9, ""), (4, None)]
    rows = fingerprint.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    order = [(None, "n"), (1, "a"), (1, "b"), (3, "c"), (4, ""), (9, "")]
    want = sorted((str(i), fingerprint.sketches([t])[0].tolist(), fingerprint.sketches([order[(k + 1) % 6][1]])[0].tolist()) for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.sketch, r.next_sketch) for r in rows) == want
    one = fingerprint.compare_with_next(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].sketch == one[0].next_sketch


def test_neighbours_of_great_ids_beside_a_missing_one(spark):
    """Ids that a double cannot hold keep their order and their neighbours."""
    docs = [((1 << 53) + 1 + 2 * i, f"text {i}") for i in range(200)] + [(None, "none")]
    rows = fingerprint.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    texts = ["none"] + [t for _, t in docs[:200]]
    want = sorted((str(i), fingerprint.sketches([texts[(k + 1) % 201]])[0].tolist()) for k, i in enumerate([None] + [i for i, _ in docs[:200]]))
    assert sorted((str(r.doc_id), r.next_sketch) for r in rows) == want


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(300))
    df = fingerprint.with_sketch(spark.createDataFrame([(a, b, f"{a}\n{b}")], "x string, y string, z string"), "x", "sx")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "y", "sy"), "z", "sz")
    r = df.select(
        fingerprint.resemblance(fingerprint.merge(df.sx, df.sy), df.sz).alias("same"),
        fingerprint.containment(df.sx, df.sz).alias("inside"),
        fingerprint.resemblance(df.sx, df.sy).alias("apart"),
        fingerprint.distinct_count(df.sz).alias("n"),
    ).first()
    assert r.same > 0.9 and r.inside > 0.8 and r.apart == 0 and 450 < r.n < 1000
