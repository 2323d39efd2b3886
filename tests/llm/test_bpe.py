from __future__ import annotations

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from brindle.llm import bpe, tokencount  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "'s", "'", "$'", "é", "ß", "漢", "😀", "1", "²", "Ⅷ", "<|endoftext|>", "<|", "don't", "_", "\x00", "é", ".", "__", "aaaa", " x", "'ll", "\x0b"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read())


def ids(codes):
    return np.frombuffer(codes, dtype=np.int32).tolist()


def test_equals_the_library(library, own, spark, sf):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["ab" * 3000 + "é" * 500, "word " * 20000]
    for t in texts:
        found = own.encode(t)
        assert ids(found) == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert own.decode(ids(found)) == library.decode(ids(found), skip_special_tokens=False)


def test_long_texts_are_cut_only_where_certain(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    t = "  lead and many words in one long text, don't  cut  here\n\n" * 9
    assert ids(own.encode(t)) == library.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded_and_rotates(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3000)
    with open(PATH, "rb") as f:
        own = bpe.Codec(f.read())
    rng = random.Random(4)
    for _ in range(30):
        texts = ["".join(rng.choice(PARTS) for _ in range(40)) for _ in range(5)]
        codes = own.encode_all(texts)
        assert [ids(c) for c in codes] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert own.held <= bpe.MEMORY // 2
    own.forget()
    assert not own.known and not own.before


def test_unsupported_vocabularies_are_refused():
    import json

    with open(PATH, "rb") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "<x>", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(spec | change).encode())


def test_pattern_and_added_tokens_come_from_the_file():
    import json

    with open(PATH, "rb") as f:
        spec = json.load(f)
    split = {"type": "Split", "pattern": {"Regex": r"\s+|\S+"}, "behavior": "Isolated", "invert": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    spec["added_tokens"].append({"id": 50257, "content": "<plain>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    own, whole = bpe.Codec(json.dumps(spec).encode()), tokenizers.Tokenizer.from_str(json.dumps(spec))
    for t in ("don't  stop<plain>here", "a b\n c", "<plain>", "naïve 12x"):
        found = ids(own.encode(t))
        assert found == whole.encode(t, add_special_tokens=False).ids
        assert own.decode(found) == whole.decode(found, skip_special_tokens=False)


def test_null_and_unknown_ids_decode(spark):
    df = spark.createDataFrame([(1, [50256, 99999999, -5]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df, PATH).collect()} == {1: "<|endoftext|>", 2: "", 3: ""}


def test_no_token_holds_a_cut(own):
    assert not own.inside[ord("a") << 8 | ord(" ")]
    assert own.inside[ord(" ") << 8 | ord("t")] and own.inside[ord("t") << 8 | ord("h")]


def test_broken_utf8_decodes_to_the_replacement(own, library):
    codes = ids(own.encode("漢"))[:1]
    assert own.decode(codes) == library.decode(codes, skip_special_tokens=False)


def greedy(word, initial, continued):
    n = i = 0
    while i < len(word):
        pieces = initial if i == 0 else continued
        for j in range(len(word), i, -1):
            if word[i:j] in pieces:
                break
        else:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(0)
    some = lambda k: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
    for _ in range(200):
        initial, continued = some(rng.randint(1, 10)), some(rng.randint(1, 12))
        a = tokencount.Automaton(initial, continued)
        for _ in range(100):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 14)))
            assert a.read(word) == greedy(word, initial, continued)


def test_counts_of_the_vocabulary(spark):
    import json

    letter = bpe._byte_letters()
    with open(PATH, "rb") as f:
        tokens = {bytes(letter[c] for c in t) for t in json.load(f)["model"]["vocab"]}
    single = {bytes([b]) for b in range(256)}
    initial, continued = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | single, {t for t in tokens if t[:1] != b" "} | single
    texts = ["The quick brown fox", "", None, "unbelievableness   xqzzt 漢字", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in tokencount.count_tokens(df, PATH).collect():
        words = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w.encode(), initial, continued) for w in words))
