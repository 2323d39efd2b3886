"""BPE by forced boundaries: certain cuts first, fragments encoded independently.

A byte pair that occurs inside no vocabulary token can never be joined by merges,
so the text is cut there.  The cuts come at three grains: in very long texts at a
space between letters, between pre-tokens, and inside a pre-token wherever the byte
pair is in no token.  What
remains is encoded by merges in order of rank, all fragments of one length at
once, and the codes of the fragments are concatenated.

Decoding is a lookup in one table of the bytes of all tokens.

The vocabulary file is read on the driver and sent to the tasks; its size is
fixed by the file, a few MB.  Vocabularies whose pre-tokens or added tokens are of
a kind not built here are refused.  Pre-tokens once encoded are remembered up to
MEMORY bytes, those met lately the longest, and forgotten at a partition's end.

Edge cases: a null text gives no ids and decodes to ''; texts of any length are
encoded whole; bytes that are not UTF-8 decode to the replacement character; ids
that no token has decode to nothing; repeated rows give repeated results; an empty
table gives an empty table; other columns pass untouched (one named as the new
column is replaced).
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.arrow import lists, slices, small_batches
from brindle.llm.columns import numbered

# Fixed value: the public pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens and codes remembered by a task, and what an entry takes besides.
MEMORY, ENTRY = 48_000_000, 200
#: A rank holds its order above the 24 bits of the id that the pair becomes.
ID_MASK, NONE = (1 << 24) - 1, 1 << 62
#: Characters of a text pre-tokenised at once, cut where a cut is certain;
#: characters encoded, and ids decoded, at a time.
STRETCH, GROUP = 1_000_000, 4_000_000
#: Fragments longer than this are merged one by one.
LONG = 64
_CERTAIN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1
    bytes are themselves, the rest follow from 256 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pre_token_pattern(spec: dict) -> str:
    """The pattern of a vocabulary's pre-tokens; an error for what is not built here."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps["pretokenizers"] if steps.get("type") == "Sequence" else [steps]
    *before, last = steps
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
        raise ValueError("only byte-level vocabularies without normalizer, prefix space and dropout are supported")
    if not before and last.get("use_regex", True):
        return PRE_TOKEN
    if len(before) == 1 and before[0].get("type") == "Split" and before[0].get("behavior") == "Isolated" and not before[0].get("invert") and "Regex" in before[0]["pattern"] and not last.get("use_regex", True):
        return before[0]["pattern"]["Regex"]
    raise ValueError("unsupported pre-tokens")


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        pattern = pre_token_pattern(spec)
        self.split = regex.compile(pattern).findall
        #: whether long texts may be cut at spaces before their pre-tokens are known
        self.by_spaces = pattern == PRE_TOKEN
        letter = _byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.single = np.asarray([vocab[bytes([b])] for b in range(256)], dtype=np.int32)
        self.rank: dict[int, int] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.rank[vocab[a] << 32 | vocab[b]] = order << 24 | vocab[a + b]
        self.pairs = np.asarray(sorted(self.rank), dtype=np.int64)
        self.ranks = np.asarray([self.rank[k] for k in self.pairs.tolist()] + [NONE], dtype=np.int64)
        high, low = np.divmod(np.arange(65536), 256)
        self.first = self._ranks_of(self.single[high], self.single[low])
        self.inside = np.zeros(65536, dtype=bool)
        joined = np.frombuffer(b"".join(vocab), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, vocab), dtype=np.int64, count=len(vocab)))
        pair = joined[:-1] << 8 | joined[1:]
        self.inside[np.delete(pair, ends[:-1] - 1)] = True
        bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(bytes_of) + 1
        self.width = np.asarray([len(bytes_of.get(i, b"")) for i in range(size)] + [0], dtype=np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.table = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drops what was remembered."""
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE) if len(self.pairs) else np.full(len(key), NONE)

    def merge_all(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """int32 codes of fragments: the pair of least rank, leftmost first, until none
        is left.  Fragments of one length are the rows of one array."""
        out: dict[bytes, bytes] = {}
        by_length: dict[int, list[bytes]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        for n, rows in by_length.items():
            if n > LONG:
                out |= {p: self._merge_long(p) for p in rows}
                continue
            data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, n)
            ids, rank, own = self.single[data], self.first[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]], np.arange(len(rows))
            while len(own):
                least = rank.min(axis=1) if rank.shape[1] else np.full(len(own), NONE)
                done = least == NONE
                if done.any():
                    wide, codes = 4 * ids.shape[1], ids[done].tobytes()
                    for k, i in enumerate(own[done].tolist()):
                        out[rows[i]] = codes[k * wide : (k + 1) * wide]
                    go = ~done
                    ids, rank, own, least = ids[go], rank[go], own[go], least[go]
                    if not len(own):
                        break
                ids, rank = self._merged(ids, rank, least)
        return out

    def _merged(self, ids: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge in every row."""
        rows, at = np.arange(len(ids)), (rank == least[:, None]).argmax(axis=1)
        ids[rows, at] = least & ID_MASK
        keep = np.ones(ids.shape, dtype=bool)
        keep[rows, at + 1] = False
        ids = ids[keep].reshape(len(ids), -1)
        keep = np.ones(rank.shape, dtype=bool)
        keep[rows, at] = False
        rank = rank[keep].reshape(len(ids), -1)
        for some, left in ((np.flatnonzero(at > 0), at - 1), (np.flatnonzero(at < rank.shape[1]), at)):
            a = left[some]
            rank[some, a] = self._ranks_of(ids[some, a], ids[some, a + 1])
        return ids, rank

    def _merge_long(self, data: bytes) -> bytes:
        """The same for one fragment with a heap over a linked list, near-linear in
        its length."""
        ids = self.single[np.frombuffer(data, dtype=np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j, joined = right[i], rank & ID_MASK
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = joined, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return array("i", [x for x in ids if x >= 0]).tobytes()

    def _pre_tokens(self, tokens: set[str]) -> dict[str, bytes]:
        """Codes of pre-tokens, each cut at every byte pair that is in no token."""
        if not tokens:
            return {}
        names = list(tokens)
        raw = [t.encode() for t in names]
        flat = b"".join(raw)
        data = np.frombuffer(flat, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = ~self.inside[data[:-1] << 8 | data[1:]] if len(data) > 1 else False
        cut[ends] = cut[0] = True
        bounds = np.flatnonzero(cut)
        upto = np.searchsorted(bounds, ends).tolist()
        parts = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        codes = self.merge_all(set(parts))
        return {t: codes[parts[i]] if j - i == 1 else b"".join(map(codes.__getitem__, parts[i:j])) for t, i, j in zip(names, [0, *upto[:-1]], upto, strict=True)}

    def _encode_group(self, parts: list[str]) -> list[bytes]:
        """Codes of stretches that start and end at certain cuts; each pre-token is
        encoded once for all of them."""
        tokens = [self.split(p) for p in parts]
        wanted = set(chain.from_iterable(tokens)).difference(self.known)
        again = [t for t in wanted if t in self.before]
        self.known.update((t, self.before[t]) for t in again)
        fresh = self._pre_tokens(wanted.difference(again))
        self.known |= fresh
        out = [b"".join(map(self.known.__getitem__, t)) for t in tokens]
        self.held += sum(map(len, fresh)) + sum(map(len, fresh.values())) + ENTRY * len(wanted)
        if self.held > MEMORY // 2:
            self.before, self.known, self.held = self.known, {}, 0
        return out

    def _parts(self, text: str) -> Iterator[str]:
        for part in self.specials.split(text) if self.specials and self.specials.search(text) else (text,):
            if part in self.special:
                yield part
            elif part:
                yield from _stretches(part) if self.by_spaces else (part,)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """int32 codes of whole texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []

        def flush() -> None:
            plain = [(i, p) for i, p in group if p not in self.special]
            codes = iter(self._encode_group([p for _, p in plain]))
            for i, p in group:
                out[i].append(array("i", [self.special[p]]).tobytes() if p in self.special else next(codes))
            group.clear()

        held = 0
        for i, text in enumerate(texts):
            for p in self._parts(text):
                group.append((i, p))
                held += len(p)
                if held >= GROUP:
                    flush()
                    held = 0
        if group:
            flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids."""
        known = np.where((ids >= 0) & (ids < len(self.width)), ids, len(self.width) - 1)
        width = self.width[known]
        ends = np.cumsum(width)
        data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        for i in range(0, len(known), GROUP // 4):
            k, w, e = known[i : i + GROUP // 4], width[i : i + GROUP // 4], ends[i : i + GROUP // 4]
            low, high = int(e[0] - w[0]), int(e[-1])
            data[low:high] = self.table[np.repeat(self.place[k] - (e - w), w) + np.arange(low, high)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        raw = data.tobytes()
        whole = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.array(whole, pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, dtype=np.int64), np.asarray([len(ids)]))[0].as_py()


def _stretches(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > STRETCH and (cut := _CERTAIN.search(text, start + STRETCH)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=1)
def codec(source: bytes) -> Codec:
    """One codec for a worker process."""
    return Codec(source)


def read_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _extended(schema: T.StructType, *new: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([*(f for f in schema.fields if f.name not in names), *(T.StructField(n, t) for n, t in new)])


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns.values()], [*(batch.schema.names[i] for i in keep), *columns])


def _encoded(df: DataFrame, vocabulary: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    source = read_vocabulary(df.sparkSession, vocabulary)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source.value)
        try:
            for batch, texts in slices(batches, text):
                codes = own.encode_all(texts)
                sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
                flat = np.frombuffer(b"".join(codes), dtype=np.int32)
                yield _with(batch, {ids: lists(flat, sizes)} | ({decoded: own.decode_all(flat, sizes)} if decoded else {}))
        finally:
            own.forget()

    new = [(ids, T.ArrayType(T.IntegerType()))] + ([(decoded, T.StringType())] if decoded else [])
    rows = numbered(df, text, *(n for n, _ in new))
    return rows.mapInArrow(run, _extended(rows.schema, *new)).toDF(*_extended(df.schema, *new).names)


def encode(df: DataFrame, vocabulary: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds array<int> ``into``, the ids of ``text``; added tokens in it are one id."""
    return _encoded(df, vocabulary, text, into, None)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of ``text`` and the text that they decode to, in one pass."""
    return _encoded(df, vocabulary, text, ids, decoded)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds string ``into``, the text of array<int> ``ids``; null ids give ''."""
    source = read_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [np.asarray([-1 if x is None else x for x in r or ()], dtype=np.int64) for r in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield _with(part, {into: own.decode_all(np.concatenate(rows), np.asarray(list(map(len, rows))))})

    rows, new = numbered(df, ids, into), (into, T.StringType())
    return rows.mapInArrow(run, _extended(rows.schema, new)).toDF(*_extended(df.schema, new).names)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole document encoded and decoded, digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, vocabulary or default_vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
