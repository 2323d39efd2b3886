"""Token counts: a linear longest-match automaton over a word-piece vocabulary.

Words are runs without white space.  A word's first piece is the longest initial
piece it starts with, each further one the longest continuation piece; a word
that cannot be finished so is one unknown token.  The automaton is a trie of both
kinds of piece; every node has a failure link to the node of what would be left
after taking pieces greedily, and the number of pieces taken.  A word is read
once, byte by byte, and no piece is ever built.

Edge cases: a null or empty text has no words and no tokens; a word of any length
is read whole; repeated rows give repeated results; an empty table gives an empty
table; other columns pass untouched (those named as new ones are replaced).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.llm.arrow import slices
from brindle.llm.bpe import _byte_letters, _extended, _with, default_vocabulary, read_vocabulary

#: Words remembered by a task at most; beyond it the memory starts afresh.
MEMORY = 300_000
INITIAL, CONTINUED = 0, 1


class Automaton(dict):
    """word -> number of its pieces; unknown words are read when asked for."""

    def __init__(self, initial: set[bytes], continued: set[bytes]):
        self.next: dict[int, int] = {}
        self.popped, self.fail = [0, 0], [-1, -1]
        letters, whole, order = [(-1, 0), (-1, 0)], [False, False], []
        for root, pieces in ((INITIAL, initial), (CONTINUED, continued)):
            for piece in pieces:
                node = root
                for b in piece:
                    child = self.next.get(node << 8 | b)
                    if child is None:
                        child = len(letters)
                        self.next[node << 8 | b] = child
                        letters.append((node, b))
                        whole.append(False)
                        self.popped.append(0)
                        self.fail.append(-1)
                    node = child
                whole[node] = whole[node] or bool(piece)
        depth = [0] * len(letters)
        for v in range(2, len(letters)):
            depth[v] = depth[letters[v][0]] + 1
        order = sorted(range(2, len(letters)), key=depth.__getitem__)
        for v in order:
            if whole[v]:
                self.fail[v], self.popped[v] = CONTINUED, 1
                continue
            parent, b = letters[v]
            z, taken = self.fail[parent], self.popped[parent]
            while z >= 0 and (z << 8 | b) not in self.next:
                taken, z = taken + self.popped[z], self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.next[z << 8 | b], taken

    def read(self, word: bytes) -> int:
        node, count, step, fail, popped = INITIAL, 0, self.next, self.fail, self.popped
        for b in word:
            while (child := step.get(node << 8 | b)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node > CONTINUED:
            count += popped[node]
            node = fail[node]
        return 1 if node < 0 else count

    def __missing__(self, word: str) -> int:
        count = self.read(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = count
        return count


@lru_cache(maxsize=1)
def automaton(source: bytes) -> Automaton:
    """Of a byte-level vocabulary: tokens that start with a space are initial
    pieces without it, as are all bytes; the rest are continuation pieces."""
    letter = _byte_letters()
    tokens = {bytes(letter[c] for c in t) for t in json.loads(source)["model"]["vocab"]}
    single = {bytes([b]) for b in range(256)}
    return Automaton({t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | single, {t for t in tokens if t[:1] != b" "} | single)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds n_words and n_tokens of ``text``."""
    source = read_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(source.value)
        for batch, texts in slices(batches, text):
            words = [t.split() for t in texts]
            yield _with(batch, {"n_words": pa.array(map(len, words), pa.int64()), "n_tokens": pa.array([sum(map(own.__getitem__, w)) for w in words], pa.int64())})

    return df.mapInArrow(run, _extended(df.schema, ("n_words", T.LongType()), ("n_tokens", T.LongType())))


def op6_tokencount(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Words and word-piece tokens of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, vocabulary or default_vocabulary()).select("doc_id", "n_words", "n_tokens")
