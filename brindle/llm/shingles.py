"""Word-shingle hashes of whole texts, in numpy.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z in lower
case.  A shingle is ``size`` words in a row; a text of fewer words, but at least
one, is one shingle; a text without words has none.  Hashes are 64 bits wide.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes of text hashed at once (a longer text is hashed alone); bounds memory.
CHUNK = 1_000_000
_RNG = np.random.default_rng(20_24)
_BASE = int(_RNG.integers(1 << 62)) | 1
_STEPS = _RNG.integers(1 << 62, size=64).astype(np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on every bit (the
    finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, known: dict[str, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    table = known.get("table")
    if table is None or len(table) < n:
        table = np.full(max(n, 256), _BASE, dtype=np.uint64)
        table[0] = 1
        known["table"] = table = np.multiply.accumulate(table)
    return table[:n]


def _word_hashes(data: np.ndarray, letter: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word, each byte read as ``letter`` says."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    gaps = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)
    letters = np.where(space, 0, letter[data].astype(np.uint16) + 1)[starts[0] :].astype(np.uint64)
    return mix(np.add.reduceat(letters * _powers(int(gaps.max()))[place], starts - starts[0])), starts


def _chunk(texts: list[bytes], size: int) -> list[np.ndarray]:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    words, starts = _word_hashes(np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8))
    edges = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    n = len(words) - size + 1
    rolled = sum((words[j : j + n] * _STEPS[j] for j in range(size)), np.uint64(0)) if n > 0 else words[:0]
    hashes, out = mix(rolled), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _STEPS[: b - a]).sum(keepdims=True)))
        else:
            out.append(hashes[:0])
    return out


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending (uint64)."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    held = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if chunk and held + len(data) > CHUNK:
            out += _chunk(chunk, size)
            chunk, held = [], 0
        chunk.append(data)
        held += len(data)
    return out + (_chunk(chunk, size) if chunk else [])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, unchanged, of all texts in a row, and the number of
    words of each text.  Long texts are hashed in pieces cut between words."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) + 1
    data = b" ".join([*coded, b""])
    ends, parts, starts, at = np.cumsum(sizes), [], [], 0
    while at < len(data):
        cut = _GAP.search(data, min(at + CHUNK, len(data) - 1))
        stop = cut.end()
        hashes, first = _word_hashes(np.frombuffer(data[at:stop], dtype=np.uint8), _SAME)
        parts.append(hashes)
        starts.append(first + at)
        at = stop
    first = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), counts
