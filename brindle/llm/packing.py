"""Integers packed into bytes, in numpy: seven bits a byte, the high bit marks that more follow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values (not negative), and where each value's bytes end."""
    values = values.astype(np.uint64)
    sizes, over = np.ones(len(values), dtype=np.int64), values >> np.uint64(7)
    while over.any():
        sizes += over > 0
        over >>= np.uint64(7)
    ends = np.cumsum(sizes)
    out, starts = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8), ends - sizes
    for j in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > j)
        part = (values[at] >> np.uint64(7 * j) & np.uint64(127)).astype(np.uint8)
        out[starts[at] + j] = part | np.where(sizes[at] > j + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """The values of packed bytes, as int64."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), starts)


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of ascending runs; each run, from one of ``starts`` on, begins with its own value."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: the bytes of ``data`` between consecutive cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.asarray(cuts, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
