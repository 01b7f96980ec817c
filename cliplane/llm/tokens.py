"""Vectorised tokenising and hashing of whole Arrow text arrays (UTF-8 bytes, NumPy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BYTES = np.arange(256)
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ before A-Z are lower-cased.
WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array and its offsets; null is empty."""
    col = pc.fill_null(text, "").cast(pa.large_binary())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class that don't cross documents: starts, ends, and the first run of each document."""
    mark = inside[data]
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start, end = mark.copy(), mark.copy()
    start[1:] &= ~mark[:-1]
    end[:-1] &= ~mark[1:]
    b, e = off[:-1], off[1:] - 1
    b, e = b[b < len(mark)], e[e >= 0]
    start[b], end[e] = mark[b], mark[e]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span, eight bytes at a time; another seed gives other hashes."""
    size = ends - starts
    lanes = np.zeros(len(data) + 8, np.uint8)
    lanes[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", lanes, 0, (1,))
    h = (lanes[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * (_A + U64(2 * seed)))
    h *= _B
    h ^= h >> U64(31)
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        v = lanes[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        g = (h[more] ^ v) * _C
        h[more] = (g ^ (g >> U64(29))) * _B
        k += 8
        more = more[size[more] > k]
    h *= _A
    return h ^ (h >> U64(32))


def word_hash(word: str | bytes) -> int:
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in the sorted keys, or -1. A bitmap of 2^16 spares most searches."""
    out = np.full(len(h), -1, np.int64)
    if not len(keys):
        return out
    seen = np.zeros(1 << 16, bool)
    seen[(keys >> U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> U64(48)).astype(np.int64)])
    v = h[maybe]
    at = np.searchsorted(keys, v)
    at[at == len(keys)] = 0
    out[maybe] = np.where(keys[at] == v, at, -1)
    return out
