"""Vectorised byte and word hashing over Arrow text columns.

Words and lines are hashed by a polynomial over random byte values modulo 2**64. Such a hash has known collisions
between crafted strings of a thousand letters and more, so strings over LONG bytes are hashed by blake2b instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII after lower-casing, and every byte outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, 1 << 20) + 1, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which spans() takes the hash of any run of bytes."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def safe(h: np.ndarray, folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """h with the hashes of spans over LONG bytes replaced by blake2b's."""
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(folded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, at: np.ndarray, letters: np.ndarray, fold: np.ndarray = LOWER):
    """(hashes, starts, ends, first): words of each row as 64-bit hashes, their byte spans, and each row's first word.

    letters marks the bytes of words after fold; words end where a row ends.
    """
    n = len(data)
    folded = fold[data]
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(at), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letters[folded]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    h = safe(spans(prefix_sums(folded), start, end), folded, start, end)
    return h, start, end, np.searchsorted(start, at).astype(np.int64)


def ngrams(h: np.ndarray, first: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and each row's first; whole: a shorter row, not empty, is one n-gram."""
    count = np.diff(first)
    per = np.maximum(count - n + 1, 0)
    short = (count > 0) & (per == 0) if whole else np.zeros(len(count), bool)
    m = per + short
    out_at = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=out_at[1:])
    out = np.empty(out_at[-1], np.uint64)
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            g += h[j : len(h) - n + 1 + j] * np.uint64(pow(int(_BASE), j + 3, 1 << 64))
        pos = np.repeat(first[:-1] - out_at[:-1], m) + np.arange(out_at[-1])
        full = np.repeat(~short, m)
        out[full] = mix(g[pos[full]] + np.uint64(n))
    for i in np.flatnonzero(short):
        acc = 0
        for x in h[first[i] : first[i + 1]].tolist():
            acc = (acc * int(_BASE) + x) % (1 << 64)
        out[out_at[i]] = mix(np.array([acc + int(count[i]) * 0x51ED2701 & (1 << 64) - 1], np.uint64))[0]
    return out, out_at


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's run."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
