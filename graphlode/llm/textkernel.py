"""Vectorised text primitives shared by the operators: no Python object is made for a token or a character.

A chunk is a run of documents as one array of lower-cased code points. A token is a maximal run of letters and digits
(Unicode L and N, as str.isalnum has it) inside one document; it is known by a 64-bit hash that doesn't depend on where
it stands. Lower-casing maps single characters only. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower, word): lower case by code point; whether it is a letter or digit."""
    n = 0x110000
    lower = np.arange(n, dtype=np.uint32)
    word = np.zeros(n, dtype=bool)
    for i in range(n):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        word[i] = c.isalnum()
        low = c.lower()
        if low != c and len(low) == 1:
            lower[i] = ord(low)
    return lower, word


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(size, np.uint64(base))
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)


def powers(n: int, base: int = int(_BASE)) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64."""
    return _powers(1 << max(6, (max(n, 1) - 1).bit_length()), base)[:n]


class Codes(NamedTuple):
    """Documents first .. first + len(at) - 2 of a batch; document i is cp[at[i]:at[i + 1]], not lower-cased."""

    first: int
    cp: np.ndarray
    at: np.ndarray


def _offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def _decode(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part = raw[off[0] : off[-1]]
    try:
        cp = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if len(cp) == len(part):
            return cp, off - off[0]
        starts = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=starts[1:])
        return cp, starts[off - off[0]]
    except UnicodeDecodeError:
        each = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(off, off[1:])]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def chunks(col: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Codes]:
    """The documents of a string column in order, about `most` bytes at a time; a longer document comes alone."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    if n == 0:
        return
    if pa.types.is_null(col.type):
        col = pa.nulls(n, pa.string())
    if col.null_count:
        col = col.fill_null("")
    off, raw = _offsets(col)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        cp, at = _decode(raw, off[i : j + 1])
        yield Codes(i, cp, at)
        i = j


class Tokens(NamedTuple):
    """hash, start and end (code points from the chunk's start) of each token; document i has tokens at[i] .. at[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def tokenize(codes: Codes, hashed: bool = True) -> Tokens:
    lower, word = tables()
    cp, at = codes.cp, codes.at
    is_word = np.empty(len(cp) + 1, dtype=bool)
    is_word[:-1] = word[cp]
    is_word[-1] = False
    first = is_word[:-1].copy()
    first[1:] &= ~is_word[:-2]
    last = is_word[:-1] & ~is_word[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(cp))]
    first[inner] = is_word[inner]  # a document's first letter starts a token even where the one before ends in a letter
    last[inner - 1] = is_word[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    h = hash_runs(lower[cp[is_word[:-1]]], end - start) if hashed else np.zeros(0, np.uint64)
    return Tokens(h, start, end, np.searchsorted(start, at))


def hash_runs(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the runs, laid end to end, of non-zero lengths."""
    if len(length) == 0:
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    place = np.arange(len(letters), dtype=np.int64)
    place -= np.repeat(begin, length)
    with np.errstate(over="ignore"):
        terms = powers(int(length.max()))[place]
        terms *= letters.astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(terms, begin))


def hash_word(word: str) -> int:
    """The hash that a token has."""
    letters = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    lower, _ = tables()
    return int(hash_runs(lower[letters], np.array([len(letters)]))[0])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp (polynomial) hashes modulo 2**64 of every window of `size` values, joined by doubling; mixed."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        done, out, part, width, rest = 0, None, h, 1, size
        while rest:
            if rest & 1:
                if out is None:
                    out, done = part, width
                else:
                    m = min(len(out), len(part) - done)
                    out = out[:m] * np.uint64(pow(int(_BASE), width, 1 << 64)) + part[done : done + m]
                    done += width
            rest >>= 1
            if rest:
                m = len(part) - width
                part = part[:m] * np.uint64(pow(int(_BASE), width, 1 << 64)) + part[width : width + m]
                width *= 2
        return mix(out[: len(h) - size + 1].copy())


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, and so on for each."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return np.arange(total, dtype=np.int64) + shift


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
