"""Vectorised 64-bit hashes of the words of many texts at once, and the kinds of their code points."""

from __future__ import annotations

import unicodedata

import numpy as np

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], U))[0])


BYTE = mix(np.arange(256, dtype=U))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        t = np.full(size, base, U)
        t[0] = 1
        _tables[base] = t = np.multiply.accumulate(t)
    return t[:n]


def forget() -> None:
    """Drop the tables of powers; they grow with the longest run of codes and are made again when needed."""
    _tables.clear()


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[start:end] for each span, from one running sum; codes are already spread over 64 bits."""
    n = len(codes)
    sums = np.zeros(n + 1, U)
    np.cumsum(codes * _powers(_RADIX, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix(h ^ mix((ends - starts).astype(U)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs of bytes but ASCII white space) of the texts, and the number of words of each."""
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, at))
    return span_hashes(BYTE[raw], starts, ends), counts


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of k words, A-Z lower-cased; fewer words make one shingle, no words none."""
    words, counts = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    n = len(words)
    grams = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        grams += words[j : n - k + 1 + j] * U(mix_int(j + 1) | 1)
    grams = mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(grams[at : at + c - k + 1]))
        elif c:
            whole = sum(int(w) * (mix_int(j + 1) | 1) for j, w in enumerate(words[at : at + c])) + mix_int(-c)
            out.append(np.array([mix_int(whole)], U))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out


#: Kinds of code points.
LETTER, UPPER, NUMBER, BLANK, OTHER = range(5)
_kinds = np.full(0x110000, 255, np.uint8)


def _kind(code: int) -> int:
    c = chr(code)
    if c.isspace() and not 0x1C <= code <= 0x1F:
        return BLANK
    sort = unicodedata.category(c)
    return UPPER if sort == "Lu" else LETTER if sort[0] == "L" else NUMBER if sort[0] == "N" else OTHER


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the number of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.array([len(t) for t in texts], np.int64)


def classes(codes: np.ndarray) -> np.ndarray:
    """LETTER (but capitals), UPPER, NUMBER, BLANK or OTHER for each code point."""
    found = _kinds[codes]
    if (found == 255).any():
        for c in np.unique(codes[found == 255]).tolist():
            _kinds[c] = _kind(c)
        found = _kinds[codes]
    return found
