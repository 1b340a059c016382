"""Byte-level BPE of many texts at once: words are cut by array operations and every distinct word is merged once."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

from .hashing import BLANK, NUMBER, OTHER, U, classes, codepoints, mix, span_hashes

#: The words that end with an apostrophe's contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct words that a process remembers.
REMEMBERED = 200_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, starts and ends of their words, and the number of words of each text.

    Words: contractions; a run of letters, of numbers or of other signs with one blank before it if it is U+0020; white space, but
    for the last of it before a word."""
    codes, sizes = codepoints(texts)
    n = len(codes)
    kinds = classes(codes)
    kinds = np.where(kinds == BLANK, 2, np.where(kinds == NUMBER, 1, np.where(kinds == OTHER, 3, 0))).astype(np.int8)
    bounds = np.cumsum([0, *sizes])
    begin = np.zeros(n + 1, bool)
    begin[bounds] = True
    change = begin[:n].copy()
    if n:
        change[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == 2
    start = change.copy()
    # the last white space of a run that ends at a word: its own start, and the word's if it is U+0020
    before = np.zeros(n, bool)
    if n:
        before[:-1] = blank[:-1] & ~blank[1:] & ~begin[1:n]
    start |= before
    taken = np.flatnonzero(before & (codes == 32)) + 1
    start[taken] = False
    quote = np.flatnonzero((codes == 39) & start)
    for q in quote.tolist():
        stop = int(bounds[np.searchsorted(bounds, q, "right")])
        for c in CONTRACTIONS:
            if q + len(c) < stop and all(codes[q + 1 + j] == ord(x) for j, x in enumerate(c)):
                start[q + 1 : q + 1 + len(c)] = False
                if q + 1 + len(c) < stop:
                    start[q + 1 + len(c)] = True
                break
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return codes, starts, ends, np.diff(np.searchsorted(starts, bounds))


class Encoder:
    """ids of texts by the vocabulary file of a byte-level BPE tokenizer. The strings of added tokens are those tokens wherever they
    stand; what lies between two of them is encoded on its own."""

    def __init__(self, path: str):
        import tiktoken

        symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        if known.get("normalizer") or any(t["single_word"] for t in known["added_tokens"]):
            raise ValueError("the tokenizer has a normalizer, or added tokens that only match whole words")
        self.added = {t["content"]: t["id"] for t in known["added_tokens"]}
        blank = lambda t, side: r"\s*" if t[side] else ""
        shown = (blank(t, "lstrip") + re.escape(t["content"]) + blank(t, "rstrip") for t in sorted(known["added_tokens"], key=lambda t: -len(t["content"])))
        self.token = re.compile("|".join(shown)) if self.added else None
        ranks = {bytes(symbols[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in self.added}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.sizes = np.zeros(1 << 12, np.int64)
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, names: list[int], words: list[bytes]) -> None:
        new = [self.merge(w) for w in words]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        n, k = len(self.place), int(sizes.sum())
        for name, grown in (("sizes", n + len(new)), ("at", n + len(new)), ("ids", self.used + k)):
            if len(a := getattr(self, name)) < grown:
                setattr(self, name, np.concatenate([a, np.zeros(max(grown, len(a)), a.dtype)]))
        self.sizes[n : n + len(new)] = sizes
        self.at[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + k] = np.fromiter(chain.from_iterable(new), np.uint32, k)
        self.used += k
        self.place.update(zip(names, range(n, n + len(new)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.token or not any(c in t for t in texts for c in self.added):
            return self._encode(texts)
        parts: list[str] = []
        tokens: list[list[int]] = []
        for t in texts:
            at, found = 0, []
            for m in self.token.finditer(t):
                parts.append(t[at : m.start()])
                found.append(self.added[m[0] if m[0] in self.added else m[0].strip()])
                at = m.end()
            parts.append(t[at:])
            tokens.append(found)
        ids, out, at = self._encode(parts), [], 0
        for found in tokens:
            mixed = [ids[at]]
            for k, token in enumerate(found):
                mixed += [np.array([token], np.uint32), ids[at + k + 1]]
            out.append(np.concatenate(mixed))
            at += len(found) + 1
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        codes, starts, ends, counts = spans(texts)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        names, first, every = np.unique(span_hashes(mix(codes.astype(U)), starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self.forget()
        listed = names.tolist()
        at = np.fromiter(map(self.place.get, listed, repeat(-1)), np.int64, len(listed))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            raw = "".join(texts).encode("utf-8", "surrogatepass")
            byte = np.zeros(len(codes) + 1, np.int64)  # where each code point begins
            np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int8) + (codes > 0xFFFF), out=byte[1:])
            begin, end = byte[starts[first[unknown]]].tolist(), byte[ends[first[unknown]]].tolist()
            at[unknown] = len(self.place) + np.arange(len(unknown))
            self._learn(names[unknown].tolist(), [raw[b:e] for b, e in zip(begin, end, strict=True)])
        place = at[every]
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[place] - total[:-1], sizes) + np.arange(total[-1])]
        words = np.cumsum([0, *counts])
        return [ids[total[a] : total[b]] for a, b in zip(words, words[1:], strict=False)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
