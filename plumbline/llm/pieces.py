"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

The distinct words of a batch that are new to the process are concatenated and indexed by a suffix array; every piece of the
vocabulary is looked up by binary search, and its range of suffixes are its occurrences. These edges are sorted by position and
relaxed from left to right: an edge extends the path to its start if merging leaves its piece and the path's last piece apart. Every
prefix has one such path, which is what merging by score gives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_chunks
from .hashing import U, codepoints, mix, span_hashes

BLANK = "▁"
#: Distinct words that a process remembers, and how many are indexed at once.
REMEMBERED, INDEXED = 400_000, 60_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbers and values of a protocol buffer's fields; numbers of fixed width are skipped."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value, shift, at = value | (raw[at] & 127) << shift, shift + 7, at + 1
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            at += size
            yield key >> 3, raw[at - size : at]
        else:
            at += 8 if key & 7 == 1 else 4


def check(path: str) -> None:
    """Raise unless the model at path is BPE, takes texts as they are, and marks words by a blank before them: all that is done here."""
    with open(path, "rb") as f:
        specs = {k: dict(_fields(v)) for k, v in _fields(f.read()) if k in (2, 3) and isinstance(v, bytes)}
    trainer, normalizer = specs.get(2, {}), specs.get(3, {})
    told = {"not BPE": trainer.get(3, 1) != 2, "blanks behind words": trainer.get(24, 0), "normalizing": normalizer.get(2, b""), "no blank before a text": not normalizer.get(3, 1), "dropping blanks": normalizer.get(4, 1), "blanks as they are": not normalizer.get(5, 1)}
    if bad := [k for k, v in told.items() if v]:
        raise ValueError(f"{path}: a model of another kind ({', '.join(bad)})")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        check(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        plain = []
        self.silent = set()
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.byte_of[i] = int(name[3:5], 16)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.silent.add(i)
            else:
                plain.append(i)
        self.fallback = bool(self.byte_of)
        self.unknown = model.unk_id()
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        alphabet = sorted({ord(c) for i in plain for c in self.names[i]})
        self.alphabet = np.array(alphabet, np.uint32)
        self.shown = [name.replace(BLANK, " ") for name in self.names]
        self.odd = np.ones(n, bool)  # bytes, control pieces, unknown
        self.odd[plain] = False
        self.longest = max(len(self.names[i]) for i in plain)
        self.width = -(-self.longest // 4) * 4
        self.plain = np.array(sorted(plain, key=lambda i: self.names[i]), np.int64)
        self.sizes = np.array([len(self.names[i]) for i in self.plain])
        self.all_sizes = np.array([len(x) for x in self.names])
        low = np.zeros((len(plain), self.width), ">u2")
        high = np.full((len(plain), self.width), 0xFFFF, ">u2")
        for row, i in enumerate(self.plain.tolist()):
            codes = np.searchsorted(self.alphabet, [ord(c) for c in self.names[i]]) + 1
            low[row, : len(codes)] = high[row, : len(codes)] = codes
        self.low, self.high = (x.view(f"S{2 * self.width}").ravel() for x in (low, high))
        self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)  # what _stay_apart knows, sorted
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.at = [np.zeros(1, np.int64)]
        self.ids: list[np.ndarray] = []
        self.n = self.used = 0
        self._at = self._ids = None

    def merged(self, text: str) -> list[str]:
        """By definition: merge the neighbours whose union has the best score, the leftmost first, until none is a piece."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _stay_apart(self, keys: np.ndarray) -> np.ndarray:
        """For each key, last piece * pieces + next piece (the last none: the next stands alone), whether merging gives just these."""
        names, every = np.unique(keys, return_inverse=True)
        n = len(self.names)
        at = np.searchsorted(self.keys, names)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == names[hit]
        good = np.empty(len(names), bool)
        good[hit] = self.good[at[hit]]
        new = names[~hit]
        if len(new):
            fresh = []
            for k in new.tolist():
                a, b = divmod(k, n)
                parts = [self.names[b]] if a == n else [self.names[a], self.names[b]]
                fresh.append(self.merged("".join(parts)) == parts)
            good[~hit] = fresh
            self.keys, self.good = np.insert(self.keys, at[~hit], new), np.insert(self.good, at[~hit], fresh)
        return good[every]

    def _learn(self, names: list[int], words: list[str]) -> None:
        """Match and relax some distinct words together."""
        text = "\n".join([*words, ""])  # "\n" or not: 0 stands for what no piece has
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words])
        begin = np.cumsum([0, *(sizes + 1)])[:-1]
        n = len(codes)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        ranks = np.where(self.alphabet[at] == codes, at + 1, 0).astype(">u2")
        ranks[begin + sizes] = 0
        # the suffix array, by as many symbols as the longest piece has
        padded = np.concatenate([ranks, np.zeros(self.width, ">u2")]).astype(">u2")  # concatenating changes the byte order
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[:n])
        packed = suffixes.view(">u8").astype(U)
        order = np.lexsort(packed.T[::-1])
        ordered = suffixes[order].view(f"S{2 * self.width}").ravel()
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = last - first
        where = np.repeat(first - np.cumsum(found) + found, found) + np.arange(found.sum())
        start, piece, size = order[where], np.repeat(self.plain, found), np.repeat(self.sizes, found)
        odd = np.flatnonzero(ranks == 0)  # what no piece has is an edge of its own
        odd = odd[np.isin(odd, begin + sizes, invert=True)]
        start, piece, size = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), -1)]), np.concatenate([size, np.ones(len(odd), np.int64)])
        # edges by the place of their end in the word
        word = np.searchsorted(begin, start, "right") - 1
        end = start + size
        place = end - begin[word]
        by = np.argsort(place, kind="stable")
        start, piece, end, place = start[by], piece[by], end[by], place[by]
        many = len(self.names)
        nothing = -2
        path = np.full(n + 1, nothing, np.int64)
        path[begin] = many  # the border before a word
        cut = np.searchsorted(place, np.arange(1, int(sizes.max(initial=0)) + 2))
        for p in range(len(cut) - 1):
            s, t, e = start[cut[p] : cut[p + 1]], piece[cut[p] : cut[p + 1]], end[cut[p] : cut[p + 1]]
            before = path[s]
            ok = before != nothing
            s, t, e, before = s[ok], t[ok], e[ok], before[ok]
            free = (t < 0) | (before < 0)  # what no piece has never merges
            test = ~free
            alone = np.where(before < 0, many, before)
            good = np.ones(len(t), bool)
            good[test] = self._stay_apart(alone[test] * many + t[test])
            lone = free & (t >= 0)
            good[lone] = self._stay_apart(many * many + t[lone])
            path[e[good]] = t[good]
        # back from the ends
        here, out_word, out_piece, out_at = begin + sizes, [], [], []
        who = np.arange(len(words))
        while len(who):
            going = here > begin[who]
            who, here = who[going], here[going]
            t = path[here]
            if (t == nothing).any():
                raise AssertionError("a word has no path")
            here = here - np.where(t < 0, 1, self.all_sizes[np.maximum(t, 0)])
            out_word.append(who)
            out_piece.append(t)
            out_at.append(here)
        w, t, a = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_word, out_piece, out_at))
        by = np.lexsort([a, w])
        w, t, a = w[by], t[by], a[by]
        if (t < 0).any():  # by their bytes
            width = np.ones(len(t), np.int64)
            spelled = {int(i): self._spell(chr(codes[a[i]])) for i in np.flatnonzero(t < 0)}
            for i, x in spelled.items():
                width[i] = len(x)
            ids = np.repeat(t, width)
            firsts = np.cumsum(width) - width
            for i, x in spelled.items():
                ids[firsts[i] : firsts[i] + len(x)] = x
            w, t = np.repeat(w, width), ids
        counts = np.bincount(w, minlength=len(words))
        self.place.update(zip(names, range(self.n, self.n + len(words)), strict=True))
        self.at.append(self.used + np.cumsum(counts))
        self.ids.append(t.astype(np.int32))
        self.n, self.used = self.n + len(words), self.used + len(t)
        self._at = None

    def _spell(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        codes, sizes = codepoints(marked)
        n = len(codes)
        bounds = np.cumsum([0, *sizes])
        blank = codes == ord(BLANK)
        start = np.zeros(n + 1, bool)
        start[bounds] = True
        if n:  # a word begins at a blank after something else
            start[1:n] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(start[:n])
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        ends = np.append(starts[1:], n)
        counts = np.diff(np.searchsorted(starts, bounds))
        names, first, every = np.unique(span_hashes(mix(codes.astype(U)), starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self.forget()
        if len(self.keys) > 8 * REMEMBERED:
            self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        listed = names.tolist()
        new = [i for i, name in enumerate(listed) if name not in self.place]
        raw = codes.tobytes()
        for s in range(0, len(new), INDEXED):
            some = new[s : s + INDEXED]
            self._learn([listed[i] for i in some], [raw[4 * starts[f] : 4 * ends[f]].decode("utf-32-le", "surrogatepass") for f in first[some].tolist()])
        if self._at is None:
            self._at, self._ids = np.concatenate(self.at), np.concatenate(self.ids)
            self.at, self.ids = [self._at], [self._ids]
        place = np.array([self.place[name] for name in listed])[every]
        begin, width = self._at[place], self._at[place + 1] - self._at[place]
        total = np.concatenate([[0], np.cumsum(width)])
        ids = self._ids[np.repeat(begin - total[:-1], width) + np.arange(total[-1])]
        words = np.cumsum([0, *counts])
        return [ids[total[a] : total[b]] for a, b in zip(words, words[1:], strict=False)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Bytes are read as UTF-8, with U+FFFD for what isn't; control pieces are silent; ids out of the vocabulary are an error."""
        x = np.asarray(ids, np.int64)
        if len(x) and not 0 <= x.min() <= x.max() < len(self.names):
            raise ValueError(f"no piece has the id {x.min() if x.min() < 0 else x.max()}")
        listed = x.tolist()
        out: list[str] = []
        held = bytearray()
        done = 0
        for at in [*np.flatnonzero(self.odd[x]).tolist(), len(listed)]:
            b = self.byte_of.get(listed[at]) if at < len(listed) else None
            if held and (at > done or b is None):
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.extend(map(self.shown.__getitem__, listed[done:at]))
            if b is not None:
                held.append(b)
            elif at < len(listed) and listed[at] == self.unknown:
                out.append(" ⁇ ")
            done = at + 1
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of docs, by the BPE model file at path, which every executor must be able to read.

    A null or empty text has no ids. Rows that repeat an id, or have none, are each encoded. A text of any length is encoded whole; one
    of more than two million characters is indexed alone. Other columns are not read. A model of another kind is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for keys, texts in text_chunks(batches, 2 << 20):
            yield batch_of(_IDS, [keys, model.encode(texts)])

    check(path)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids make an empty text, a null among them is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield batch_of(_TEXT, [part.column(0), [model.decode([i for i in x or [] if i is not None]) for x in part.column(1).to_pylist()]])

    return rows.select(F.col(id_col).cast("long").alias("i"), F.col(ids_col).cast("array<int>").alias("x")).mapInArrow(run, "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_chars", pa.int64()), ("text_md5", pa.string())])


def digests(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_chars, text_md5) of encoded rows: their ids as little-endian 32-bit numbers, and the text that they decode to. Null ids are none, and make an empty text; rows are neither joined nor dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            ids, at, none = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy(), np.asarray(b.column(1).is_null())
            each = [ids[s : s if null else e] for s, e, null in zip(at, at[1:], none, strict=False)]
            texts = [model.decode(x) for x in each]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield batch_of(_DIGEST, [b.column(0), [len(x) for x in each], [zlib.crc32(x.astype("<u4").tobytes()) for x in each], [len(t) for t in texts], [hashlib.md5(x).hexdigest() for x in raw]])

    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_md5 string")
