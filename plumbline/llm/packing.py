"""Packing documents into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and one remainder. The remainders' length histogram is a cutting-stock problem: a
pattern is a multiset of lengths that fit a sequence, a linear program chooses how often each pattern is used, a knapsack by dynamic
programming prices new patterns until they gain less than a stated share, and the solution is rounded down. A remainder may be cut once more at its highest power of two,
which stands alone without padding; such cuts are columns of the program too. What rounding leaves is packed best fit decreasing.

Patterns are given to documents by their rank among those of equal remainder, so only the histogram (at most size - 1 numbers) and a
few counts for each partition come to the driver. Texts are encoded once, in place; what is written are lengths and checksums.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import batch_of, materialize, partitions, text_chunks

SIZE = 1024
#: What a cut costs, and a sequence that isn't full, in tokens of padding.
CUT, SHORT = 8.0, 2.0
#: The linear program is solved until this many more patterns lower its cost by less than this share of the remainders' tokens.
ROUND, GAIN = 50, 1e-4


def top(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def padding(fill: int, size: int = SIZE) -> int:
    return 0 if fill & (fill - 1) == 0 else size - fill


@dataclass
class Plan:
    """patterns: ({length: times}, uses); cuts: length -> how many remainders of that length are cut; histogram: remainders by length."""

    size: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    cuts: dict[int, int] = field(default_factory=dict)
    histogram: dict[int, int] = field(default_factory=dict)


def _price(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of lengths that fill c exactly, and the last length taken, for each c."""
    value, last = np.full(size + 1, -np.inf), np.zeros(size + 1, int)
    value[0] = 0
    for c in range(1, size + 1):
        k = min(c, len(y) - 1)
        v = y[1 : k + 1] + value[c - 1 :: -1][:k]
        last[c] = int(v.argmax()) + 1
        value[c] = v[last[c] - 1]
    return value, last


def solve(histogram: dict[int, int], size: int = SIZE, gain: float = GAIN) -> Plan:
    """A plan for the histogram of remainders (1 to size - 1), which covers every remainder. The linear program is solved to its
    least cost, or until ROUND more patterns lower the cost by less than gain, as a share of all tokens."""
    histogram = {r: n for r, n in histogram.items() if n}
    lengths = set(histogram)
    for r in sorted(histogram, reverse=True):
        while r & (r - 1):
            r -= top(r)
            lengths.add(r)
    rows = sorted(lengths, reverse=True)
    row = {r: i for i, r in enumerate(rows)}
    m = len(rows)
    if not m:
        return Plan(size)
    cost = np.array([0.0 if c == size else padding(c, size) + SHORT for c in range(size + 1)])
    columns: list[tuple[str, dict[int, int], float]] = []
    for r in rows:
        if r & (r - 1):
            columns.append(("cut", {r: 1, r - top(r): -1}, CUT + SHORT))
        else:
            columns.append(("pattern", {r: 1}, cost[r]))

    def vector(a: dict[int, int]) -> np.ndarray:
        out = np.zeros(m)
        out[[row[r] for r in a]] = list(a.values())
        return out

    inverse = np.eye(m)  # of the first basis: what is cut of a length comes down to all of its parts
    for r in rows:
        q = r
        while q & (q - 1):
            q -= top(q)
            inverse[row[q], row[r]] = 1
    demand = np.array([histogram.get(r, 0) for r in rows], float) + 1e-7 * np.arange(1, m + 1)
    tokens = float(demand @ np.array(rows, float))
    x, y = inverse @ demand, np.array([c for _, _, c in columns]) @ inverse
    cuttable = [r for r in rows if r & (r - 1)]
    long, rest = (np.array(v, int) for v in ([row[r] for r in cuttable], [row[r - top(r)] for r in cuttable]))
    steps, past, change = 0, [], np.empty((m, m))
    sound = columns.copy(), x.copy()
    while True:
        if not (np.isfinite(y).all() and np.isfinite(x).all()):  # a basis that rounding errors made singular
            columns, x = sound
            break
        sound = columns.copy(), x.copy()
        dual = np.full(size, -np.inf)
        dual[rows] = y
        value, last = _price(dual, size)
        saved = y[long] - y[rest] - (CUT + SHORT)
        # what the last steps gained tells when more of them would not be worth their time
        past.append((steps, float(y @ demand)))
        while steps - past[0][0] > ROUND and len(past) > 1 and steps - past[1][0] >= ROUND:
            past.pop(0)
        if steps - past[0][0] >= ROUND and past[0][1] - past[-1][1] < gain * tokens:
            break
        pool = []
        for c in np.argsort(cost - value, kind="stable")[:40].tolist():
            if cost[c] - value[c] < -1e-6 and c:
                a: Counter = Counter()
                at = c
                while at:
                    a[int(last[at])] += 1
                    at -= int(last[at])
                pool.append(("pattern", dict(a), float(cost[c])))
        for i in np.flatnonzero(saved > 1e-6).tolist():
            r = cuttable[i]
            pool.append(("cut", {r: 1, r - top(r): -1}, CUT + SHORT))
        if not pool:
            break
        held, costs = np.stack([vector(a) for _, a, _ in pool]), np.array([c for _, _, c in pool])
        moved = False
        while True:
            gains = costs - held @ y
            best = int(np.argmin(gains))
            if not gains[best] < -1e-6:
                break
            some = np.flatnonzero(held[best])
            u = inverse[:, some] @ held[best, some]
            costs[best] = np.inf
            ok = u > 1e-7
            if not ok.any():
                continue
            ratio = np.full(m, np.inf)
            np.divide(x, u, out=ratio, where=ok)
            out = int(ratio.argmin())
            pivot = inverse[out] / u[out]
            y = y + gains[best] * pivot
            step = max(0.0, float(ratio[out]))
            x -= step * u
            x[out] = step
            u[out] -= 1  # the row itself becomes the pivot
            np.multiply.outer(u, pivot, out=change)
            inverse -= change
            columns[out] = pool[best]
            moved, steps = True, steps + 1
        if not moved:
            break
    return _rounded(columns, x, histogram, rows, size)


def _rounded(columns: list, x: np.ndarray, histogram: dict[int, int], rows: list[int], size: int) -> Plan:
    uses = np.floor(x + 1e-6).astype(int)
    cuts = {next(r for r, k in a.items() if k > 0): int(n) for (kind, a, _), n in zip(columns, uses, strict=True) if kind == "cut" and n > 0}
    patterns = [[a, int(n)] for (kind, a, _), n in zip(columns, uses, strict=True) if kind == "pattern" and n > 0]
    using: dict[int, list] = {}
    for p in patterns:
        for r in p[0]:
            using.setdefault(r, []).append(p)
    have = {r: histogram.get(r, 0) for r in rows}
    left: dict[int, int] = {}
    for r in rows:  # from long to short: cuts of longer ones are settled
        cuts[r] = min(cuts.get(r, 0), have[r])
        if cuts[r]:
            have[r - top(r)] += cuts[r]
        while True:
            left[r] = have[r] - cuts[r] - sum(p[0][r] * p[1] for p in using.get(r, []))
            if left[r] >= 0:
                break
            p = max((p for p in using[r] if p[1]), key=lambda p: p[1])
            p[1] -= min(p[1], -(left[r] // p[0][r]))
    for r in rows:  # patterns may have been used less since
        left[r] = have[r] - cuts[r] - sum(p[0][r] * p[1] for p in using.get(r, []))
    # best fit decreasing of what is left; a bin with more padding than its cuts cost is cut to powers of two
    room: dict[int, list[dict]] = {}
    bins = []
    for r in rows:
        for _ in range(left[r]):
            fit = next((s for s in range(r, size) if room.get(s)), None)
            b = room[fit].pop() if fit is not None else {}
            if fit is None:
                bins.append(b)
            b[r] = b.get(r, 0) + 1
            room.setdefault((fit if fit is not None else size) - r, []).append(b)
    extra: Counter = Counter()
    for b in bins:
        fill = sum(r * k for r, k in b.items())
        bits = sum(k * (r.bit_count() - 1) for r, k in b.items())
        if padding(fill, size) > bits * (CUT + SHORT):
            for r, k in b.items():
                while r & (r - 1):
                    cuts[r] = cuts.get(r, 0) + k
                    r -= top(r)
                extra[((r, 1),)] += k
        else:
            extra[tuple(sorted(b.items(), reverse=True))] += 1
    patterns = [(a, n) for a, n in patterns if n] + [(dict(a), n) for a, n in extra.items()]
    return Plan(size, patterns, {r: n for r, n in cuts.items() if n}, dict(histogram))


class Assigner:
    """Where the remainder of a given length and rank goes."""

    def __init__(self, plan: Plan):
        self.plan, self.first_sequence = plan, 0
        order = sorted({*plan.histogram, *plan.cuts, *(r for a, _ in plan.patterns for r in a)}, reverse=True)
        # the places of a length: its own remainders, then what cuts of longer ones leave, from the longest
        self.arrive: dict[int, int] = {}
        filled = {r: plan.histogram.get(r, 0) for r in order}
        for r in order:
            if n := plan.cuts.get(r, 0):
                rest = r - top(r)
                self.arrive[r] = filled.setdefault(rest, plan.histogram.get(rest, 0))
                filled[rest] += n
        self.cut_sequence: dict[int, int] = {}
        self.slots: dict[int, tuple] = {}
        slots: dict[int, list] = {}
        at = 0
        for a, n in plan.patterns:
            offset = 0
            for r in sorted(a, reverse=True):
                slots.setdefault(r, []).append((a[r] * n, a[r], at, offset))
                offset += a[r] * r
            at += n
        for r, n in plan.cuts.items():
            self.cut_sequence[r] = at
            at += n
        for r, s in slots.items():
            ends = np.cumsum([x[0] for x in s])
            self.slots[r] = (ends, s)
        self.sequences = at

    def pieces(self, r: int, rank: int) -> Iterator[tuple[int, int, int, bool]]:
        """(length, sequence, offset, whether it is what is left of the remainder from here on)"""
        while rank < (n := self.plan.cuts.get(r, 0)):
            yield top(r), self.cut_sequence[r] + rank, 0, False
            rank, r = self.arrive[r] + rank, r - top(r)
        q = rank - n
        ends, s = self.slots[r]
        i = int(np.searchsorted(ends, q, "right"))
        total, times, first, offset = s[i]
        q -= int(ends[i]) - total
        yield r, first + q // times, offset + q % times * r, True


_DOCS = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("r", pa.int64()), ("full", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))])
_RANKED = pa.schema([*_DOCS, ("task", pa.int64()), ("place", pa.int64()), ("fulls", pa.int64())])
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_DOCS_T = "doc_id long, tokens long, r long, full array<long>, bits array<long>, rests array<long>"


def checksums(ids: np.ndarray, size: int = SIZE) -> tuple[list[int], list[int], list[int]]:
    """Of each full piece; of each power of two of the remainder, from the highest; of the remainder from each of these on."""
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    n, k = len(ids), len(ids) // size
    full = [zlib.crc32(raw[4 * size * i : 4 * size * (i + 1)]) for i in range(k)]
    bits, rests, at, r = [], [], k * size, n - k * size
    while r:
        bits.append(zlib.crc32(raw[4 * at : 4 * (at + top(r))]))
        rests.append(zlib.crc32(raw[4 * at :]))
        at, r = at + top(r), r - top(r)
    return full, bits, rests


def pack(docs: DataFrame, path: str, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of docs.

    A document is its ids by the tokenizer file at path, then id 0; a null text is empty and has that id alone. Every id lies in one
    piece; a sequence's pieces lie without gaps from offset 0. Rows that repeat an id, or have none, are documents of their own.
    Other columns of docs are not read. path must be readable on every executor.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for ids, texts in text_chunks(batches):
            found = [np.append(x, np.uint32(0)) for x in e.encode(texts)]
            sums = [checksums(x, size) for x in found]
            yield batch_of(_DOCS, [ids, [len(x) for x in found], [len(x) % size for x in found], *zip(*sums, strict=True)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = materialize(texts.mapInArrow(encode, _DOCS_T), "encoded")
    plan = Assigner(solve({x.r: x.n for x in encoded.where("r > 0").groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}, size))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, place, fulls = None, 0, 0
        for b in batches:
            rs, ks = b.column(2).to_pylist(), [len(x) for x in b.column(3).to_pylist()]
            places, before = [], []
            for r, k in zip(rs, ks, strict=True):
                last, place = r, place + 1 if r == last else 0
                places.append(place)
                before.append(fulls)
                fulls += k
            yield batch_of(_RANKED, [*b.columns, [task] * len(rs), places, before])

    ordered = encoded.repartitionByRange(partitions(spark), "r", "doc_id", F.crc32(F.to_json("rests").cast("binary"))).sortWithinPartitions("r", "doc_id")
    ranked = materialize(ordered.mapInArrow(rank, f"{_DOCS_T}, task long, place long, fulls long"), "ranked")
    counts = ranked.groupBy("task", "r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("full")).alias("full")).orderBy("r", "task").collect()
    before: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    fulls: Counter = Counter()
    for c in counts:
        before[c.task, c.r] = seen[c.r]
        seen[c.r] += c.n
        fulls[c.task] += c.full
    full_before, at = {}, plan.sequences
    for task in sorted(fulls):
        full_before[task] = at
        at += fulls[task]
    sent = spark.sparkContext.broadcast((plan, before, full_before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before, full_before = sent.value
        for b in batches:
            rows: list[tuple] = []
            for doc, tokens, r, full, bits, rests, task, nth, fulls in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, crc in enumerate(full):
                    rows.append((doc, i * size, size, crc, tokens, full_before[task] + fulls + i, 0))
                if r:
                    start = len(full) * size
                    for i, (length, sequence, offset, rest) in enumerate(plan.pieces(r, before[task, r] + nth)):
                        rows.append((doc, start, length, rests[i] if rest else bits[i], tokens, sequence, offset))
                        start += length
            for s in range(0, len(rows), 50_000):
                yield batch_of(_OUT, list(zip(*rows[s : s + 50_000], strict=True)))

    return ranked.mapInArrow(place, ", ".join(f"{f.name} long" for f in _OUT))
