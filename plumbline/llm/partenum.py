"""Jaccard self-join of documents' word shingles by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

Sets are put in bands of about equal size. Two sets of a band with a Jaccard similarity of gamma or more differ in at most k
features, k known from the band. The features' domain is dealt by a hash into n1 first-level partitions, each into n2 second-level
ones; some first-level partition holds at most k2 of the differences, so both sets agree on some n2 - k2 of its second-level
partitions, and the hash of what a set has there is a signature that both share. A set also signs for every pair of its band and
another one that can hold a set that it links with, however far apart the similarity lets them be. A few spare first-level partitions
let a set leave out signatures over too few features to tell it apart; sets that agree on a signature agree on leaving it out.

Documents with equal sets are one node. Signatures are dealt by their hash as packed arrays, a group of equal signatures names a
pivot, and every node is first verified against the pivot that it shares most signatures with. Members of a group that are then in
different components are compared by parity sketches, which never lose a link: a short one, then one that grows with its sets. What is
left is verified exactly. Pairs inside a component are not needed to find it, so a group of n near copies costs about n rows; a
large group that is compared is dealt to blocks, and pairs of blocks to tasks. All
links of a node lie in its component: to count them, its members are dealt to blocks, and each pair of blocks is compared exactly
in memory, all with all, and gives only a sum for each node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch_of, discard, even_keys, materialize, maybe_broadcast, partitions, text_chunks, trim
from .components import components
from .hashing import U, mix, mix_int, shingle_sets

#: Bits of a short parity sketch, and the least of a long one.
SKETCH = 512
#: Sets of so many features or more are compared by their long sketches, too, within a group: the short one tells too little there.
LARGE = 400
#: Nodes of a component that a block has, about, where links are counted; of a group, where its members are compared by sketches.
BLOCK, WIDE = 512, 2048
#: Bytes of long sketches up to which they are broadcast.
SKETCHES = 8 << 20
#: Signatures that a task holds before it passes them on.
HELD = 1 << 19


class Scheme:
    """The bands and signatures for one similarity."""

    def __init__(self, similarity: Fraction, ratio: float = 1.5, n2: int = 3, k2: int = 1, least: int = 2, spare: int = 8):
        self.g, self.ratio, self.n2, self.k2, self.least, self.spare = Fraction(similarity), ratio, n2, k2, least, spare
        if not 0 < self.g <= 1:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.tops = [0]
        self.known: dict[int, list[tuple[int, int, int]]] = {}
        self.choices = list(itertools.combinations(range(n2), n2 - k2))

    def differences(self, total: int) -> int:
        """The most features that two sets of total features together may differ in."""
        return int((1 - self.g) * total / (1 + self.g))

    def band(self, m: int) -> int:
        while self.tops[-1] < m:
            low = self.tops[-1] + 1
            self.tops.append(max(low, int(low * self.ratio)))
        return int(np.searchsorted(self.tops, m))

    def instances(self, m: int) -> list[tuple[int, int, int]]:
        """(lower band, upper band, k) for which a set of m features signs: all pairs of its band and one that can hold a set linked with it."""
        if m in self.known:
            return self.known[m]
        b, most = self.band(m), int(m / self.g)
        self.band(most)
        out = []
        for low in range(b, 0, -1):
            if self.tops[low] < m * self.g:
                break
            out.append((low, b))
        for high in range(b + 1, len(self.tops)):
            if self.tops[high - 1] + 1 > most:
                break
            out.append((b, high))
        differ = lambda x, y: self.differences(self.tops[x] + min(self.tops[y], int(self.tops[x] / self.g)))
        self.known[m] = [(x, y, k) for x, y in out if (k := differ(x, y))]  # where none may differ, sets are equal and one node
        return self.known[m]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        found = []
        w = mix(features ^ U(0x5851F42D4C957F2D))
        for low, high, k in self.instances(len(features)):
            inst = low * 4096 + high
            base = k // (self.k2 + 1) + 1
            spare = base // self.spare
            n1 = base + spare
            cell = (mix(features + U(mix_int(inst))) % U(n1 * self.n2)).astype(np.intp)
            sums = np.zeros(n1 * self.n2, U)
            np.add.at(sums, cell, w)
            sums, sizes = sums.reshape(n1, self.n2), np.bincount(cell, minlength=n1 * self.n2).reshape(n1, self.n2)
            sub = np.stack([sums[:, c].sum(1, dtype=U) for c in self.choices], 1)
            weak = np.stack([sizes[:, c].sum(1) for c in self.choices], 1) < self.least
            sub = mix(sub + mix(U(mix_int(~inst)) + np.arange(sub.size, dtype=U).reshape(sub.shape)))
            # Linked sets agree in spare + 1 first-level partitions or more. A set with weak signatures in at most spare of them has
            # none in one of those, and what the sets agree on there is as strong in the other set: both give it.
            found.append(sub[~weak] if weak.any(1).sum() <= spare else sub.ravel())
        return np.concatenate(found) if found else np.zeros(0, U)


def node_of(features: np.ndarray) -> int:
    """A positive 63-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(features).sum(dtype=U) + U(len(features))], U))[0] >> U(1))


def sketch_of(features: np.ndarray) -> np.ndarray:
    """The parities of a set's features dealt to cells, one or two cells for each feature. Two sets differ in as many features at
    least as their sketches in cells, also after folding."""
    size = max(SKETCH, 1 << (len(features) - 1).bit_length())
    cells = (mix(features ^ U(0xA5A5A5A5)) % U(size)).astype(np.intp)
    return np.packbits(np.bincount(cells, minlength=size) & 1)


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch that the same set has with only size bytes."""
    return sketch if len(sketch) == size else np.bitwise_xor.reduce(sketch.reshape(-1, size))


_NODES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("long", pa.binary())])
_BLOBS = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("packed", pa.binary())])
_GROUPS = pa.schema([("gid", pa.int64()), ("chunk", pa.int32()), ("pivot", pa.int64()), ("size", pa.int64()), ("weight", pa.int64()), ("members", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("features", pa.binary())])
_COUNTS = pa.schema([("node", pa.int64()), ("links", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _as_spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            sets = shingle_sets(texts, words)
            some = [len(s) > 0 for s in sets]
            sketches = [sketch_of(s) if x else None for s, x in zip(sets, some, strict=True)]
            short = [None if x is None else fold(x, SKETCH // 8).tobytes() for x in sketches]
            yield batch_of(_NODES, [ids, [len(s) for s in sets], [node_of(s) if x else None for s, x in zip(sets, some, strict=True)], short, [None if x is None else x.tobytes() for x in sketches]])

    return run


def _signed(words: int, scheme: Scheme, keys: np.ndarray):
    """Signatures dealt to parts by their remainder, parts named by keys. Packed: the upper 48 bits of the quotient's hash, the lower 16 the place of the node in nodes."""

    parts = len(keys)

    def flush(nodes: list[int], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        who = np.repeat(np.arange(len(signs), dtype=U), [len(s) for s in signs])
        signs_ = np.concatenate(signs)
        part = (signs_ % U(parts)).astype(np.int32)
        packed = (signs_ // U(parts) * U(0x9E3779B97F4A7C15)) & U(0xFFFFFFFFFFFF0000) | who
        order = np.argsort(part, kind="stable")
        part, packed = part[order], packed[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        names = np.array(nodes, np.int64)
        rows: list[list] = [[], [], []]
        for p, x in zip(keys[part[np.concatenate([[0], cut])]].tolist(), np.split(packed, cut), strict=True):
            used, place = np.unique((x & U(0xFFFF)).astype(np.intp), return_inverse=True)
            for column, v in zip(rows, (p, names[used].tobytes(), ((x & U(0xFFFFFFFFFFFF0000)) | place.astype(U)).tobytes()), strict=True):
                column.append(v)
        yield batch_of(_BLOBS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        signs: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0
        for _, texts in text_chunks(batches):
            for s in shingle_sets(texts, words):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(x := scheme.signatures(s)):
                    seen.add(node)
                    nodes.append(node)
                    signs.append(x)
                    n += len(x)
                    if n >= HELD or len(nodes) == 1 << 16:
                        yield from flush(nodes, signs)
                        nodes, signs, n, seen = [], [], 0, set()
        if nodes:
            yield from flush(nodes, signs)
        nodes, signs, seen = [], [], set()
        trim()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of two or more nodes with a signature in common; equal groups of a part once, with their number as weight. Rows come sorted by part; one part is held at a time."""

    def done(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        size = sum(len(x) for _, x in held) // 8
        key, name = np.empty(size, U), np.empty(size, np.int64)
        at = 0
        for nodes, packed in held:
            x = np.frombuffer(packed, U)
            key[at : at + len(x)] = x & U(0xFFFFFFFFFFFF0000)
            name[at : at + len(x)] = np.frombuffer(nodes, np.int64)[(x & U(0xFFFF)).astype(np.intp)]
            at += len(x)
        held.clear()
        order = np.argsort(key, kind="stable")
        key, name = key[order], name[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        del key
        found: dict[bytes, int] = {}
        for f, s in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            members = np.unique(name[f : f + s])
            if len(members) > 1:
                k = members.tobytes()
                found[k] = found.get(k, 0) + 1
        rows: list[list] = [[] for _ in _GROUPS]
        n = 0
        for members, weight in found.items():
            m = np.frombuffer(members, np.int64)
            gid = int(mix(np.array([mix(m.astype(U)).sum(dtype=U)], U))[0] >> U(1))
            for c in range(0, len(m), 4096):
                for column, v in zip(rows, (gid, c // 4096, int(m[0]), len(m), weight, m[c : c + 4096]), strict=True):
                    column.append(v)
                n += min(4096, len(m) - c)
                if n > 1 << 16:
                    yield batch_of(_GROUPS, rows)
                    rows, n = [[] for _ in _GROUPS], 0
        if rows[0]:
            yield batch_of(_GROUPS, rows)

    last, held = None, []
    for b in batches:
        for p, nodes, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and p != last:
                yield from done(held)
            last = p
            held.append((nodes, packed))
    if held:
        yield from done(held)
    trim()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            yield batch_of(_SETS, [[node_of(s) for s in sets], [s.tobytes() for s in sets]])

    return run


def may_link(g: Fraction, m: int, n: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets of m and n features with the sketches x and y can be links."""
    if min(m, n) * g.denominator < max(m, n) * g.numerator:
        return False
    size = min(len(x), len(y))
    apart = int(np.bitwise_count((fold(x, size) ^ fold(y, size)).view(U)).sum())
    return apart <= (m + n) * (g.denominator - g.numerator) // (g.denominator + g.numerator)


def _screened(g: Fraction):
    """The pairs that their sizes and long sketches allow to be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], []]
            for a, b, m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "la", "lb")), strict=True):
                if may_link(g, m, n, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)):
                    rows[0].append(a)
                    rows[1].append(b)
            yield batch_of(_PAIRS, rows)

    return run


def _verified(g: Fraction):
    """The pairs that are links. Rows come sorted by pair, two for each with the sets of its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, b""
        for batch in batches:
            rows: list[list] = [[], []]
            for a, b, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "features")), strict=True):
                if last != (a, b):
                    last, x = (a, b), y
                    continue
                one, two = np.frombuffer(x, U), np.frombuffer(y, U)
                at = np.searchsorted(one, two)
                both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
                if g.denominator * both >= g.numerator * (len(one) + len(two) - both):
                    rows[0].append(a)
                    rows[1].append(b)
            yield batch_of(_PAIRS, rows)

    return run


def _apart(g: Fraction, nearest: bool):
    """Pairs of a group's members in different components that their sizes and sketches allow to be links; with nearest, only that
    of each member whose short sketches differ least, else those that the long ones of large sets allow, too. Rows come sorted by gid, lo
    and hi, two blocks of a group; of two different ones only pairs across are given. A task gives a pair once for many groups in a row."""

    def pairs(n: np.ndarray, label: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs' members, which are sorted by n."""
        best, whom = np.full(len(n), np.inf), np.full(len(n), -1)
        for i in range(0, len(n), 256):
            stop = int(np.searchsorted(n, int(n[min(i + 255, len(n) - 1)] / g), "right"))
            for j in range(i, stop, 4096):
                x, y = slice(i, min(i + 256, len(n))), slice(j, min(j + 4096, stop))
                total = n[x, None] + n[None, y]
                most = total * (g.denominator - g.numerator) // (g.denominator + g.numerator)
                ok = (label[x, None] != label[None, y]) & (side[x, None] != side[None, y]) & (n[None, y] * g.numerator <= n[x, None] * g.denominator)
                if i + 256 > j:
                    ok &= np.arange(len(n))[x, None] < np.arange(len(n))[None, y]
                apart = np.zeros(total.shape, np.int64)
                for k in range(sketch.shape[1]):
                    apart += np.bitwise_count(sketch[x, None, k] ^ sketch[None, y, k])
                ok &= apart <= most
                if not nearest:
                    u, v = np.nonzero(ok)
                    yield u + x.start, v + y.start
                elif ok.any():
                    far = np.where(ok, apart / total, np.inf)
                    for axis, mine, other in ((1, x, y), (0, y, x)):
                        low, at = far.min(axis), far.argmin(axis) + other.start
                        better = low < best[mine]
                        best[mine] = np.where(better, low, best[mine])
                        whom[mine] = np.where(better, at, whom[mine])
        if nearest:
            some = np.flatnonzero(whom >= 0)
            yield some, whom[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                order = np.argsort(t["n"].to_numpy(), kind="stable")
                sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), U).reshape(len(t), -1)
                n, node, large = t["n"].to_numpy()[order], t["node"].to_numpy()[order], t["long"].take(order).to_pylist()
                long = [None if v is None else np.frombuffer(v, np.uint8) for v in large]
                block, lo = t["block"].to_numpy()[order], t["lo"][0].as_py()
                side = np.where(block == lo, 0, 1) if lo != t["hi"][0].as_py() else np.arange(len(n))
                for p, q in pairs(n, t["label"].to_numpy()[order], side, sketch[order]):
                    a, b = node[p], node[q]
                    places = zip(p.tolist(), q.tolist(), strict=True)
                    new = {k: v for k, v in zip(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True), places, strict=True) if k not in seen}
                    if len(seen) > 1 << 19:
                        seen.clear()
                    seen.update(new)
                    found = [k for k, (i, j) in new.items() if long[i] is None or long[j] is None or may_link(g, int(n[i]), int(n[j]), long[i], long[j])]
                    if found:
                        yield batch_of(_PAIRS, list(zip(*found, strict=True)))
                held.clear()

        last = None
        for batch in batches:
            gid, lo, hi = (batch.column(c).to_numpy() for c in ("gid", "lo", "hi"))
            cut = [0, *(np.flatnonzero((np.diff(gid) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1).tolist(), len(gid)]
            for s, e in itertools.pairwise(cut):
                if s < e:
                    if last != (now := (gid[s], lo[s], hi[s])):
                        yield from done()
                    last = now
                    held.append(batch.slice(s, e - s))
        yield from done()
        seen.clear()
        trim()

    return run


def _counted(g: Fraction):
    """The documents of other nodes that each node of two blocks links to. Rows come sorted by label, lo and hi."""

    def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, block, hi, copies, raw = (list(c) for c in zip(*held, strict=True))
        sets = [np.frombuffer(f, U) for f in raw]
        n, same = np.array([len(s) for s in sets]), max(hi) == min(block)
        copies_, far = np.array(copies), np.array(block) == hi[0]
        x, y = np.arange(len(n)) if same else np.flatnonzero(~far), np.flatnonzero(far)
        if len(x) and len(y):
            _, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            who = np.repeat(np.arange(len(n)), n)[times[of] > 1]  # what only one set has is in no two
            of = (np.cumsum(times > 1) - 1)[of][times[of] > 1]
            order = np.argsort(of, kind="stable")
            of, who = of[order], who[order]
            both = np.zeros((len(x), len(y)))
            for c in range(0, int(of[-1]) + 1 if len(of) else 0, 1024):
                s, e = np.searchsorted(of, [c, c + 1024])
                has = np.zeros((len(n), 1024), np.float32)
                has[who[s:e], of[s:e] - c] = 1
                both += has[x] @ has[y].T
            both = both.astype(np.int64)
            link = g.denominator * both >= g.numerator * (n[x, None] + n[None, y] - both)
            if same:
                np.fill_diagonal(link, False)
            total = np.zeros(len(n), np.int64)
            total[x] += link @ copies_[y]
            if not same:
                total[y] += copies_[x] @ link
            yield batch_of(_COUNTS, [node, total])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for label, lo, hi, node, block, copies, features in zip(*(batch.column(c).to_pylist() for c in ("label", "lo", "hi", "node", "block", "copies", "features")), strict=True):
                if held and (label, lo, hi) != last:
                    yield from done(held)
                    held = []
                last = (label, lo, hi)
                held.append((node, block, hi, copies, features))
        if held:
            yield from done(held)
            held = []
        trim()

    return run


def _blocks(members: DataFrame, wide: int) -> DataFrame:
    """members, with the number `size` of those they stand with, dealt to blocks of about wide: a row for each block that its own meets, as lo and hi."""
    blocks = F.ceil(F.col("size") / wide).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "size")
    return dealt


def near_duplicates(docs: DataFrame, similarity: float | Fraction | str = "0.8", words: int = 5, *, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) of every row of docs; without count, no links.

    Two documents link when the Jaccard similarity of their sets of distinct shingles is similarity or more; component_id is the
    smallest doc_id reachable by links, itself included. links: the documents other than it, by
    doc_id, that the row's text links with, those of equal sets included; one that has several different sets counts for each. Null and empty texts have no shingles, link with nothing and are their own component. Rows that
    repeat a doc_id count as one document that has all their links; a row without shingles is its own component even then. A null doc_id keeps a row with its n_shingles and a null
    component_id, and takes no part. Other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    g = Fraction(str(similarity)) if not isinstance(similarity, Fraction) else similarity
    scheme = scheme or Scheme(g)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = materialize(docs.mapInArrow(_nodes(words), _as_spark(_NODES)), "nodes")
    named = docs.where("doc_id is not null")
    whole = nodes.where("node is not null and doc_id is not null")
    several = whole.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = materialize(several.select("doc_id", "a", "b"), "several")
    repeated = several.count()  # without any, a node's set is read once and its rows are its documents
    lowest = F.min(F.struct("doc_id", "n", "sketch", "long"))
    copies = F.countDistinct("doc_id") if repeated else F.count(F.lit(1))
    reps = whole.groupBy("node").agg(lowest.alias("low"), copies.alias("copies"))
    reps = materialize(reps.select("node", F.col("low.doc_id").alias("rep"), "copies", F.col("low.n").alias("n"), F.col("low.sketch").alias("sketch"), F.col("low.long").alias("long")), "reps")

    keys = even_keys(4 * partitions(spark), partitions(spark))
    blobs = named.mapInArrow(_signed(words, scheme, keys), _as_spark(_BLOBS)).repartition(partitions(spark), "part").sortWithinPartitions("part")
    groups = blobs.mapInArrow(_grouped, _as_spark(_GROUPS))
    groups = materialize(groups.groupBy("gid", "chunk").agg(F.first("pivot").alias("pivot"), F.first("size").alias("size"), F.sum("weight").alias("weight"), F.first("members").alias("members")), "groups")

    def ends(pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select(*more, F.explode(F.array("a", "b")).alias("node"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of the nodes wanted, made again from the texts of one document each, and other sets of these documents."""
        few = maybe_broadcast(wanted.select(F.col("rep").alias("doc_id")))
        sets = named.join(few, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(words), _as_spark(_SETS))
        return sets.dropDuplicates(["node"]) if repeated else sets

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs, of which none comes twice. Both sets of each that passes the screen go to one task."""
        asked = materialize(reps.join(maybe_broadcast(ends(pairs)), "node", "left_semi").select("node", "rep", "n", "long"), "asked")
        x = asked.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("long").alias("la"))
        y = asked.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("long").alias("lb"))
        if (asked.agg(F.sum(F.length("long") + 64)).first()[0] or 0) <= SKETCHES:
            x, y = F.broadcast(x), F.broadcast(y)
        screened = materialize(pairs.join(y, "b").join(x, "a").mapInArrow(_screened(g), _as_spark(_PAIRS)), "screened")
        left = 2 * screened.count()
        wanted = materialize(asked.select("node", "rep").join(maybe_broadcast(ends(screened), left), "node", "left_semi"), "wanted")
        sent = sets_of(wanted).join(maybe_broadcast(ends(screened, "a", "b"), left), "node").select("a", "b", "features")
        sent = sent.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b")
        found = materialize(sent.mapInArrow(_verified(g), _as_spark(_PAIRS)), "verified")
        discard(wanted, screened, asked)
        return found

    # a pivot is the smallest of its group, so that no pair comes twice
    shared = groups.select("pivot", "weight", F.explode("members").alias("node")).where("node <> pivot").repartition(partitions(spark), "node")
    best = shared.groupBy("node", "pivot").agg(F.sum("weight").alias("weight")).groupBy("node").agg(F.max_by("pivot", F.struct("weight", -F.col("pivot"))).alias("pivot"))
    tested = materialize(best.select(F.col("pivot").alias("a"), F.col("node").alias("b")), "tested")
    links = verified(tested)
    if repeated:  # texts under one doc_id are one document
        bridges = whole.join(maybe_broadcast(several.where("a < b").select("doc_id", "a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        links = links.union(materialize(bridges, "bridges"))
    found = materialize(components(links, "a", "b"), "components")

    # what a group has in different components: first each member's nearest, which joins most of them, then every pair that is left
    for nearest in (True, True, False):
        few, long = maybe_broadcast(found), F.lit(None).cast("binary") if nearest else F.when(F.col("n") >= LARGE, F.col("long"))
        labelled = lambda x: x.select("gid", "size", F.explode("members").alias("node")).join(few, "node", "left").select("gid", "size", "node", F.coalesce("label", "node").alias("label"))  # noqa: E731, B023
        mixed = materialize(labelled(groups).groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gid"), "mixed")
        member = materialize(_blocks(labelled(groups.join(maybe_broadcast(mixed), "gid", "left_semi")), WIDE), "apart-members")
        rest = reps.select("node", "n", "sketch", long.alias("long")).join(maybe_broadcast(member, limit=BROADCAST_ROWS // 4), "node")
        rest = rest.select("gid", "lo", "hi", "block", "node", "label", "n", "sketch", "long").repartition(partitions(spark), "gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi")
        rest = materialize(rest.mapInArrow(_apart(g, nearest), _as_spark(_PAIRS)).distinct(), "apart")
        discard(mixed, member)
        if rest.isEmpty():
            break
        new = materialize(rest.join(maybe_broadcast(tested), ["a", "b"], "left_anti"), "tested")
        discard(rest)
        if new.isEmpty():
            continue
        more = verified(new)
        tested = tested.union(new)
        if not more.isEmpty():
            links = links.union(more)
            old, found = found, materialize(components(links, "a", "b"), "components")
            discard(old)
    discard(groups, tested)

    # of every node that has copies or links: its component, how many nodes that has, and its smallest document
    many = reps.select("node", "rep", "copies").join(maybe_broadcast(found), "node", "left").where("label is not null or copies > 1").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    low = materialize(many.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size")), "low")
    of = materialize(many.join(maybe_broadcast(low), "label"), "of")
    discard(reps, low)
    out = nodes.select("doc_id", "n", "node")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    if not count:
        return out.join(maybe_broadcast(of.select("node", "component_id")), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component)

    # all links of a node lie in its component: blocks of its members, each with each
    member = of.where("size > 1").select("node", "label", "size", "copies", "rep")
    dealt = sets_of(member).join(maybe_broadcast(_blocks(member.drop("rep"), BLOCK), limit=BROADCAST_ROWS // 4), "node")
    dealt = dealt.repartition(partitions(spark), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    summed = dealt.mapInArrow(_counted(g), _as_spark(_COUNTS)).groupBy("node").agg(F.sum("links").alias("links"))
    summed = materialize(summed, "counts")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0).cast("long").alias("links")
    of = of.select("node", "component_id", "copies").join(maybe_broadcast(summed), "node", "left")
    return out.join(maybe_broadcast(of), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component, own)
