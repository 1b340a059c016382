"""Document fingerprints by I-Match (Chowdhury et al., with the randomised lexicons of Kolcz et al.).

A lexicon keeps the terms whose document frequency lies within a band; a text's fingerprint holds a hash of its sorted distinct
terms that are in the lexicon, and the same for many random subsets of the lexicon, thin ones and dense ones. Two texts are as alike
as the share of the subsets, at the densest thinning that tells, on which they agree.

At most (distinct terms a document) / low terms can have a document frequency of low or more, whatever the number of documents. Where
that is more than max_terms, the lexicon is itself a random subset of the band, of about that size: texts so rich that this happens
have hundreds of terms in it. Documents meet their successors by ranges of doc_id, a range of many rows of one id by ranges of their
texts' hashes; texts travel once, packed and compressed, and ranges are dealt to tasks in turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, even_keys, materialize, partitions, text_chunks, trim
from .hashing import U, mix, mix_int, word_hashes

#: Document frequencies, as shares of all documents, of the lexicon's terms.
LOW, HIGH = 0.0005, 0.2
#: Shares of the lexicon that subsets keep: 1 for the whole, then REPLICAS of each.
SHARES = tuple(2.0**-i for i in range(1, 12, 2))
REPLICAS = 16
#: The size of lexicon that is sent to the executors at most, as terms (8 bytes each).
MAX_TERMS = 4_000_000


#: Stands for a null id in the order of ids.
NONE = -(1 << 63)


def terms_of(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's words, A-Z lower-cased."""
    words, counts = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    return [np.unique(x) for x in np.split(words, np.cumsum(counts)[:-1])] if len(texts) else []


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, max_terms: int = MAX_TERMS) -> np.ndarray:
    """The sorted hashes of the terms in at least low and at most high of all rows, counted over every row, exactly; of more than max_terms, those whose hash, mixed again, lies in the lowest max_terms-th share."""
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    keys = even_keys(parts, partitions(spark))
    schema = pa.schema([("part", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (terms % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        groups = np.split(order, cut) if len(order) else []
        rows = [[int(keys[part[g[0]]]) for g in groups], [terms[g].tobytes() for g in groups], [counts[g].astype(np.int32).tobytes() for g in groups]]
        yield batch_of(schema, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, texts in text_chunks(batches):
            for t in terms_of(texts):
                held.append(t)
                n += len(t)
            if n > 1 << 21:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    out = pa.schema([("terms", pa.binary()), ("n", pa.int64())])
    n = docs.count()

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of the band of each part; rows come sorted by part."""
        last, terms, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if terms:
                names, every = np.unique(np.concatenate(terms), return_inverse=True)
                share = np.bincount(every, np.concatenate(counts), minlength=len(names)) / max(1, n)
                kept = names[(share >= low) & (share <= high)]
                yield batch_of(out, [[kept.tobytes()], [len(kept)]])
                terms.clear()
                counts.clear()

        for b in batches:
            for p, t, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if p != last:
                    yield from done()
                last = p
                terms.append(np.frombuffer(t, U))
                counts.append(np.frombuffer(c, np.int32))
        yield from done()
        trim()

    def thin(share: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in b.column(0).to_pylist():
                    x = np.frombuffer(t, U)
                    x = x[mix(x) < U(int(share * 2.0**64))]
                    yield batch_of(out, [[x.tobytes()], [len(x)]])

        return run

    counted = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "part int, terms binary, counts binary")
    counted = counted.repartition(partitions(spark), "part").sortWithinPartitions("part")
    found = materialize(counted.mapInArrow(band, "terms binary, n long"), "band")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    some = found.mapInArrow(thin(max_terms / total), "terms binary, n long") if total > max_terms else found
    kept = np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(r.terms, U) for r in some.select("terms").collect())]))
    discard(found)
    return kept


def codes_of(texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the hash of its terms in the lexicon, and 16 bits for each share and replica: 0 where it has no such term.

    A text with no term in the lexicon takes all its terms for the first hash, so that only equal term sets agree there."""
    sets = terms_of(texts)
    n = len(sets)
    flat, of = np.concatenate([np.zeros(0, U), *sets]), np.repeat(np.arange(n), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
    inside = words[at] == flat if len(words) else np.zeros(len(flat), bool)
    bare = np.bincount(of[inside], minlength=n) == 0
    whole, sizes = np.zeros(n, U), np.zeros(n, U)
    some = inside | bare[of]
    np.add.at(whole, of[some], mix(flat[some]))
    np.add.at(sizes, of[some], U(1))
    terms, owner = flat[inside], of[inside]
    codes = np.zeros((n, len(SHARES), REPLICAS), np.uint16)
    for r in range(REPLICAS):
        draw, t, o = mix(terms ^ U(mix_int(r))), terms, owner
        for level, share in enumerate(SHARES):  # each thinner subset lies in the denser one
            keep = draw < U(int(share * 2.0**64))
            draw, t, o = draw[keep], t[keep], o[keep]
            sums = np.zeros(n, U)
            np.add.at(sums, o, mix(t))
            codes[:, level, r] = np.where(np.bincount(o, minlength=n) > 0, mix(sums) % U(65535) + U(1), U(0))
    return mix(whole + sizes), codes


def strings(whole: np.ndarray, codes: np.ndarray) -> list[str]:
    """16 hex digits for the whole lexicon, then 4 for each subset."""
    return [f"{int(w):016x}{c.astype('>u2').tobytes().hex()}" for w, c in zip(whole, codes, strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; equal ones 1. The share of agreeing subsets among those that hold a term of either text, at the thinnest share of the lexicon where these are half of all or more."""
    told = ((a[1] > 0) | (b[1] > 0)).sum(2)
    agree = ((a[1] == b[1]) & (a[1] > 0)).sum(2)
    enough = told * 2 >= REPLICAS
    level = np.where(enough.any(1), len(SHARES) - 1 - enough[:, ::-1].argmax(1), 0)
    row = np.arange(len(level))
    out = agree[row, level] / np.maximum(told[row, level], 1)
    return np.where((a[0] == b[0]) & (a[1] == b[1]).all((1, 2)), 1.0, out)


def edited(text: str, following: str) -> str:
    """text with the last quarter of its code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _cuts(q: list[int]) -> list[tuple[int, int]]:
    """Where ranges of (id, hash) begin, from quantiles of the ids: one that stands for several has so many ranges, by even shares of the hashes."""
    found = []
    for i, times in Counter(q).items():
        found += [(i, -(1 << 63) + (k << 64) // times) for k in range(times)]
    return sorted(found)


def _texts(part: int, rows: list[tuple]) -> list:
    sink = pa.BufferOutputStream()
    t = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_string()), "hash": pa.array([r[2] for r in rows], pa.int64()), "own": pa.array([r[3] for r in rows], pa.bool_())})
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return [part, sink.getvalue().to_pybytes()]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The next document is that of the next doc_id in ascending order, the first after the last; rows that repeat an id follow each
    other by a hash of their texts; null ids stand first, as the smallest number. A null text is empty; an empty text has the fingerprint of no terms. A single row is
    its own next. Other columns of docs are not read. The lexicon is counted over all rows; fingerprints of equal texts are equal.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(docs, "text", low, high, max_terms))
    n = partitions(spark)
    # ranges of ids by quantiles; every range's first row also goes to the range before it
    key = F.coalesce("id", F.lit(NONE)).alias("key")
    q = docs.select(key).agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000).alias("q")).first().q if n > 1 else []
    cuts = _cuts(q or [])
    keys = even_keys(len(cuts) + 1, n)
    _at = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("hash", pa.int64())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, tuple[int, int]] = {}
        for b in batches:
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = bisect_right(cuts, (k, h))
                if p not in low or (k, h) < low[p]:
                    low[p] = (k, h)
        if low:
            yield batch_of(_at, [list(low), [k for k, _ in low.values()], [h for _, h in low.values()]])

    firsts = docs.select(key, F.xxhash64("text").alias("hash")).mapInArrow(first, "part int, key long, hash long").groupBy("part").agg(F.min(F.struct("key", "hash")).alias("low")).collect()
    heads = {r.part: (r.low.key, r.low.hash) for r in firsts}  # one for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("rows", pa.binary())])
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [_texts(int(keys[p]), r) for p, r in held.items()]
            yield batch_of(schema, [[r[0] for r in rows], [r[1] for r in rows]])
            held.clear()

        told: set[int] = set()  # ranges whose first row has gone to the range before; equal rows are one there
        tagged = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2)], names=["i", "h"]), b.column(1)], names=["k", "t"]) for b in batches)
        for ids, texts in text_chunks(tagged):
            for of, t in zip(ids, texts, strict=True):
                i, h = of["i"], of["h"]
                at = (NONE if i is None else i, h)
                p = bisect_right(cuts, at)
                held.setdefault(p, []).append((i, t, h, True))
                size += len(t)
                if heads[p] == at and p not in told:
                    told.add(p)
                    held.setdefault(before[p], []).append((i, t, h, False))
            if size > 8 << 20:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        trim()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; one range is held at a time."""
        last, blobs = None, []
        for b in batches:
            for p, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != last:
                    yield from _followed(blobs, sent.value)
                    blobs = []
                last = p
                blobs.append(rows)
        yield from _followed(blobs, sent.value)
        trim()

    packed = docs.select("id", "text", F.xxhash64("text").alias("hash")).mapInArrow(pack, "part int, rows binary").repartition(n, "part").sortWithinPartitions("part")
    return packed.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _followed(blobs: list[bytes], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The results of one range of documents."""
    if not blobs:
        return
    table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    blobs.clear()
    key = lambda r: (NONE if r[0] is None else r[0], r[1], r[2])
    places = sorted(zip(table["id"].to_pylist(), table["hash"].to_pylist(), range(len(table)), table["own"].to_pylist(), strict=True), key=key)
    own = [r for r in places if r[3]]
    others = [r for r in places if not r[3]]
    after = (others or own)[0][2]
    text = table["text"].combine_chunks() if table.num_rows else None
    for s in range(0, len(own), 256):
        some = own[s : s + 256]
        texts = text.take(pa.array([r[2] for r in own[s : s + 257]])).to_pylist()
        if len(texts) == len(some):
            texts.append(text[after].as_py())
        k = len(some)
        new = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
        whole, codes = codes_of([*texts, *new], words)
        mine, after_, changed = ((whole[x], codes[x]) for x in (slice(k), slice(1, k + 1), slice(k + 1, None)))
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        yield batch_of(_OUT, [[r[0] for r in some], [len(t) for t in texts[:k]], sha, strings(*mine), strings(*changed), likeness(mine, changed), likeness(mine, after_)])
