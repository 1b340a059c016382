"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained together in numpy.

A word is the bag of its character 3- to 5-grams (with its borders) and itself, all hashed to rows of one embedding table, so a
misspelling that was never seen shares most rows with the word. A window of words averages its distinct words, missing ones
as zeros, so a word that a text repeats counts once; a linear softmax over two classes reads the average. Windows start at every word.

A document's score joins three things in a logistic regression: its most toxic window, what all of its distinct words tell beyond
what words usually do, wherever they stand, and how many distinct words there are. Its weights are learnt from folds: each text is
read by a model that did not learn from it, since a model's own texts look far surer than new ones. Only document labels exist, so
training starts with windows of toxic documents side by side and then keeps their most toxic ones. The fit sees at most max_rows
labelled rows of at most max_chars characters; scoring reads every word of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_chunks, trim
from .hashing import LETTER, NUMBER, UPPER, U, classes, codepoints, mix, mix_int, span_hashes
from .rules import held_out, labelled

#: The most labelled rows that a fit collects to the driver, and the most characters of such a row; longer ones are not learnt from.
MAX_ROWS, MAX_CHARS = 3_000, 50_000
WINDOW = 6
#: A word tells of toxicity by what its score has over so many standard deviations of all words' scores.
BEYOND = 2.0
#: Parts of the learning texts that are read by models learnt from the other parts.
FOLDS = 3
BUCKETS = 1 << 17
DIM = 4


@dataclass
class Words:
    """The words of some texts: the distinct ones as subword rows, all as numbers of distinct ones, and how many each text has."""

    rows: np.ndarray
    of: np.ndarray
    sizes: np.ndarray
    every: np.ndarray
    counts: np.ndarray
    names: np.ndarray


def words_of_many(texts: list[str], size: int = 1 << 18) -> Words:
    """As words_of, with room for about size characters at a time; the distinct words' rows stand by word."""
    names, numbers, n = np.zeros(0, U), np.zeros(0, np.int32), 0  # the words so far, sorted by name
    rows, of, sizes, every, counts, held = [], [], [], [], [], []
    for t in [*texts, None]:
        if t is not None:
            held.append(t)
        if held and (t is None or sum(map(len, held[-64:])) > size or len(held) % 64 == 0):
            w = words_of(held)
            at = np.searchsorted(names, w.names)
            fresh = np.ones(len(at), bool)
            inside = at < len(names)
            fresh[inside] = names[at[inside]] != w.names[inside]
            own = np.empty(len(at), np.int32)
            own[~fresh] = numbers[at[~fresh]]
            own[fresh] = n + np.arange(fresh.sum())
            n += int(fresh.sum())
            keep = np.flatnonzero(fresh[w.of])
            keep = keep[np.argsort(w.of[keep], kind="stable")]
            rows.append(w.rows[keep].astype(np.int32))
            of.append(own[w.of[keep]])
            sizes.append(w.sizes[fresh])
            every.append(own[w.every])
            counts.append(w.counts)
            names, numbers = np.concatenate([names, w.names[fresh]]), np.concatenate([numbers, own[fresh]])
            by = np.argsort(names)
            names, numbers, held = names[by], numbers[by], []
    if not counts:
        return words_of(texts)
    return Words(np.concatenate(rows), np.concatenate(of), np.concatenate(sizes), np.concatenate(every), np.concatenate(counts), names[np.argsort(numbers)])


def words_of(texts: list[str], buckets: int = BUCKETS) -> Words:
    """Words are runs of letters and digits of the lower-cased text."""
    codes, sizes = codepoints([t.lower() + "\n" for t in texts])
    kinds = classes(codes)
    inside = np.concatenate([[False], (kinds == LETTER) | (kinds == UPPER) | (kinds == NUMBER), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, np.cumsum([0, *sizes])))
    spread = mix(codes.astype(U))
    hashes = span_hashes(spread, starts, ends)
    names, first, every = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    # distinct words between borders, in a row
    size = ends - starts + 2
    at = np.cumsum([0, *size])
    line = np.full(at[-1], mix_int(-1), U)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    middle = (place > 0) & (place < np.repeat(size, size) - 1)
    line[middle] = spread[np.repeat(starts, size)[middle] + place[middle] - 1]
    left, word = np.repeat(size, size) - place, np.repeat(np.arange(len(size)), size)
    rows, of = [names % U(buckets)], [np.arange(len(size))]
    for n in (3, 4, 5):
        h = np.zeros(max(0, len(line) - n + 1), U)
        for j in range(n):
            h += line[j : len(line) - n + 1 + j] * U(mix_int(16 * n + j) | 1)
        ok = left[: len(h)] >= n
        rows.append(mix(h[ok]) % U(buckets))
        of.append(word[: len(h)][ok])
    rows_, of_ = np.concatenate(rows).astype(np.int64), np.concatenate(of)
    return Words(rows_, of_, np.bincount(of_, minlength=len(size)).astype(float), every, counts, names)


def earlier(w: Words) -> np.ndarray:
    """Of each place, the last one before it where its text has the same word; -1 without one."""
    name = np.repeat(np.arange(len(w.counts)), w.counts) * max(1, len(w.sizes)) + w.every
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    out = np.full(len(name), -1, np.int32)
    out[order[1:][same]] = order[:-1][same]
    return out


def windows_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each window, the place behind its last one, and its text. A window starts at every word that has enough
    others behind it, so no border cuts a phrase; a shorter text is one window, a text without words has none."""
    n = np.where(w.counts > 0, np.maximum(1, w.counts - WINDOW + 1), 0)
    begin = np.repeat(np.cumsum(w.counts) - w.counts, n) + _ranges(n)
    return begin, begin + np.repeat(np.minimum(w.counts, WINDOW), n), np.repeat(np.arange(len(n)), n)


@dataclass
class Windows:
    """begin, end: the first place of each window and the one behind its last; text: its text; short: windows of fewer than WINDOW
    words; again, where: each place of a window whose word stands in the window before it."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    short: np.ndarray
    again: np.ndarray
    where: np.ndarray

    def __init__(self, w: Words, before: np.ndarray, use: np.ndarray | None = None):
        self.begin, self.end, self.text = (x.astype(np.int32) for x in windows_of(w))
        if use is not None:
            some = use[self.text]
            self.begin, self.end, self.text = self.begin[some], self.end[some], self.text[some]
        self.short = np.flatnonzero(self.end - self.begin < WINDOW)
        again, where = [], []
        for k in range(1, WINDOW):
            at = np.minimum(self.begin + k, max(0, len(before) - 1))
            found = np.flatnonzero((self.begin + k < self.end) & (before[at] >= self.begin)) if len(before) else np.zeros(0, int)
            again.append(found)
            where.append(at[found])
        self.again, self.where = np.concatenate(again), np.concatenate(where)

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Of each window the sum over its distinct words. It does not depend on what stands in other texts, to the last bit."""
        n = len(each)
        line = np.concatenate([each, np.zeros(WINDOW)])
        total = line[:n].copy()
        for k in range(1, WINDOW):
            total += line[k : n + k]
        out = total[self.begin] if n else np.zeros(0)
        for i in self.short.tolist():
            out[i] = sum(each[self.begin[i] : self.end[i]].tolist())
        return out - np.bincount(self.again, each[self.where], minlength=len(out))


@dataclass
class ToxicityModel:
    table: np.ndarray  # the embedding rows
    softmax: np.ndarray  # DIM x 2
    offset: np.ndarray  # of both classes
    spread: float = 1.0  # the standard deviation of words' scores
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))  # of features()
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.pull = self.table @ (self.softmax[:, 1] - self.softmax[:, 0])  # what a row adds to the difference of the classes

    def word_scores(self, w: Words) -> np.ndarray:
        total = np.zeros(len(w.sizes))
        for s in range(0, len(w.of), 1 << 20):
            total += np.bincount(w.of[s : s + (1 << 20)], self.pull[w.rows[s : s + (1 << 20)]], minlength=len(w.sizes))
        return total / w.sizes

    def over(self, w: Words, windows: Windows) -> np.ndarray:
        """The difference of the classes in each window."""
        return windows.sums(self.word_scores(w)[w.every]) / WINDOW + self.offset[1] - self.offset[0]

    def features(self, w: Words) -> np.ndarray:
        """Of each text: the margin of its most toxic window, the evidence of all its distinct words and their number, both as
        logarithms. A text without words has only the offset."""
        before = earlier(w)
        windows = Windows(w, before)
        s = self.over(w, windows)
        most = np.full(len(w.counts), -np.inf)
        np.maximum.at(most, windows.text, s)
        most = np.where(np.isinf(most), min(0.0, float(self.offset[1] - self.offset[0])), most)
        once = before < 0
        doc, own = np.repeat(np.arange(len(w.counts)), w.counts)[once], w.every[once]
        told = np.maximum(self.word_scores(w)[own] / WINDOW / self.spread - BEYOND, 0)
        return np.stack([most / self.spread, np.log1p(np.bincount(doc, told, minlength=len(w.counts))), np.log1p(np.bincount(doc, minlength=len(w.counts)))], 1)

    def margins(self, w: Words) -> np.ndarray:
        return self.features(w) @ self.weights + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(words_of(texts)), -60, 60)))


def fit(texts: list[str], toxic: np.ndarray, *, seed: int = 11, **how) -> ToxicityModel:
    """Without both classes the model is a constant."""
    return fit_words(words_of_many(texts), folds_of(texts), toxic, seed=seed, **how)


def folds_of(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])  # equal texts share one


def fit_words(w: Words, fold: np.ndarray, toxic: np.ndarray, *, seed: int = 11, **how) -> ToxicityModel:
    y = np.asarray(toxic, int)
    if not len(y) or y.min() == y.max():
        model = _start(np.random.default_rng(seed))
        model.weights, model.shift = np.zeros(3), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    trim()
    model = learn(w, y, np.ones(len(y), bool), seed=seed, **how)
    x = model.features(w)
    if all(len(np.unique(y[fold != k])) == 2 for k in range(FOLDS)):
        for k in range(FOLDS):
            x[fold == k] = learn(w, y, fold != k, seed=seed, **how).features(w)[fold == k]
            trim()
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    q = np.concatenate([(x - centre) / spread, np.ones((len(y), 1))], 1)
    light = np.diag([0.1, 0.1, 0.1, 0.0])
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(q @ b, -60, 60)))
        h = p * (1 - p) + 1e-6
        b -= np.clip(np.linalg.solve((q * h[:, None]).T @ q + light, q.T @ (p - y) + light @ b), -2, 2)
    b[:2] = np.maximum(b[:2], 0)
    model.weights = b[:3] / spread
    model.shift = float(b[3] - model.weights @ centre)
    return model


def _start(rng: np.random.Generator) -> ToxicityModel:
    return ToxicityModel(rng.normal(0, 0.01, (BUCKETS, DIM)), np.stack([-np.linspace(0.5, 1, DIM), np.linspace(0.5, 1, DIM)], 1), np.zeros(2))


def learn(w: Words, y: np.ndarray, use: np.ndarray, *, epochs: int = 30, rate: float = 0.02, decay: float = 0.002, min_texts: int = 5, seed: int = 11) -> ToxicityModel:
    """The embeddings and the softmax from the texts in use, which have both classes."""
    rng = np.random.default_rng(seed)
    model = _start(rng)
    before = earlier(w)
    windows = Windows(w, before, use)
    begin, end, text = windows.begin, windows.end, windows.text
    if not len(np.unique(y[text])) == 2:  # a class without any words
        return model
    first_of = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    phase = np.where(np.maximum(1, w.counts - WINDOW + 1)[text] == 1, -1, (begin - (np.cumsum(w.counts) - w.counts)[text]) % WINDOW)
    trim()
    first_row = np.cumsum(w.sizes.astype(int)) - w.sizes.astype(int)
    good = np.flatnonzero(y[text] == 0)
    # rows in fewer than min_texts of the texts would be learnt by heart
    seen = np.zeros(BUCKETS, np.int64)
    ends = np.cumsum(w.counts)
    lengths = w.sizes.astype(int)
    for e, c in zip(ends[use].tolist(), w.counts[use].tolist(), strict=True):
        own = np.unique(w.every[e - c : e])
        seen[np.unique(w.rows[np.repeat(first_row[own], lengths[own]) + _ranges(lengths[own])])] += 1
    alive = np.flatnonzero(seen >= min_texts)
    number = np.zeros(BUCKETS, np.int32)  # 0 for the rare ones, which stay zero
    number[alive] = 1 + np.arange(len(alive))
    table = np.concatenate([np.zeros((1, DIM)), model.table[alive]])
    model.table[seen < min_texts] = 0
    params = [table, model.softmax, model.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        model.table[alive] = table[1:]
        model.__post_init__()
        if epoch < epochs // 4:  # windows side by side, from another border each time
            bad = np.flatnonzero((y[text] == 1) & ((phase == epoch % WINDOW) | (phase < 0)))
            pick = np.concatenate([bad, rng.choice(good, min(len(good), 2 * len(bad)), replace=False)])
        else:  # the most toxic window of every text, and others of clean texts
            s = model.over(w, windows)
            most = np.flatnonzero(s == np.repeat(np.maximum.reduceat(s, first_of), np.diff(np.append(first_of, len(s)))))
            top = most[np.concatenate([[True], text[most][1:] != text[most][:-1]])]
            pick = np.concatenate([top, rng.choice(good, min(len(good), len(top)), replace=False)])
        pick = rng.permutation(pick)
        for chosen in np.array_split(pick, max(1, len(pick) // 4096)):
            target = y[text[chosen]]
            weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
            at = begin[chosen, None] + np.arange(WINDOW)
            bag, k = np.nonzero((at < end[chosen, None]) & (before[np.minimum(at, len(before) - 1)] < begin[chosen, None]))
            words, each = np.unique(w.every[at[bag, k]], return_inverse=True)
            count = lengths[words]
            rows = number[w.rows[np.repeat(first_row[words], count) + _ranges(count)]]
            of, share = np.repeat(np.arange(len(words)), count), 1 / (w.sizes[words] * WINDOW)
            vectors = np.stack([share * np.bincount(of, table[rows, d], minlength=len(words)) for d in range(DIM)], 1)
            average = np.stack([np.bincount(bag, vectors[each, d], minlength=len(chosen)) for d in range(DIM)], 1)
            z = average @ model.softmax + model.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), target] -= 1
            p *= weight[:, None]
            back = p @ model.softmax.T
            back = np.stack([share * np.bincount(each, back[bag, d], minlength=len(words)) for d in range(DIM)], 1)
            grads = [np.stack([np.bincount(rows, back[of, d], minlength=len(table)) for d in range(DIM)], 1), average.T @ p, p.sum(0)]
            grads[0][0] = 0
            step += 1
            for x, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)
            table *= 1 - decay
    model.table[alive] = table[1:]
    model.__post_init__()
    used = np.unique(w.every[np.repeat(use, w.counts)])
    model.spread = max(float(model.word_scores(w)[used].std()) / WINDOW, 1e-6)
    return model


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in a row."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """The model from at most max_rows labelled rows with at most max_chars characters each; the texts are let go before the fit."""
    some = labelled(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars), labels, label, max_rows, "id")
    rows = some.select("id", "_y", "text").dropDuplicates().toPandas().sort_values(["id", "text"])
    texts, y = rows["text"].tolist(), rows["_y"].to_numpy()
    del rows
    w, fold = words_of_many(texts), folds_of(texts)
    del texts
    model = fit_words(w, fold, y)
    del w
    trim()
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model, of a fixed size, goes to each executor once."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            yield batch_of(schema, [ids, sent.value.scores(texts)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from labels' rows that are not held out.

    Repeated rows are each scored; equal texts score the same; a null or empty text scores as one without words. A null id is scored,
    never learnt from and not held out. Null labels are ignored; with none left, or one class, every score is the same. Columns other
    than the id and the text are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(docs, train(docs, labels, max_rows=max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: ToxicityModel, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold. A null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        found: list = []
        for _, some in text_chunks([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=["i", "t"])]):
            found += sent.value.scores(some).tolist()
        return pa.array(found, pa.float64())

    return docs.where(scores(F.col(text_col)) < threshold)
