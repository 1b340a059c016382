"""Quality classifier: a sparse rule ensemble (Friedman and Popescu, RuleFit) over text statistics.

Small boosted trees are grown on the statistics of labelled documents, their paths become conjunctive rules, a lasso logistic
regression keeps a few of them with weights, and the kept rules are compiled into one Spark column expression. The fit sees at
most max_rows labelled rows, those with the smallest hashes of their ids; scoring counts the statistics of every whole text in
Arrow batches and applies the compiled rules in the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_chunks
from .hashing import NUMBER, OTHER, UPPER, classes, codepoints, word_hashes

#: The most labelled rows that a fit collects to the driver.
MAX_ROWS = 8_000
MARKS = np.array([ord(c) for c in "!#$%&*"], np.uint32)
STATS = ("log_chars", "log_words", "distinct_words", "symbols", "capitals", "digits", "bars", "marks", "word_length", "lines", "repeats")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stats_of(texts: list[str]) -> np.ndarray:
    """A row of STATS for each whole text. Ratios of an empty text are 0."""
    codes, sizes = codepoints(texts)
    kinds = classes(codes)
    at = np.cumsum([0, *sizes])[:-1]

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return (total[at + sizes] - total[at]).astype(float)

    n = sizes.astype(float)
    words, k = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    ends = np.cumsum(k)
    distinct = np.array([len(np.unique(words[e - c : e])) for e, c in zip(ends.tolist(), k.tolist(), strict=True)], float)
    same = np.concatenate([[0], np.cumsum(np.concatenate([words[1:] == words[:-1], [False]]))])
    repeats = np.where(k > 0, same[np.maximum(ends - 1, 0)] - same[ends - k], 0).astype(float)
    marks = np.isin(codes, MARKS)
    n1, k1 = np.maximum(n, 1), np.maximum(k, 1)
    columns = (np.log1p(n), np.log1p(k), distinct / k1, count((kinds == OTHER)) / n1, count(kinds == UPPER) / n1, count(kinds == NUMBER) / n1, count(codes == ord("|")) / k1, count(marks) / n1, n / k1, count(codes == 10) / k1, repeats / k1)
    return np.stack(columns, 1)


def statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep (an id and at most one more long) and one array column `stats` with STATS of the whole text; null is empty."""
    kept = [F.col(c).cast("long").alias(c) for c in keep]
    schema = pa.schema([*((c, pa.int64()) for c in keep), ("stats", pa.list_(pa.float64()))])

    def run(batches):
        for ids, texts in text_chunks(pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(b.columns[1:], names=keep), b.column(0)], names=["k", "t"]) for b in batches):
            yield batch_of(schema, [*([i[c] for i in ids] for c in keep), stats_of(texts).tolist()])

    return docs.select(F.col(text).alias("_t"), *kept).mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", stats array<double>")


@dataclass
class RuleModel:
    """bias + sum of weight for each rule that holds; a rule: conditions (statistic, whether over, threshold)."""

    bias: float
    rules: list[tuple[float, list[tuple[int, bool, float]]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, conditions in self.rules:
            z += w * _holds(x, conditions)
        return z

    def column(self, stats: Column) -> Column:
        """The probability of a good document as one expression over the array of statistics.

        The rules are a constant of the expression, which folds over them: written out, a few hundred rules are more code than the
        JVM compiles as one method, and every row would be interpreted through a tree of thousands of nodes."""
        told = [{"w": float(w), "all": [{"s": int(s), "over": bool(over), "at": float(at)} for s, over, at in conditions]} for w, conditions in self.rules]
        rules = F.from_json(F.lit(json.dumps(told)), "array<struct<w: double, all: array<struct<s: int, over: boolean, at: double>>>>")
        holds = lambda rule: F.forall(rule["all"], lambda c: (F.get(stats, c["s"]) > c["at"]) == c["over"])
        z = F.aggregate(rules, F.lit(float(self.bias)), lambda z, rule: z + F.when(holds(rule), rule["w"]).otherwise(F.lit(0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for s, over, at in conditions:
        ok &= (x[:, s] > at) if over else (x[:, s] <= at)
    return ok


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: list, paths: list, out: np.ndarray) -> None:
    """Grow one regression tree on logistic gradients; adds every node's path and fills out with the leaves' steps."""
    best = (1e-9, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 2 * least:
        for s in range(x.shape[1]):
            v = x[rows, s]
            order = np.argsort(v, kind="stable")
            v = v[order]
            cg, ch = np.cumsum(grad[rows][order])[:-1], np.cumsum(hess[rows][order])[:-1]
            ok = v[1:] > v[:-1]
            ok[: least - 1] = ok[len(ok) - least + 1 :] = False
            gain = np.where(ok, cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1), 0)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (gain[i], s, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        out[rows] += g / (h + 1)
        return
    _, s, at = best
    over = x[rows, s] > at
    for side, part in ((False, rows[~over]), (True, rows[over])):
        here = [*path, (s, side, at)]
        paths.append(here)
        _tree(x, grad, hess, part, depth - 1, least, here, paths, out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, penalty: float = 2e-4, steps: int = 300, seed: int = 7) -> RuleModel:
    """x: statistics, y: 0 or 1. Without rows, or with one class only, the model is a constant."""
    n = len(y)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
    if n == 0 or y.min() == y.max():
        return RuleModel(bias)
    order = np.lexsort([y, *x.T])  # the same model whatever the order of the rows
    x, y = x[order], y[order].astype(float)
    rng = np.random.default_rng(seed)
    z, paths = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(n, max(1, min(n, max(200, n // 2))), replace=False))
        step = np.zeros(n)
        found: list = []
        _tree(x, y - p, p * (1 - p), rows, depth, max(1, min(10, n // 50)), [], found, step)
        for path in found:
            paths.append(path)
        # rows left out of the sample take the leaf of their own path
        rest = np.setdiff1d(np.arange(n), rows)
        if len(rest):
            for path in (q for q in found if not any(len(r) > len(q) and r[: len(q)] == q for r in found)):
                inside = rows[_holds(x[rows], path)]
                if len(inside):
                    step[rest[_holds(x[rest], path)]] = step[inside[0]]
        z = z + 0.3 * step
    unique = list(dict.fromkeys(tuple(p) for p in paths))
    r = np.stack([_holds(x, list(p)) for p in unique], 1).astype(float)
    _, first = np.unique(r, axis=1, return_index=True)
    r, unique = r[:, np.sort(first)], [unique[i] for i in np.sort(first)]
    mean, scale = r.mean(0), np.maximum(r.std(0), 1e-3)
    q = (r - mean) / scale
    # lasso logistic by accelerated proximal gradient
    w, b = np.zeros(q.shape[1]), bias
    v, vb, t = w.copy(), b, 1.0
    size = 4 / (np.linalg.norm(q, 2) ** 2 / n + 1)
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(q @ v + vb))) - y) / n
        new = v - size * (q.T @ e)
        new, nb = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0), vb - size * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    weights = w / scale
    return RuleModel(float(b - weights @ mean), [(float(k), list(p)) for k, p in zip(weights, unique, strict=True) if abs(k) > 1e-6])


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """docs' rows with a label of the learning part, at most max_rows ids of the smallest hashes; the id's labels count as 1 if any is."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return docs.join(F.broadcast(known), F.col(id_col) == F.col("_id"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    some = labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), labels, label, max_rows, "id")
    rows = statistics(some, "text", ["id", "_y"]).dropDuplicates().toPandas()
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATS))
    return fit(x, rows["_y"].to_numpy())


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """keep, and score: 0 to 1 for every row, higher for better text; a null text counts as empty."""
    return statistics(docs, text_col, keep).select(*keep, model.column(F.col("stats")).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from labels' rows that are not held out.

    Repeated rows are each scored; equal texts score the same. A null id is scored, never learnt from and not held out. Null labels
    are ignored; with none left, or one class, every score is the same. Columns other than the id and the text are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(docs, labels, max_rows=max_rows)
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: RuleModel, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more. A null text counts as empty."""
    out = pa.float64()

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        found: list = []
        for _, some in text_chunks([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=["i", "t"])]):
            found += stats_of(some).tolist()
        return pa.array(found, pa.list_(out))

    scored = docs.withColumn("_plumbline_stats", stats(F.col(text_col)))
    return scored.where(model.column(F.col("_plumbline_stats")) >= threshold).drop("_plumbline_stats")
