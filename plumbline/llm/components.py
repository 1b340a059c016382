"""Connected components of links by alternating large-star and small-star steps. Every step is two shuffles and a written table; up to HELD links take all steps in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, materialize, trim

#: Links that one task holds, some 100 MB with what the steps need.
HELD = 1 << 20

_LABELS = pa.schema([("node", pa.int64()), ("label", pa.int64())])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All steps on the links of one task."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        n, each = len(names), np.arange(len(names))
        x, y, pairs, seen = at[: len(u)], at[len(u) :], at, None
        while seen is None or not np.array_equal(seen, pairs):
            seen = pairs
            for large in (True, False):
                x, y = (np.concatenate([x, y]), np.concatenate([y, x])) if large else (np.maximum(x, y), np.minimum(x, y))
                low = each.copy()
                np.minimum.at(low, x, y)
                x, y = (y[y > x], low[x[y > x]]) if large else (np.concatenate([y, each]), np.concatenate([low[x], low]))
                pairs = np.unique((x * n + y)[x != y])
                x, y = pairs // n, pairs % n
        label = each.copy()
        label[x] = y
        yield batch_of(_LABELS, [names, names[label]])
    ends = []
    trim()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    if large:
        sym = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
    else:
        sym = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = sym.join(low, "u")
    if large:
        out = linked.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(v.alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) of every node with a link to another node; label is the smallest node of its component.

    Null ends and self-links are ignored, repeated links count once; no links give an empty table.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    if now.count() <= HELD:
        return now.coalesce(1).mapInArrow(_held, "node long, label long")
    now = materialize(now.distinct(), "links")
    seen = None
    while True:
        new = materialize(_star(_star(now, True), False), "links")
        mark = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = new
        if seen == mark:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
