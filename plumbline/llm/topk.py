"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components are terms with integer weights. Queries are dealt to blocks of about BLOCK, candidates to slices; every block
meets every slice in a task of its own: the block's queries come first and become a sparse matrix, then the slice's rows stream by,
chunk by chunk, as postings per term, and each term of the queries scatters its weighted postings into a dense array of scores. A
task keeps its best by partition selection, and the tasks' best are merged. Neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, even_keys, materialize, partitions, trim

#: Queries in a block, about; candidates scored at once.
BLOCK, CHUNK = 2048, 1024

_BEST = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, terms: array of floor(1024 * x), x as double) of rows that take part: neither they nor a component null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 1024).cast("long")).alias("terms"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of terms, shorter ones filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
        if len(over) + len(even) > k:
            even = even[np.argpartition(ids[even], k - len(over) - 1)[: k - len(over)]]
        place = np.concatenate([over, even])
    else:
        place = np.arange(len(score))
    return place[np.lexsort([ids[place], -score[place]])]


class _Block:
    """The queries of a block, and the best candidates so far of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.rows, self.weights, self.k = ids, rows, weights, k
        self.terms = [(t, np.flatnonzero(weights[:, t])) for t in range(weights.shape[1])]
        self.score = [np.zeros(0, np.int64)] * len(ids)
        self.id = [np.zeros(0, np.int64)] * len(ids)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        scores = np.zeros((len(self.ids), len(ids)), np.int64)
        for t, queries in self.terms:
            if t < x.shape[1] and len(queries):
                posted = np.flatnonzero(x[:, t])
                if len(posted) == len(ids) and len(queries) == len(self.ids):
                    scores += self.weights[:, t, None] * x[None, :, t]
                elif len(posted):
                    scores[np.ix_(queries, posted)] += self.weights[queries, t, None] * x[None, posted, t]
        for q, name in enumerate(self.ids.tolist()):
            s, i = scores[q], ids
            if len(self.score[q]) >= self.k:  # what can't be among the best
                s, i = s[keep := s >= self.score[q][-1]], i[keep]
            s, i = s[other := i != name], i[other]
            if len(s):
                s, i = np.concatenate([self.score[q], s]), np.concatenate([self.id[q], i])
                best = _best(s, i, self.k)
                self.score[q], self.id[q] = s[best], i[best]

    def best(self) -> Iterator[pa.RecordBatch]:
        sizes = [len(s) for s in self.score]
        if sum(sizes):
            yield batch_of(_BEST, [np.repeat(self.ids, sizes), np.repeat(self.rows, sizes), np.concatenate(self.id), np.concatenate(self.score)])


def _search(k: int):
    """Rows (cell, query_row, vec_id, terms) come sorted by cell, a block and a slice, and in it queries first, without a null query_row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, block = None, [], None
        for batch in batches:
            cells, is_query = batch.column(0).to_numpy(), ~np.asarray(batch.column(1).is_null())
            cut = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)], strict=True):
                if s == e:
                    continue
                if cells[s] != cell:
                    if block:
                        yield from block.best()
                    cell, asked, block = cells[s], [], None
                part = batch.slice(s, e - s)
                if is_query[s]:
                    asked.append(part)
                    continue
                if block is None:
                    if not asked:
                        continue
                    width = max(int(np.diff(b.column(3).offsets.to_numpy()).max(initial=0)) for b in asked)
                    block = _Block(*(np.concatenate([b.column(c).to_numpy() for b in asked]) for c in (2, 1)), np.concatenate([_matrix(b.column(3), width) for b in asked]), k)
                for at in range(0, part.num_rows, CHUNK):
                    some = part.slice(at, CHUNK)
                    block.meet(some.column(2).to_numpy(), _matrix(some.column(3)))
        if block:
            yield from block.best()
        trim()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds the k rows of the highest integer inner products.

    Candidates are all rows but those with the query's own id; ties go to the smaller vec_id; a query with fewer candidates has all
    of them. Vectors that are null or hold null or non-finite components are neither queries nor candidates, nor are null ids.
    Vectors of different lengths multiply as if filled up with 0. A repeated row is a candidate each time; queries that repeat an id
    are each answered, with ranks of their own. Products beyond 64 bits wrap. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col)
    queries = quantized(vectors.where(F.coalesce(is_query, F.lit(False))), id_col, vector_col)
    queries = materialize(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-queries.count() // block))
    slices = max(1, -(-partitions(spark) // blocks))
    keys = F.lit(even_keys(blocks * slices, partitions(spark)).tolist())
    cell = lambda b, s: F.get(keys, b * slices + s).alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("b", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int")).withColumn("s", every(slices))
    asked = asked.select(cell(F.col("b"), F.col("s")), "query_row", "vec_id", "terms")
    met = rows.withColumn("s", F.pmod(F.xxhash64("vec_id", "terms"), F.lit(slices)).cast("int")).withColumn("b", every(blocks))
    met = met.select(cell(F.col("b"), F.col("s")), F.lit(None).cast("long").alias("query_row"), "vec_id", "terms")
    dealt = asked.unionAll(met).repartition(partitions(spark), "cell").sortWithinPartitions("cell", F.col("query_row").isNull())
    found = dealt.mapInArrow(_search(k), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as t from embeddings
           where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x::double)))),
pairs as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2]))::bigint as score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= {k}
"""
