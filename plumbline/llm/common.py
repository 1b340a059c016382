"""What the corpus operators share: the cluster's shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import forget

#: A side of a join is broadcast up to so many rows of a few longs each; beyond it, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a folder of our own where that is unset and there are no other machines (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_plumbline_dir", None) or tempfile.mkdtemp(prefix="plumbline-")
        spark._plumbline_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_plumbline_path", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(parts: int, partitions: int) -> np.ndarray:
    """An int for each of so many parts, all different, that repartition(partitions, key) deals in turn: part p goes to partition p % partitions."""
    each = -(-parts // partitions)
    found: list[list[int]] = [[] for _ in range(partitions)]
    at, missing = 0, partitions
    while missing:
        some = np.arange(at, at + 8 * parts + 64, dtype=np.uint32)
        for key, p in zip(some.tolist(), (_spark_hash(some).astype(np.int64) % partitions).tolist(), strict=True):
            if len(found[p]) < each:
                found[p].append(key)
                missing -= len(found[p]) == each
        at += len(some)
    return np.array([found[p % partitions][p // partitions] for p in range(parts)], np.int32)


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of ints: Murmur3 with the seed 42."""
    u = np.uint32
    turn = lambda v, k: (v << u(k)) | (v >> u(32 - k))
    with np.errstate(over="ignore"):
        h = turn(turn(x * u(0xCC9E2D51), 15) * u(0x1B873593) ^ u(42), 13) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def maybe_broadcast(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it is counted to have at most limit rows, else unchanged (a shuffled join)."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= limit else small


def text_chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about size characters from batches of two columns, an id and a text; a null text is empty. A longer text stands alone."""
    ids: list = []
    texts: list[str] = []
    n = 0
    parts = (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256))
    for b in parts:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = t or ""
            if texts and n + len(t) > size:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(t)
            n += len(t)
    if texts:
        yield ids, texts
    ids, texts = [], []
    trim()


def trim() -> None:
    """Drop tables of powers and give freed memory back to the system, where its C library can: worker processes live on after a task."""
    forget()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
