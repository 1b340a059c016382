"""Sinks: JSON lines and CSV as folders or single files, manifests, summaries, Markdown."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, bom: bool = False) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray((("\ufeff" if bom else "") + text).encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True, mode: str = "overwrite") -> None:
    """A folder of JSON lines; fields that are null are written as null or left out."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_splits(df: DataFrame, folder: str, split: str = "split", keep_nulls: bool = True) -> None:
    """A folder for each split; the split also stays in the rows."""
    df.withColumn("_split", F.col(split)).write.mode("overwrite").option("ignoreNullFields", not keep_nulls).partitionBy("_split").json(folder)


def write_csv(df: DataFrame, path: str, digits: int | None = None, mode: str = "overwrite") -> None:
    """CSV with a header; doubles with so many digits."""
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", F.col(f"`{c}`")).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def append_with_dead_letter(df: DataFrame, path: str, failed_path: str, ok: str = "status = 'ok'") -> None:
    """Rows that are ok to path, the others to failed_path, both appended."""
    df = df.persist()
    try:
        write_jsonl(df.where(ok), path, mode="append")
        write_jsonl(df.where(f"not coalesce({ok}, false)"), failed_path, mode="append")
    finally:
        df.unpersist()


def export_single(df: DataFrame, path: str, kind: str = "json", bom: bool = False) -> None:
    """One file, for small results: written by one task, then moved to path. An empty frame makes an empty file."""
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    writer = df.coalesce(1).write
    (writer.option("ignoreNullFields", False).json(folder) if kind == "json" else writer.options(header=True, quote='"', escape='"').csv(folder))
    at, fs = _path(spark, folder)
    parts = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
    target, _ = _path(spark, path)
    fs.delete(target, False)
    if parts and not bom:
        fs.rename(parts[0], target)
    else:
        stream = fs.open(parts[0]) if parts else None
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode() if stream else ""
        write_text(spark, path, text, bom and bool(text))
    fs.delete(at, True)


def dataset_manifest(prefix: str = "audit", splits: tuple[str, ...] = ("train", "val", "test")) -> dict[str, dict]:
    """A training toolkit's description of the SFT and preference files of each split."""
    out: dict[str, dict] = {}
    base = {"prompt": "instruction", "query": "input"}
    for s in splits:
        out[f"{prefix}_sft_{s}"] = {"file_name": f"{prefix}_sft_{s}.jsonl", "formatting": "alpaca", "columns": base | {"response": "output"}}
    for s in splits:
        out[f"{prefix}_dpo_{s}"] = {"file_name": f"{prefix}_dpo_{s}.jsonl", "formatting": "alpaca", "ranking": True, "columns": base | {"chosen": "chosen", "rejected": "rejected"}}
    return out


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or (list(rows[0]) if rows else [])
    clean = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(clean(r.get(c, "")) for c in columns) + " |" for r in rows)])
