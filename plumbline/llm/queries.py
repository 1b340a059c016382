"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, mincut, packing, partenum, pieces, rules, shards, topk, toxicity, winnow
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), "0.9", 3).select("doc_id", "n_shingles", "component_id", "links")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.dedup_lines(table(spark, sf_dir, "documents"), 50)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), path), path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.main_text(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.shard_documents(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/plumbline/store-{uuid.uuid4().hex}")
    return store.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


OP10_SQL = "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_line_dedup, op4_sentencepiece, op5_toxicity, op6_imatch_fingerprints, op7_exact_top_k, op8_html_main_text, op9_packing, op10_sharding)}
ORACLE_SQL = {"op3_line_dedup": winnow.SQL.replace("{w}", "50"), "op7_exact_top_k": topk.SQL.format(every=100, k=10), "op10_sharding": OP10_SQL}
