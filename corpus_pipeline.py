"""From raw documents to packed training sequences, in five stages.

Every stage reads the columns of `documents` and no others, so that further ones, whatever their names, go; a lacking one is an error.
Rows are taken as they come: a null text counts as empty, a row that repeats another is a row of its own, texts of any length are read
whole, and an empty table gives an empty one. What a null doc_id means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import packing, partenum, rules, toxicity, winnow
from plumbline.llm.common import discard, materialize
from plumbline.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labels, scores 0.3 or more; rows and columns as they come.

    Equal texts score the same; a null doc_id is scored and not learnt from. Without labels of both kinds all rows score the same."""
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.keep(docs.select(COLUMNS), model, 0.3)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model, fitted on labels, scores below 0.5; rows as in quality."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs.select(COLUMNS), model, 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later ones of repeated runs of lines of 50 words or more; n_chars is the new text's.

    A null text becomes an empty one; rows that repeat a doc_id and its text get the same text; with a null doc_id a text stays whole."""
    out = winnow.dedup_lines(docs, 50, keep=["lang", "source"])
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, 0.8), rows without a doc_id, and of rows that repeat a kept doc_id each.

    A text without words is no duplicate of anything."""
    found = partenum.near_duplicates(docs, "0.8", 5, count=False)
    out = found.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(out, "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens; rows that repeat a doc_id, or have none, are documents of their own."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]

#: The trained models and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
