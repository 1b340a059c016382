"""Precision, recall and F1 of label matrices, per label, macro and micro, in one pass over the cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coerce_binary, ratio
from ..schemas import LABELS, NO_FINDING


def _named(df: DataFrame, keys: list[str], labels: list[str], value: str) -> DataFrame:
    lacking = [c for c in [*keys, *labels] if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    return df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), *[coerce_binary(F.col(f"`{c}`")).alias(f"{value}{i}") for i, c in enumerate(labels)], F.lit(True).alias(f"has_{value}"))


def confusion(gold: DataFrame, predicted: DataFrame, keys: list[str], labels: list[str] | None = None) -> DataFrame:
    """(label_idx, label, tp, fp, fn, tn) of rows with equal keys. A row whose keys the other side lacks, or that has a null key, raises when the counts are read.

    Whole rows meet in one join on the keys, one aggregate counts all labels, and its single row becomes a row for each label."""
    labels = list(labels or LABELS)
    pairs = _named(gold, keys, labels, "y").join(_named(predicted, keys, labels, "p"), [f"k{i}" for i in range(len(keys))], "full")
    count = lambda i, y, p: F.count_if((F.col(f"y{i}") == y) & (F.col(f"p{i}") == p))
    cells = [F.struct(F.lit(i).alias("label_idx"), F.lit(x).alias("label"), count(i, 1, 1).alias("tp"), count(i, 0, 1).alias("fp"), count(i, 1, 0).alias("fn"), count(i, 0, 0).alias("tn")) for i, x in enumerate(labels)]
    alone = F.count_if(F.col("has_y").isNull() | F.col("has_p").isNull())
    counted = pairs.agg(F.array(*cells).alias("cells"), alone.alias("alone"), F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit("rows of gold and predictions without a partner: "), F.col("alone").cast("string"))
    checked = F.when(F.col("alone") > 0, F.raise_error(message).cast(counted.schema["cells"].dataType)).otherwise(F.col("cells"))
    return counted.where("n > 0").select(F.inline(checked))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)


def per_label(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("label", (tp + fn).alias("n_positive"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"))


def summary(counts: DataFrame) -> DataFrame:
    """One row: macro means, micro values of pooled cells, reports and labels."""
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    mean = lambda c: F.avg(c)
    a, b, c = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.agg(
        F.max(a + b + c + F.col("tn")).alias("n_reports"), F.count(F.lit(1)).alias("n_labels"),
        mean(ratio(a, a + b)).alias("macro_precision"), mean(ratio(a, a + c)).alias("macro_recall"), mean(_f1(a, b, c)).alias("macro_f1"),
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), _f1(tp, fp, fn).alias("micro_f1"), ratio(tp + tn, tp + fp + fn + tn).alias("cell_accuracy"),
    )


def check_aligned(gold: DataFrame, predicted: DataFrame) -> None:
    n, m = gold.count(), predicted.count()
    if n != m:
        raise ValueError(f"{n} gold rows, {m} predicted rows")


def no_finding(df: DataFrame, labels: list[str] | None = None, name: str = NO_FINDING) -> DataFrame:
    """With the flag that no other label is set."""
    others = [c for c in labels or LABELS if c != name]
    return df.withColumn(name, (reduce(F.greatest, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in others]) == 0).cast("int") if len(others) > 1 else (F.col(f"`{others[0]}`") == 0).cast("int"))
