"""Metrics of structured predictions in two conventions, confusions, error rows, comparisons of models, and three-class metrics.

`parsable`: rows that don't parse count in the totals only, and a false alarm is a predicted error type. `every`: all rows count, and
a false alarm is a predicted `incorrect`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import payload, schema_valid
from ..functions.scalars import first_of, pct, ratio
from ..schemas import ERROR_TYPES

PARSABLE_ORDER = ("predict", "prediction", "response", "generated_text")
EVERY_ORDER = ("predict", "prediction", "generated_text", "response")


def judged(df: DataFrame, order: tuple[str, ...] = EVERY_ORDER, gold: tuple[str, ...] = ("label", "output")) -> DataFrame:
    """df with pred_text, g and p (payload structs), valid_json, schema_valid and the *_ok flags; a row without gold raises."""
    text = F.coalesce(first_of(order, df.columns), F.lit(""))
    label = first_of(gold, df.columns)
    df = df.withColumn("pred_text", text).withColumn("_gold", F.coalesce(label, F.raise_error(F.lit("a row has no gold payload")).cast("string")))
    df = df.withColumn("p", payload(F.col("pred_text"))).withColumn("g", payload(F.col("_gold"))).drop("_gold")
    same = lambda c: F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}"))
    df = df.withColumn("valid_json", F.col("p.valid")).withColumn("schema_valid", schema_valid(F.col("p")))
    return df.withColumn("correctness_ok", same("correctness")).withColumn("error_type_ok", same("error_type")).withColumn("joint_ok", same("correctness") & same("error_type"))


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def parsable_metrics(j: DataFrame) -> DataFrame:
    n, valid, kind = F.count(F.lit(1)), F.col("valid_json"), F.col("g.error_type")
    wrong = kind.isin("false_positive", "false_negative")
    predicted = F.coalesce(F.col("p.error_type"), F.lit(""))
    return j.agg(
        n.alias("total"), pct(_count(valid), n).alias("valid_json"), pct(_count(F.col("schema_valid")), n).alias("schema_valid"),
        pct(_count(valid & F.col("correctness_ok")), n).alias("correctness_accuracy"), pct(_count(valid & F.col("error_type_ok")), n).alias("error_type_accuracy"), pct(_count(valid & F.col("joint_ok")), n).alias("joint_accuracy"),
        pct(_count(valid & (kind == "none") & (predicted != "none")), _count(valid & (kind == "none"))).alias("false_alarm_rate"),
        pct(_count(valid & wrong & (predicted == "none")), _count(valid & wrong)).alias("missed_error_rate"),
    )


def every_metrics(j: DataFrame, *by: str) -> DataFrame:
    n, kind = F.count(F.lit(1)), F.col("g.error_type")
    wrong = kind.isin("false_positive", "false_negative")
    predicted = F.col("p.error_type")
    return j.groupBy(*by).agg(
        n.alias("total"), pct(_count(F.col("valid_json")), n).alias("valid_json"), pct(_count(F.col("schema_valid")), n).alias("schema_valid"),
        pct(_count(F.col("correctness_ok")), n).alias("correctness_accuracy"), pct(_count(F.col("error_type_ok")), n).alias("error_type_accuracy"), pct(_count(F.col("joint_ok")), n).alias("joint_accuracy"),
        pct(_count((kind == "none") & (F.col("p.correctness") == "incorrect")), _count(kind == "none")).alias("false_alarm_rate"),
        pct(_count((kind != "none") & (F.col("p.correctness") == "correct")), _count(wrong)).alias("missed_error_rate"),
        _count(predicted.isNotNull() & ~predicted.isin(*ERROR_TYPES)).alias("invalid_error_types"),
    )


def confusion(j: DataFrame, every: bool = True) -> DataFrame:
    """(gold, predicted, n): with unparsable predictions as null, or without them."""
    rows = j if every else j.where("valid_json")
    return rows.groupBy(F.col("g.error_type").alias("gold"), F.col("p.error_type").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def by_gold(j: DataFrame, fixed: bool = True) -> DataFrame:
    """(gold, n, joint_accuracy): fixed, the three error types whether they occur or not; else what occurs, null as `None`."""
    ok = F.col("joint_ok") if fixed else F.col("joint_ok") & F.col("valid_json")
    found = j.groupBy(F.coalesce("g.error_type", F.lit("None")).alias("gold")).agg(F.count(F.lit(1)).alias("n"), _count(ok).alias("ok"))
    if fixed:
        names = j.sparkSession.createDataFrame([(t,) for t in ERROR_TYPES], "gold string")
        found = names.join(found, "gold", "left").fillna(0, ["n", "ok"])
    return found.select("gold", "n", pct(F.col("ok"), F.col("n")).alias("joint_accuracy"))


def worst(j: DataFrame, by: str = "finding_category", k: int = 20) -> DataFrame:
    """The k groups with the most wrong rows, ties by name."""
    found = j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _count(~F.col("joint_ok")).alias("wrong"))
    return found.select(by, "n", "wrong", pct(F.col("n") - F.col("wrong"), F.col("n")).alias("joint_accuracy")).orderBy(F.desc("wrong"), by).limit(k)


def by_assigned(j: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return j.groupBy("assigned_label_text").agg(n.alias("n"), _count(~F.col("joint_ok")).alias("wrong"), pct(_count(F.col("joint_ok")), n).alias("joint_accuracy")).orderBy("assigned_label_text")


def invalid_examples(j: DataFrame, order: str = "row_idx", k: int = 5) -> DataFrame:
    return j.where("not valid_json").select(order, "pred_text").orderBy(order).limit(k)


def invalid_values(j: DataFrame) -> DataFrame:
    return j.where(F.col("p.error_type").isNotNull() & ~F.col("p.error_type").isin(*ERROR_TYPES)).groupBy(F.col("p.error_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def error_rows(j: DataFrame, snippet: int = 500, report: str = "report") -> DataFrame:
    """The rows that are wrong, flat."""
    keep = [c for c in ("row_idx", "sample_id", "study_id", "finding_category", "assigned_label_text", "reference_label_text", "error_mode", "s_neg", "s_imp") if c in j.columns]
    text = F.coalesce(F.col(report) if report in j.columns else F.lit(None), F.lit(""))
    flat = [F.col(f"{a}.{c}").alias(f"{n}_{c}") for c in ("correctness", "error_type", "rationale") for a, n in (("g", "gold"), ("p", "pred"))]
    return j.where("not joint_ok").select(*keep, *flat, "pred_text", "valid_json", "schema_valid", "correctness_ok", "error_type_ok", "joint_ok", F.substring(F.translate(text, "\n", " "), 1, snippet).alias("report_snippet"))


def compare(base: DataFrame, other: DataFrame, key: str = "row_idx") -> DataFrame:
    """Rows of two models with their outcome: corrected, regressed, both_wrong or both_right. A row that only one of them has raises."""
    alone = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("only one model has the row "), F.col(key).cast("string"))).cast("boolean")).alias(c)
    a, b = base.select(key, F.col("joint_ok").alias("base_ok")), other.withColumnRenamed("joint_ok", "other_ok")
    outcome = F.when(F.col("base_ok") & F.col("other_ok"), "both_right").when(F.col("base_ok"), "regressed").when(F.col("other_ok"), "corrected").otherwise("both_wrong")
    both = b.join(a, key, "full")
    return both.select(*[alone(c) if c in ("base_ok", "other_ok") else F.col(f"`{c}`") for c in both.columns]).withColumn("outcome", outcome)


def outcome_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def grouped(j: DataFrame, *columns: str) -> DataFrame:
    """Counts and joint accuracy over all rows and by each column, by grouping sets in one pass; `grouping` names the column."""
    sets = [[], *[[F.col(c)] for c in columns]]
    name = F.lit("all")
    for c in columns:
        name = F.when(F.grouping(c) == 0, c).otherwise(name)
    n = F.count(F.lit(1))
    out = j.groupingSets(sets, *[F.col(c) for c in columns]).agg(name.alias("grouping"), n.alias("n"), pct(_count(F.col("joint_ok")), n).alias("joint_accuracy"))
    return out.select("grouping", F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n", "joint_accuracy")


def three_class(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, macro-F1 over the three error types (absent ones count 0), false alarms, missed errors; four digits."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g, p = F.col("g"), F.col("p")
    f1 = [ratio(2 * total((g == t) & (p == t)), total(g == t) + total(p == t)) for t in ERROR_TYPES]
    n = F.coalesce(F.sum("n"), F.lit(0))
    return cells.agg(n.alias("total"), pct(total(g == p), n, 4).alias("accuracy"), F.round((f1[0] + f1[1] + f1[2]) / 3 * 100, 4).alias("macro_f1"), pct(total((g == "none") & (p != "none")), total(g == "none"), 4).alias("false_alarm_rate"), pct(total((g != "none") & (p == "none")), total(g != "none"), 4).alias("missed_error_rate"))


def argmax_label(logits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in ERROR_TYPES]), F.array_position(logits, F.array_max(logits)).cast("int"))


def first_k(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= k).drop("_n")
