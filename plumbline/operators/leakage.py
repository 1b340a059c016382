"""Leakage between splits: equal ids and equal normalized texts. All fields and pairs of splits share one shuffle."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_of, some
from ..functions.text import report_of, text_hash

FIELDS = ("sample_id", "study_id", "input_hash", "report_hash")
SPLITS = ("train", "val", "test")


def record_keys(df: DataFrame, split: str = "_split", row_idx: str | None = None) -> DataFrame:
    """The keys of each record as strings, '' where there is none."""
    have = df.columns
    pieces = [F.concat(F.lit(f"{c}: "), some(c)) for c in ("report", "finding_category", "finding_definition", "assigned_label_text") if c in have]
    text = F.coalesce(first_of(("input", "input_text", "text", "prompt", "source", "query"), have), some(F.concat_ws("\n", *pieces)) if pieces else F.lit(None), F.lit(""))
    df = df.withColumn("_text", text)
    report = F.coalesce(first_of(("report",), have), report_of(F.col("_text"), or_separator=True))
    blank = lambda *c: F.trim(F.coalesce(first_of(c, have), F.lit("")))
    return df.select(
        (F.col(row_idx).cast("string") if row_idx else F.lit("")).alias("row_idx"), F.col(split).alias("split"), blank("sample_id", "id").alias("sample_id"), blank("study_id").alias("study_id"), blank("subject_id").alias("subject_id"),
        text_hash(F.col("_text")).alias("input_hash"), text_hash(report).alias("report_hash"), blank("finding_category", "finding").alias("finding"), F.trim(F.coalesce(first_of(("split",), have), F.col(split))).alias("split_field"),
    )


def split_summary(keys: DataFrame) -> DataFrame:
    some_of = lambda c: F.nullif(F.col(c), F.lit(""))
    distinct = [F.count_distinct(some_of(c)).alias(f"distinct_{c}") for c in FIELDS]
    again = [(F.count(some_of(c)) - F.count_distinct(some_of(c))).alias(f"repeated_{c}") for c in ("sample_id", "input_hash", "report_hash")]
    return keys.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *distinct, *again, F.count_if(F.col("split_field") != F.col("split")).alias("split_mismatches"))


def _values(keys: DataFrame) -> DataFrame:
    return keys.select("split", "row_idx", F.col("sample_id").alias("sample"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS])).alias("x")).select("split", "row_idx", "sample", "x.field", "x.value").where("value <> ''")


def overlaps(keys: DataFrame) -> DataFrame:
    """(field, value, a, b): values in two splits."""
    seen = _values(keys).groupBy("field", "value").agg(F.collect_set("split").alias("splits")).where(F.size("splits") > 1)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(SPLITS, 2)])
    both = F.filter(pairs, lambda p: F.array_contains("splits", p["a"]) & F.array_contains("splits", p["b"]))
    return seen.select("field", "value", F.explode(both).alias("p")).select("field", "value", "p.a", "p.b")


def overlap_counts(keys: DataFrame) -> DataFrame:
    """(field, a, b, n) of every field and pair, 0 where nothing overlaps."""
    wanted = keys.sparkSession.createDataFrame([(f, a, b) for f in FIELDS for a, b in combinations(SPLITS, 2)], "field string, a string, b string")
    return wanted.join(overlaps(keys).groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n")), ["field", "a", "b"], "left").fillna(0, ["n"])


def overlap_examples(keys: DataFrame, values: int = 5, records: int = 3) -> DataFrame:
    """(field, a, b, value, split, row_idx, sample): the first values of each overlap in order, and the first records of each side."""
    first = overlaps(keys).withColumn("_n", F.row_number().over(Window.partitionBy("field", "a", "b").orderBy("value"))).where(F.col("_n") <= values).drop("_n")
    rows = first.join(_values(keys), ["field", "value"]).where((F.col("split") == F.col("a")) | (F.col("split") == F.col("b")))
    order = Window.partitionBy("field", "a", "b", "value", "split").orderBy(F.col("row_idx").try_cast("long"), "row_idx")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= records).drop("_n")


def verdict(found: dict) -> list[str]:
    """Lines that say for each field and pair of splits what report() found, and what that means."""
    names = {"sample_id": "sample ids", "study_id": "study ids", "input_hash": "input texts", "report_hash": "report texts"}
    lines = [f"{x['a']} and {x['b']} share {x['n']} {names[x['field']]}." for x in found["overlaps"] if x["n"]]
    return [*lines, "LEAKAGE: the splits are not apart." if lines else "OK: no ids or texts are in two splits."]


def report(keys: DataFrame) -> dict:
    """For the driver: summaries, counts and whether anything but repeated ids within a split overlaps."""
    counts = [r.asDict() for r in overlap_counts(keys).orderBy("field", "a", "b").collect()]
    return {"splits": [r.asDict() for r in split_summary(keys).orderBy("split").collect()], "overlaps": counts, "leak": any(r["n"] for r in counts)}
