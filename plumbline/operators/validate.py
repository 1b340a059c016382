"""Record validation and rationale rules: the first violated rule of each row as a column, and a strict form that raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as Y
from ..functions.jsonx import payload
from .structured import first_k


class Violation(ValueError):
    """The first bad record."""


def _payload_rules(name: str, column: str, rationale: bool) -> list[tuple[Column, str]]:
    p = F.col(name)
    rules = [
        (~p["valid"], f"{column} is not JSON"), (~p["is_object"], f"{column} is not an object"), (p["correctness"].isNull(), f"{column} lacks correctness"), (p["error_type"].isNull(), f"{column} lacks error_type"),
        (~p["correctness"].isin(*S.CORRECTNESS), f"{column} has an unknown correctness"), (~p["error_type"].isin(*S.ERROR_TYPES), f"{column} has an unknown error_type"),
        (p["rationale"].isNotNull() & (F.trim(p["rationale"]) == ""), f"{column} has a blank rationale"),
    ]
    return [*rules, (p["rationale"].isNull(), f"{column} lacks rationale")] if rationale else rules


def violations(df: DataFrame, kind: str, require_rationale: bool = False) -> DataFrame:
    """df with `violation`: null, or the first rule that the row breaks. kind: sft or dpo."""
    keys = S.SFT_KEYS if kind == "sft" else S.DPO_KEYS
    lacking = [k for k in keys if k not in df.columns]
    if lacking:
        return df.withColumn("violation", F.lit(f"lacks {', '.join(lacking)}"))
    rules: list[tuple[Column, str]] = [(F.col(k).isNull(), f"lacks {k}") for k in keys]
    outputs = ("output",) if kind == "sft" else ("chosen", "rejected")
    for i, c in enumerate(outputs):
        df = df.withColumn(f"_p{i}", payload(F.col(c), retry=False))
        rules += _payload_rules(f"_p{i}", c, require_rationale)
    first = F.col("_p0")
    rules += [(first["correctness"] != F.col("gold_correctness"), f"{outputs[0]} disagrees with gold_correctness"), (first["error_type"] != F.col("gold_error_type"), f"{outputs[0]} disagrees with gold_error_type")]
    if kind == "dpo":
        rules.append((F.col("chosen") == F.col("rejected"), "chosen equals rejected"))
    found = F.coalesce(*[F.when(test, F.lit(what)) for test, what in rules])
    return df.withColumn("violation", found).drop(*[f"_p{i}" for i in range(len(outputs))])


def require_valid(df: DataFrame, kind: str, require_rationale: bool = False, order: str = "sample_id") -> DataFrame:
    """df if every row is valid, else Violation with the first bad row."""
    bad = violations(df, kind, require_rationale).where("violation is not null").orderBy(order).limit(1).collect()
    if bad:
        raise Violation(f"{bad[0][order]}: {bad[0].violation}")
    return df


def validation_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rationale_reason(rationale: Column, assigned: Column, correct: Column, kind: Column) -> Column:
    """`ok` or why a rationale is rejected; the first of the ordered rules wins."""
    r = Y.clean_rationale(F.coalesce(rationale, F.lit("")))
    low, words, side = F.lower(r), Y.word_count(r), F.lower(assigned)
    any_of = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    starts = F.exists(F.array(*[F.lit(p) for p in S.BANNED_STARTS]), lambda p: F.startswith(low, p))
    banned = F.lit(False)
    for p in S.BANNED_TERMS:
        banned = banned | low.rlike(p)
    supports = F.contains(low, F.lit("positive")) & F.contains(low, F.lit("support")) & ~any_of(("unsupported", "not support"))
    return (
        F.when(words < 6, "rationale is too short")
        .when(words > 35, "rationale is too long")
        .when(r.rlike("""['"]"""), "rationale contains quotation marks")
        .when(starts, "template-like rationale opening")
        .when(~F.contains(low, side), "rationale does not mention assigned label polarity")
        .when(any_of(S.GENERIC_PHRASES), "generic disease-definition phrase detected")
        .when(banned, "banned contradiction-style wording")
        .when((correct == "correct") & (side == "negative") & any_of(S.NEGATIVE_UNSUPPORTED), "correct negative label described as unsupported")
        .when((kind == "false_positive") & supports, "false positive rationale may imply positive support")
        .when((kind == "false_negative") & low.rlike(r"\bnegative\b") & low.rlike(r"\b(?:is|label is|label remains)\s+correct\b"), "false negative rationale says negative label is correct")
        .otherwise("ok")
    )


def rationale_audit(rationales: DataFrame, source: DataFrame) -> DataFrame:
    """Rationales joined with their audit rows (an unknown sample_id raises), with `reason`."""
    from ..functions.scalars import correctness, error_type

    rows = rationales.join(source.drop("rationale"), "sample_id", "left")
    known = F.coalesce(F.col("corruption_type"), F.raise_error(F.concat(F.lit("unknown sample_id "), F.col("sample_id"))).cast("string"))
    return rows.withColumn("reason", rationale_reason(F.col("rationale"), F.col("assigned_label_text"), correctness(F.col("audit_label")), error_type(known)))


def reason_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reason_examples(audited: DataFrame, k: int = 3) -> DataFrame:
    return first_k(audited.select("reason", "sample_id", "rationale"), "reason", "sample_id", k)
