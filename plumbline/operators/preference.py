"""SFT and preference records from audit rows, and adaptive margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..functions import text as Y

PRESETS = {"default": {"m0": 0.1, "alpha_neg": 1.0, "alpha_imp": 1.0, "m_min": 0.0, "m_max": 0.5}, "selected": {"m0": 0.1202, "alpha_neg": 1.1497, "alpha_imp": 0.3247, "m_min": 0.0, "m_max": 0.7819}}


def enriched(audit: DataFrame, cache: DataFrame | None = None, fallback: str = "minimal", require_rationale: bool = False, cues: tuple[str, ...] = S.CUES, wordless: float = 0.0, reading: Y.Reading = Y.PYTHON) -> DataFrame:
    """Audit rows with their risk signals, gold labels, input text and rationale. Every sink reads from this one frame. wordless: s_imp of a report without words."""
    if fallback not in ("minimal", "template"):
        raise ValueError(f"unknown fallback: {fallback}")
    df = audit
    if cache is not None:
        df = df.join(cache.select("sample_id", F.col("rationale").alias("_cached")), "sample_id", "left")
    else:
        df = df.withColumn("_cached", F.lit(None).cast("string"))
    if require_rationale:
        df = df.withColumn("_cached", F.coalesce("_cached", F.raise_error(F.concat(F.lit("no rationale for "), F.col("sample_id"))).cast("string")))
    df = df.withColumns({"risk": Y.risk(F.col("report"), F.col("finding_category"), F.col("finding_definition"), cues, wordless, reading), "reference_label_text": X.label_text(F.col("reference_label")), "gold_correctness": X.correctness(F.col("audit_label")), "gold_error_type": X.error_type(F.col("corruption_type")), "error_mode": X.error_mode(F.col("corruption_type"))})
    text = X.template_rationale(F.col("finding_category"), F.col("assigned_label_text"), F.col("reference_label_text"), F.col("gold_correctness")) if fallback == "template" else F.lit(None).cast("string")
    df = df.withColumn("rationale", F.coalesce("_cached", text)).drop("_cached")
    return df.withColumns({"instruction": F.lit(S.INSTRUCTION), "input": X.input_text(F.col("report"), F.col("finding_category"), F.col("finding_definition"), F.col("assigned_label_text")), "s_neg": F.col("risk.s_neg"), "s_imp": F.col("risk.s_imp")})


def sft(rows: DataFrame) -> DataFrame:
    return rows.select(*S.COMMON_KEYS, X.audit_json(F.col("gold_correctness"), F.col("gold_error_type"), F.col("rationale")).alias("output"))


def rejected(with_rationale: bool = False, mismatch: bool = False) -> Column:
    """array<struct<rejected_type, rejected>> of a row: two for an incorrect label, one for a correct one, and a mismatch if asked."""
    finding, assigned = F.col("finding_category"), F.col("assigned_label_text")
    wrong, kind = F.col("gold_correctness") == "incorrect", F.col("gold_error_type")
    why = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]) if with_rationale else None
    one = lambda name, when, payload: F.when(when, F.struct(F.lit(name).alias("rejected_type"), payload.alias("rejected")))
    confused = F.when(kind == "false_positive", "false_negative").otherwise("false_positive")
    side = F.when(kind == "false_positive", "negative").otherwise("positive")
    alarm = F.when(assigned == "positive", "false_positive").otherwise("false_negative")
    out = [
        one("decision_flip", wrong, X.audit_json(F.lit("correct"), F.lit("none"), why("Report evidence is treated as sufficient for ", finding, ", incorrectly supporting the ", assigned, " label."))),
        one("error_type_confusion", wrong, X.audit_json(F.lit("incorrect"), confused, why("Evidence for ", finding, " is assigned to the wrong error direction, producing a ", side, " error."))),
        one("false_alarm", ~wrong, X.audit_json(F.lit("incorrect"), alarm, why("Report evidence is treated as insufficient for ", finding, ", incorrectly flagging the ", assigned, " label."))),
    ]
    if with_rationale and mismatch:
        out.append(one("rationale_mismatch", F.lit(True), X.audit_json(F.col("gold_correctness"), kind, why("Evidence unrelated to ", finding, " is treated as decisive for the audit decision."))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def dpo(rows: DataFrame, with_rationale: bool = False, mismatch: bool = False) -> DataFrame:
    chosen = X.audit_json(F.col("gold_correctness"), F.col("gold_error_type"), F.col("rationale") if with_rationale else None)
    return rows.select(*S.COMMON_KEYS, chosen.alias("chosen"), F.inline(rejected(with_rationale, mismatch))).select(*S.COMMON_KEYS, "chosen", "rejected", "rejected_type")


def risk_records(rows: DataFrame) -> DataFrame:
    return rows.select(*S.COMMON_KEYS, "corruption_type", F.col("risk.neg_evidence").alias("neg_evidence"), F.col("risk.imp_evidence").alias("imp_evidence"), F.coalesce("rationale", F.lit("")).alias("rationale"))


def build_summary(rows: DataFrame) -> DataFrame:
    """(grouping, value, n, mean_s_neg, mean_s_imp): counts by split, finding, corruption and error mode in one pass."""
    columns = ["split", "finding_category", "corruption_type", "error_mode"]
    name = F.lit(None).cast("string")
    for c in columns:
        name = F.when(F.grouping(c) == 0, c).otherwise(name)
    out = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(name.alias("grouping"), F.count(F.lit(1)).alias("n"), X.rounded(F.avg("s_neg"), 6).alias("mean_s_neg"), X.rounded(F.avg("s_imp"), 6).alias("mean_s_imp"))
    return out.select("grouping", F.coalesce(*columns).alias("value"), "n", "mean_s_neg", "mean_s_imp")


def rejected_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split", "rejected_type").agg(F.count(F.lit(1)).alias("n"))


def margin_stats(pairs: DataFrame, low: float = 0.01, high: float = 0.99, split: str = "train", empty: float | None = 0.0) -> DataFrame:
    """One row: quantiles of both signals over a split's pairs; an empty split has `empty`, and a range is never empty."""
    cols = []
    for c in ("s_neg", "s_imp"):
        q = lambda p, c=c: F.coalesce(F.percentile(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), p), F.lit(empty).cast("double"))
        cols += [q(low).alias(f"{c}_lo"), q(high).alias(f"{c}_hi")]
    out = pairs.where(F.col("split") == split).agg(*cols)
    for c in ("s_neg", "s_imp"):
        out = out.withColumn(f"{c}_hi", F.when(F.col(f"{c}_hi") <= F.col(f"{c}_lo"), F.col(f"{c}_lo") + 1).otherwise(F.col(f"{c}_hi")))
    return out


def margins(pairs: DataFrame, stats: DataFrame | None = None, mode: str = "adaptive", *, m0: float = 0.1, alpha_neg: float = 1.0, alpha_imp: float = 1.0, alpha_unc: float = 0.2, tau: float = 0.5, m_min: float = 0.0, m_max: float = 0.5, fixed_margin: float = 0.5, low: float = 0.01, high: float = 0.99, prefix: str = "", report: Column | None = None, reading: Y.Reading = Y.PYTHON) -> DataFrame:
    """pairs with their margin and its parts. Modes: adaptive, uncertainty (positive labels of uncertain reports get more), fixed.

    False positives grow with the negation signal, false negatives with the overlap signal, each times its share in a softmax of
    both; correct labels have m0. prefix: of the new columns' names, where a trainer wants one. report: else what the prompt has
    between `Report:` and the first `Finding:`.
    """
    if mode not in ("adaptive", "uncertainty", "fixed"):
        raise ValueError(f"unknown mode: {mode}")
    stats = margin_stats(pairs, low, high) if stats is None else stats  # one row
    df = pairs.crossJoin(F.broadcast(stats))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    neg = X.min_max(value("s_neg"), F.col("s_neg_lo"), F.col("s_neg_hi"))
    imp = X.min_max(value("s_imp"), F.col("s_imp_lo"), F.col("s_imp_hi"))
    prompt = F.coalesce(X.first_of(("input", "instruction", "prompt"), pairs.columns), F.lit(""))
    assigned = F.coalesce(X.first_of(("assigned_label_text",), pairs.columns), Y.field_of(prompt, "Assigned label"))
    unc = Y.uncertainty(assigned, Y.report_of(prompt) if report is None else report, reading=reading)
    df = df.withColumns({"_neg": neg, "_imp": imp, "_unc": unc})
    df = df.withColumn("_g", X.gate(F.col("_neg"), F.col("_imp"), tau))
    base = F.lit(float(m0))
    if mode == "fixed":
        margin: Column = F.lit(float(fixed_margin))
    else:
        more = F.lit(float(alpha_unc)) * F.col("_unc.score") if mode == "uncertainty" else F.lit(0.0)
        margin = F.when(F.col("error_mode") == "FP", base + F.lit(float(alpha_neg)) * F.col("_g") * F.col("_neg") + more).when(F.col("error_mode") == "FN", base + F.lit(float(alpha_imp)) * (1 - F.col("_g")) * F.col("_imp")).otherwise(base)
    margin = F.greatest(F.lit(float(m_min)), F.least(F.lit(float(m_max)), margin))
    new = {"margin": margin, "s_neg_norm": F.col("_neg"), "s_imp_norm": F.col("_imp"), "g_neg": F.col("_g"), "g_imp": 1 - F.col("_g"), "s_uncertainty_positive": F.col("_unc.score")}
    return df.select(*[F.col(f"`{c}`") for c in pairs.columns], *[X.rounded(v, 6).alias(prefix + k) for k, v in new.items()], F.col("_unc.hit").alias(f"{prefix}uncertainty_hit"))


def margin_summary(marked: DataFrame, prefix: str = "") -> DataFrame:
    m = F.col(f"{prefix}margin")
    return marked.groupBy("split", "error_mode").agg(F.count(F.lit(1)).alias("n"), F.min(m).alias("min"), F.max(m).alias("max"), F.round(F.avg(m), 6).alias("mean"))
