"""External models: label extraction and rationale generation, by partition, with retries, resumption and dead letters.

A model is any callable from a prompt to a reply, made once for each partition by a factory, so that a client is never pickled.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import correctness, error_type, input_text
from .label_metrics import no_finding

Model = Callable[[str], str]

EXTRACTION = (
    "Medical Imaging Report Analysis Task:\n[Target Condition] ", "\n[Report Content] ",
    "\nPlease perform the following:\n1. Consider all relevant observations and terminology.\n2. Return 1 if the target condition is confirmed.\n3. Return 0 if it is excluded, not mentioned, or low probability.\n\nResponse Format:\nSingle numeric character (0/1) with no punctuation or explanations.",
)
RETRY = {
    "rationale is too long": "The previous draft was too long. Use 18 to 25 words, one piece of evidence, then one conclusion.",
    "false positive rationale may imply positive support": "The previous draft sounded as if the positive label was supported. End with: so the positive label is unsupported.",
    "banned contradiction-style wording": "The previous draft used banned wording. Use supported or unsupported instead.",
    "rationale contains quotation marks": "The previous draft used quotation marks. Paraphrase without any.",
    "generic disease-definition phrase detected": "The previous draft sounded like a textbook. Use only this report's observations.",
    "false negative rationale says negative label is correct": "The previous draft called the negative label correct. It is incorrect or misses a supported finding.",
}


def chat_client(base_url: str, model: str, api_key: str = "", temperature: float = 0.0, max_tokens: int = 50, seed: int = 42, timeout: float = 60.0, as_json: bool = False) -> Callable[[], Model]:
    """A factory of clients for servers with the common chat-completions interface."""

    def make() -> Model:
        def ask(prompt: str) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "top_p": 1, "max_tokens": max_tokens, "seed": seed}
            if as_json:
                body["response_format"] = {"type": "json_object"}
            request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"].strip()

        return ask

    return make


def extraction_prompt(report: Column, label: Column, guidance: Column) -> Column:
    return F.concat(F.lit(EXTRACTION[0]), label, F.lit(EXTRACTION[1]), F.coalesce(report, F.lit("")), F.lit("\n"), F.coalesce(guidance, F.lit("")), F.lit(EXTRACTION[2]))


def extract_labels(reports: DataFrame, factory: Callable[[], Model], keys: list[str], *, report: str = "report", labels: tuple[str, ...] = S.LABELS, guidance: dict[str, str] | None = None, done: DataFrame | None = None, start: int = 0, limit: int | None = None, raw: bool = False) -> DataFrame:
    """(keys, one 0 or 1 for each label, error): each report is asked for each label but No Finding, which follows from the others.

    A report with a failed call keeps its row, with null labels and the error. Rows whose keys are in done are left out. start and
    limit choose a slice of the reports in the order of their keys; raw adds the model's replies as a map `raw` by label.
    """
    lacking = [c for c in [*keys, report] if c not in reports.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    asked = [c for c in labels if c != S.NO_FINDING]
    rows = reports.select(*keys, F.col(report).alias("_report"))
    if start:
        rows = rows.orderBy(*keys).offset(start)
    if limit is not None:
        rows = rows.orderBy(*keys).limit(limit)
    if done is not None:
        rows = rows.join(done.select(*keys), keys, "left_anti")
    hints = guidance or {}
    prompts = F.array(*[extraction_prompt(F.col("_report"), F.lit(c), F.lit(hints.get(c, ""))) for c in asked])
    kinds = dict(rows.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out, said, errors = [], [], []
            for prompts in b["_prompts"]:
                replies: list[str] = []
                try:
                    for p in prompts:
                        replies.append(model(p))
                    out.append([next((int(c) for c in r if c in "01"), 0) for r in replies])
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                said.append(replies)
            yield b[keys].assign(_labels=out, _said=said, error=errors)

    found = rows.select(*keys, prompts.alias("_prompts")).mapInPandas(ask, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _labels array<int>, _said array<string>, error string")
    wide = found.select(*keys, *[F.get("_labels", F.lit(i)).alias(c) for i, c in enumerate(asked)], "error", "_said")
    if S.NO_FINDING in labels:
        wide = no_finding(wide, [*asked, S.NO_FINDING]).withColumn(S.NO_FINDING, F.when(F.col("error").isNull(), F.col(f"`{S.NO_FINDING}`")))
    replies = F.map_from_arrays(F.slice(F.array(*[F.lit(c) for c in asked]), 1, F.size("_said")), F.col("_said"))
    return wide.select(*keys, *[F.col(f"`{c}`") for c in labels], "error", *([replies.alias("raw")] if raw else []))


def keyword_labels(reports: DataFrame, keys: list[str], words: dict[str, tuple[str, ...]], report: str = "report") -> DataFrame:
    """Labels without a model, in the JVM: 1 where the report has one of a label's words."""
    low = F.lower(F.coalesce(F.col(report), F.lit("")))
    hit = lambda ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in ws]).cast("int")
    out = reports.select(*keys, *[hit(ws).alias(c) for c, ws in words.items()])
    return no_finding(out, [*words, S.NO_FINDING])


def rationale_guidance(correct: Column, kind: Column, assigned: Column, finding: Column) -> Column:
    side = F.lower(assigned)
    return (
        F.when((correct == "correct") & (side == "positive"), F.concat(F.lit("The report supports "), finding, F.lit("; say that the positive label is supported or correct.")))
        .when((correct == "correct") & (side == "negative"), F.concat(F.lit("The report lacks support for "), finding, F.lit("; say that the negative label is supported, appropriate, or correct.")))
        .when(kind == "false_positive", F.concat(F.lit("The report does not support "), finding, F.lit("; say that the positive label is unsupported or false positive.")))
        .when(kind == "false_negative", F.concat(F.lit("The report supports "), finding, F.lit("; say that the negative label is incorrect or misses a supported finding.")))
        .otherwise("Explain the fixed audit result using only report evidence.")
    )


def rationale_prompt(df: DataFrame) -> DataFrame:
    """df with `prompt`."""
    correct, kind = correctness(F.col("audit_label")), error_type(F.col("corruption_type"))
    case = input_text(F.col("report"), F.col("finding_category"), F.col("finding_definition"), F.col("assigned_label_text"))
    rules = "Write one concise English sentence of under 35 words as the rationale, from the report's evidence only, without quotation marks, that names the {} label once. Do not change the result. Output JSON only: {{\"rationale\":\"...\"}}"
    side = F.lower(F.col("assigned_label_text"))
    return df.withColumn("prompt", F.concat(F.lit("Input case:\n"), case, F.lit("\n\nFixed gold audit result:\n"), F.to_json(F.struct(correct.alias("correctness"), kind.alias("error_type"))), F.lit("\n\nInterpretation guidance: "), rationale_guidance(correct, kind, side, F.col("finding_category")), F.lit("\n\n" + rules.split("{}")[0]), side, F.lit(rules.split("{}")[1].replace("{{", "{").replace("}}", "}"))))


#: What a call may fail with and is asked again for: broken replies and what the connection, the server or the clock makes of it. Other errors are the caller's.
EXPECTED = (ValueError, KeyError, TypeError, OSError)


def generate_rationales(audit: DataFrame, factory: Callable[[], Model], *, done: DataFrame | None = None, split: str | None = None, limit: int | None = None, attempts: int = 3, wait: float = 0.2, order: str = "sample_id") -> DataFrame:
    """(sample_id, split, finding_category, assigned_label_text, gold_correctness, gold_error_type, status, attempts, reason, rationale).

    Rows of the split, the first limit of them, without those in done. A reply must be JSON with a rationale that passes every rule;
    a rejected one is asked again with the reason, up to attempts times, after wait seconds times the number of the attempt. What still
    fails has the status failed; an error that is none of EXPECTED ends the job. Each attempt's replies are kept on the executors' disks
    and two of them, so that a lost executor asks nothing twice.
    """
    from ..functions.text import clean_rationale
    from .validate import rationale_reason

    rows = audit.where(F.col("split") == split) if split else audit
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    if done is not None:
        rows = rows.join(done.select("sample_id"), "sample_id", "left_anti")
    rows = rationale_prompt(rows).withColumns({"gold_correctness": correctness(F.col("audit_label")), "gold_error_type": error_type(F.col("corruption_type"))})
    keep = ["sample_id", "split", "finding_category", "assigned_label_text", "gold_correctness", "gold_error_type"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            replies, errors = [], []
            for prompt, reason, before in zip(b["_ask"], b["reason"], b["tries"], strict=True):
                if before and wait:
                    time.sleep(wait * before)
                try:
                    more = "" if not reason or reason == "ok" else "\n\n" + RETRY.get(reason, f"The previous draft was rejected because: {reason}. Rewrite it without that error.")
                    value = json.loads(model(prompt + more))
                    text = value.get("rationale") if isinstance(value, dict) else None
                    replies.append(str(text) if text and str(text).strip() else None)
                    errors.append(None if replies[-1] else "no rationale in the reply")
                except EXPECTED as e:
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.drop(columns=["reason", "tries"]).assign(rationale=replies, _error=errors)

    rows = rows.select(*keep, F.col("prompt").alias("_ask"), F.lit("").alias("reason"), F.lit(0).alias("tries"))
    schema = ", ".join(f"{c} string" for c in [*keep, "_ask", "rationale", "_error"])
    out, waiting = None, rows
    for attempt in range(1, attempts + 1):
        tried = waiting.mapInPandas(ask, schema)
        text = clean_rationale(F.coalesce("rationale", F.lit("")))
        reason = F.coalesce("_error", rationale_reason(F.col("rationale"), F.col("assigned_label_text"), F.col("gold_correctness"), F.col("gold_error_type")))
        tried = tried.withColumns({"rationale": F.when(F.col("rationale").isNotNull(), text), "reason": reason}).persist(StorageLevel.DISK_ONLY_2)
        ok = tried.where("reason = 'ok'" if attempt < attempts else "true").withColumns({"attempts": F.lit(attempt), "status": F.when(F.col("reason") == "ok", "ok").otherwise("failed")})
        ok = ok.select(*keep, "status", "attempts", "reason", F.when(F.col("status") == "ok", F.col("rationale")).alias("rationale"))
        out = ok if out is None else out.unionByName(ok)
        waiting = tried.where("reason <> 'ok'").select(*keep, "_ask", "reason", F.lit(attempt).alias("tries"))
    return out
