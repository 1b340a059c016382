"""Model payloads as strict JSON: flat objects by built-in functions, whatever else by an Arrow UDF."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = "valid boolean, is_object boolean, correctness string, error_type string, rationale string"
_ARROW = pa.struct([("valid", pa.bool_()), ("is_object", pa.bool_()), ("correctness", pa.string()), ("error_type", pa.string()), ("rationale", pa.string())])


def read_payload(text: str | None, retry: bool = True) -> dict | None:
    """Strict JSON; if retry, else what stands from the first { to the last }. None if neither parses."""
    if text is None:
        return None
    for part in (text.strip(), text[text.find("{") : text.rfind("}") + 1] if retry and "{" in text else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        as_text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        fields = value if isinstance(value, dict) else {}
        return {"valid": True, "is_object": isinstance(value, dict)} | {k: as_text(fields.get(k)) for k in ("correctness", "error_type", "rationale")}
    return {"valid": False, "is_object": False, "correctness": None, "error_type": None, "rationale": None}


def _strict(retry: bool):
    @F.arrow_udf(PAYLOAD)
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([read_payload(t, retry) for t in texts.to_pylist()], _ARROW)

    return parse


def payload(text: Column, retry: bool = True) -> Column:
    """struct<valid, is_object, correctness, error_type, rationale>; a null text isn't valid."""
    flat = text.rlike(r"^\s*\{[^{}\\]*\}\s*$") & F.try_parse_json(text).isNotNull()
    native = F.from_json(text, "correctness string, error_type string, rationale string")
    quick = F.struct(F.lit(True).alias("valid"), F.lit(True).alias("is_object"), native["correctness"].alias("correctness"), native["error_type"].alias("error_type"), native["rationale"].alias("rationale"))
    slow = _strict(retry)(F.when(F.coalesce(flat, F.lit(False)), None).otherwise(text))
    none = F.struct(F.lit(False).alias("valid"), F.lit(False).alias("is_object"), *[F.lit(None).cast("string").alias(c) for c in ("correctness", "error_type", "rationale")])
    return F.when(text.isNull(), none).when(flat, quick).otherwise(slow)


def schema_valid(p: Column) -> Column:
    """An object whose values are known and agree."""
    from .scalars import expected_correctness

    ok = p["is_object"] & p["correctness"].isin("correct", "incorrect") & p["error_type"].isin("none", "false_positive", "false_negative") & (p["correctness"] == expected_correctness(p["error_type"]))
    return F.coalesce(ok, F.lit(False))
